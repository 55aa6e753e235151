"""Streaming forms: the event log as a stream, URL dedup, and the politeness throttle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LOG = (
    "event string, round long, wall_time timestamp, monotonic_time double, queued long, url string, category string, categorize_seconds double, extract_seconds double, "
    "discovery_batch long, queries_used long, discovered_unique long, newly_queued long, queries_remaining long, rounds long, discovery_batches long, elapsed_seconds double, stop_reason string"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only JSON-lines log of a session."""
    return spark.readStream.schema(LOG).json(path)


def distinct_urls(stream: DataFrame) -> DataFrame:
    """First sight of each URL; state never expires, as a seen URL stays seen."""
    return stream.dropDuplicates(["url"])


def throttle(stream: DataFrame, delay: float) -> DataFrame:
    """Start time of each (domain, url, arrival), ``delay`` apart per domain; keeps one number per domain."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            starts = []
            for t in (frame := frame.sort_values(["arrival", "url"])).arrival:
                last = t if last is None else max(t, last + delay)
                starts.append(last)
            yield pd.DataFrame({"domain": key[0], "url": frame.url, "start": starts})
        if last is not None:
            state.update((float(last),))

    return stream.groupBy("domain").applyInPandasWithState(step, "domain string, url string, start double", "last double", "append", GroupStateTimeout.NoTimeout)
