"""Analysis of a crawl session: rounds, their outcomes, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CRAWLS = ("view", "click", "error")


def numbered(events: DataFrame) -> DataFrame:
    """Each event with its round: starts seen so far in its session; 0 is before the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("round", F.count(F.when(F.col("event_type") == "signup", 1)).over(w))


def windows(events: DataFrame) -> DataFrame:
    """[round_start, round_end) per session and round; the last stays open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.where("event_type = 'signup'").select(
        "user_id", F.row_number().over(w).cast("long").alias("round"), F.col("ts").alias("round_start"), F.lead("ts").over(w).alias("round_end")
    )


def round_report(events: DataFrame) -> DataFrame:
    """Outcomes per round in one pass: contiguous windows need no range join."""
    n = numbered(events)
    crawl, failed = F.col("event_type").isin(*CRAWLS), F.col("event_type") == "error"
    per = n.where("round > 0").groupBy("user_id", "round").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("round_start"),
        F.count(F.when(crawl, 1)).alias("fetched"), F.count(F.when(crawl & ~failed, 1)).alias("fetch_success"), F.count(F.when(failed, 1)).alias("fetch_failed"),
    )
    w = Window.partitionBy("user_id").orderBy("round")
    return per.withColumn("round_end", F.lead("round_start").over(w)).select(
        "user_id", F.col("round").cast("long").alias("round"), "round_start", "round_end", "fetched", "fetch_success", "fetch_failed"
    )


def assign_rounds(crawls: DataFrame, rounds: DataFrame) -> DataFrame:
    """Range join for general logs: the first round whose [start_mono, end_mono) holds crawl_time; an open end holds all later."""
    inside = (F.col("crawl_time") >= F.col("start_mono")) & (F.col("end_mono").isNull() | (F.col("crawl_time") < F.col("end_mono")))
    first = crawls.join(rounds, inside, "left").groupBy("crawl_id").agg(F.min("round").alias("round"))
    return crawls.join(first, "crawl_id", "left")


def rounds_of_log(log: DataFrame) -> DataFrame:
    """(round, start_mono, end_mono, queued) of a session log; of repeated rounds the last event wins."""
    start = log.where("event = 'round_start'").groupBy("round").agg(F.max_by("monotonic_time", "seq").alias("start_mono"), F.max_by("queued", "seq").alias("queued"))
    end = log.where("event = 'round_end'").groupBy("round").agg(F.max_by("monotonic_time", "seq").alias("end_mono"))
    return start.join(end, "round", "left")


def discovery_gaps(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of any kind, for discoveries."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1e6
    return events.withColumn("batch_seconds", F.round(gap, 3)).where("event_type = 'purchase'").select("event_id", "user_id", "batch_seconds")


def yield_per_batch(seen: DataFrame, key: str, batch: str) -> DataFrame:
    """New and cumulative distinct keys per batch, by each key's first batch."""
    unique = seen.groupBy(batch).agg(F.count_distinct(key).alias("batch_unique"))
    first = seen.groupBy(key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("batch_new"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    new = F.coalesce("batch_new", F.lit(0))
    return unique.join(first, batch, "left").select(
        batch, "batch_unique", new.alias("batch_new"), F.sum(new).over(w).alias("cumulative_unique"), F.round(100.0 * new / F.col("batch_unique"), 4).alias("new_pct")
    )
