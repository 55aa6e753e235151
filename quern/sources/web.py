"""Fetching pages: robots rules, and any callable or table that stands for the web."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quern.functions import urls


def _allowed(agent: str):  # noqa: ANN202
    @F.pandas_udf(BooleanType())
    def check(robots: pd.Series, url: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsers: dict[str, RobotFileParser] = {}
        out = []
        for text, u in zip(robots, url):
            if text is None or u is None:
                out.append(True)  # no rules could be read
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, u))
        return pd.Series(out, dtype="bool")

    return check


def with_permission(requests: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``requests`` (url, ...) with ``allowed``; ``robots`` is (domain, robots), and a domain without rules allows all."""
    rules = robots.select(F.col("domain").alias("r_domain"), "robots")
    joined = requests.join(rules, urls.domain(F.col("url")) == F.col("r_domain"), "left")
    return joined.withColumn("allowed", _allowed(agent)(F.col("robots"), F.col("url"))).drop("r_domain", "robots")


def fetch_from_table(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """``requests`` with html and fetch_success: the page of the same url, '' where there is none."""
    known = pages.groupBy("url").agg(F.max("html").alias("html"))
    html = F.coalesce(F.col("html"), F.lit(""))
    return requests.join(known, "url", "left").withColumn("html", html).withColumn("fetch_success", html != "")


def fetch(requests: DataFrame, get: Callable[[str], str], workers: int = 4) -> DataFrame:
    """(url, html, fetch_success, error) by calling ``get`` once per distinct url, at most ``workers`` at a time."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            out = []
            for u in batch["url"]:
                try:
                    html, error = get(u) or "", None
                except Exception as e:  # one page's failure isn't the round's
                    html, error = "", f"{type(e).__name__}: {e}"
                out.append((u, html, html != "", error))
            yield pd.DataFrame(out, columns=["url", "html", "fetch_success", "error"])

    return requests.select("url").distinct().repartition(workers).mapInPandas(run, "url string, html string, fetch_success boolean, error string")


def last_request(requests: DataFrame) -> Column:
    """Of requests (domain, at): the latest earlier request to the same domain."""
    from pyspark.sql import Window

    return F.max("at").over(Window.partitionBy("domain").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
