"""The URL frontier: candidates, politeness, and the run loop's stop rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import fill_template


def add(candidates: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (url, ord) neither queued nor seen, each at its first ordinal."""
    new = candidates.groupBy("url").agg(F.min("ord").alias("ord"))
    known = frontier.select("url").unionByName(seen.select("url"))
    return frontier.select("url", "ord").unionByName(new.join(known, "url", "left_anti").select("url", "ord"))


def seeds(urls: DataFrame, crawls: DataFrame, redo_all: bool = False, redo_failed: bool = False, key: str = "url", crawl_key: str = "source_url") -> DataFrame:
    """Seeds still to crawl: ``redo_all`` beats ``redo_failed``, which only leaves out successful ones."""
    if redo_all:
        return urls
    done = crawls.where("fetch_success") if redo_failed else crawls
    return urls.join(done.select(F.col(crawl_key).alias(key)).distinct(), key, "left_anti").select(*urls.columns)


def not_in(df: DataFrame, key: str, some: DataFrame, column: str) -> DataFrame:
    """Of ``df``, as by an anti join with ``some``, the rows that SQL's NOT IN keeps: none if ``some`` has a null, and no null key unless it is empty."""
    known = some.agg(F.count(F.lit(1)).alias("q_all"), F.count(column).alias("q_set"))
    return df.join(F.broadcast(known)).where(f"q_all = 0 or (q_all = q_set and {key} is not null)").select(*df.columns)


def queries(templates: DataFrame, locations: DataFrame) -> DataFrame:
    """templates (t_ord, template) times locations (l_ord, location), in template-major order."""
    both = templates.crossJoin(F.broadcast(locations))  # a configured list on either side
    return both.select("t_ord", "l_ord", fill_template(F.col("template"), F.col("location")).alias("query"))


def in_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("long"))


def polite_starts(requests: DataFrame, delay: int, key: str = "domain", arrival: str = "arrival", order: str = "arrival") -> DataFrame:
    """Start of each request: t_i = max(arrival_i, t_{i-1} + delay), in closed form over a window."""
    w = Window.partitionBy(key).orderBy(order)
    i = F.row_number().over(w) - 1
    numbered = requests.withColumn("i_", i).withColumn("slack_", F.col(arrival) - F.col("i_") * delay)
    top = F.max("slack_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("start", top + F.col("i_") * delay).drop("i_", "slack_")


@dataclass
class Limits:
    """0 is unlimited."""

    rounds: int = 0
    seconds: float = 0
    discovery_batches: int = 0
    batch_size: int = 5


def run_loop(
    frontier: list[str], pending: list[str], limits: Limits, crawl: Callable[[list[str]], list[str]], discover: Callable[[list[str]], list[str]], clock: Callable[[], float],
) -> tuple[str, int, int]:
    """Drive rounds until a stop rule holds; returns (reason, rounds, discovery batches).

    ``crawl`` handles one round's snapshot and returns found links.  Rounds are tested before run time.
    """
    begun, rounds, batches, seen = clock(), 0, 0, set()
    queue = list(dict.fromkeys(frontier))

    def over() -> str:
        if limits.rounds and rounds >= limits.rounds:
            return "reached max_rounds"
        if limits.seconds and clock() - begun >= limits.seconds:
            return "reached max_runtime"
        return ""

    while True:
        if not queue:
            if not pending:
                return "exhausted", rounds, batches
            if limits.discovery_batches and batches >= limits.discovery_batches:
                return "reached max_discovery_batches", rounds, batches
            head, pending = pending[: limits.batch_size], pending[limits.batch_size :]
            queue += [u for u in dict.fromkeys(discover(head)) if u not in seen]
            batches += 1
        else:
            snapshot, queue = queue, []
            seen.update(snapshot)
            queue += [u for u in dict.fromkeys(crawl(snapshot)) if u not in seen]
            rounds += 1
        if reason := over():
            return reason, rounds, batches


def reachable(edges: DataFrame, roots: DataFrame, save: Callable[[DataFrame, str], DataFrame], most: int = 0) -> DataFrame:
    """(url, depth) of all that ``roots`` reach, or reach in ``most`` rounds (0 is unlimited); every round is written, so lineage stays flat."""
    seen = save(roots.select("url").distinct().withColumn("depth", F.lit(0)), "depth0")
    step = 0
    while not most or step < most:
        step += 1
        last = seen.where(F.col("depth") == step - 1)
        new = edges.join(last.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        grown = save(seen.unionByName(new.withColumn("depth", F.lit(step))), f"depth{step}")
        if not grown.where(F.col("depth") == step).take(1):
            return grown
        seen = grown
    return seen
