"""Matching extracted records to gold records and scoring the matches."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: So many of the best extracted names are kept with a gold name; its row is scored again should they run out.
KEPT_NAMES = 256


def _common(a: str, b: str) -> int:
    """Characters in the matching blocks of a and b (Ratcliff-Obershelp): the longest block, the first in a and then in b, and the same on both sides of it."""
    size = at = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:
            size += 1
            at = i
        if i + size >= len(a):
            break
    if not size:
        return 0
    to = b.index(a[at : at + size])
    rest = size
    if at and to:
        rest += _common(a[:at], b[:to])
    if at + size < len(a) and to + size < len(b):
        rest += _common(a[at + size :], b[to + size :])
    return rest


def ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, which leaves out what is frequent in 200 characters and more."""
    if len(b) >= 200 or len(a) > 500:  # the latter as recursion is as deep as there are blocks
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def _by_name(names: list[str | None]) -> dict[str, list[int]]:
    """The rising indices of each cleaned name."""
    out: dict[str, list[int]] = {}
    for i, x in enumerate(names):
        out.setdefault((x or "").strip().lower(), []).append(i)
    return out


def greedy_pairs(gold: list[str], extracted: list[str], least: float = 0.3) -> list[tuple[int, int | None, float]]:
    """One-to-one by falling (score, gold index, extracted index); each gold once, unmatched with None and 0.

    Names are scored, not records: what has the same name is taken from the highest index down.  A heap holds each gold
    name with its best score among the names that are left, which can only fall.  So time goes with the distinct
    pairs of names and with the records, and memory with the names and records.
    """
    golds, others = _by_name(gold), _by_name(extracted)  # an extracted name goes when its records do
    used: dict[int, tuple[int, float]] = {}
    rows: dict[str, tuple[list[tuple[float, str]], tuple[float, int]]] = {}

    def scored(g: str) -> Iterator[tuple[float, int, str]]:
        for e, left in others.items():
            n = len(g) + len(e)
            if n and 2.0 * min(len(g), len(e)) / n < least:  # the most it can be
                continue
            if (s := ratio(g, e)) >= least:
                yield s, left[-1], e

    def best(g: str) -> tuple[float, str] | None:
        """The name with the highest (score, index of its last record)."""
        while True:
            if g not in rows:
                top = heapq.nlargest(KEPT_NAMES + 1, scored(g))
                beyond = top.pop()[:2] if len(top) > KEPT_NAMES else (-1.0, -1)  # what isn't kept can't be more, now or later
                rows[g] = [(s, e) for s, _, e in top], beyond
            kept, beyond = rows[g]
            while kept and kept[0][1] not in others:
                kept.pop(0)
            found = None
            for s, e in kept:
                if found and s < found[0]:
                    break
                if e in others and (found is None or others[e][-1] > found[1]):
                    found = s, others[e][-1], e
            if found and found[:2] > beyond:
                return found[0], found[2]
            if beyond[0] < 0:
                return None
            del rows[g]

    heap = [(-b[0], -left[-1], g) for g, left in golds.items() if (b := best(g))]
    heapq.heapify(heap)
    while heap and others:
        was, _, g = heapq.heappop(heap)
        b = best(g)
        if b and b[0] == -was:
            s, e = b
            used[golds[g].pop()] = others[e].pop(), s
            if not others[e]:
                del others[e]
            b = best(g) if golds[g] else None
        if b:
            heapq.heappush(heap, (-b[0], -golds[g][-1], g))
        else:
            rows.pop(g, None)
    return [(i, *(used.get(i, (None, 0.0)))) for i in range(len(gold))]


def match_records(gold: DataFrame, extracted: DataFrame, least: float = 0.3) -> DataFrame:
    """gold (key, gold_id, name), extracted (key, extracted_id, name); one page's records fit in memory."""

    def group(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("gold_id"), right.sort_values("extracted_id")
        ids, others = left.gold_id.tolist(), right.extracted_id.tolist()
        rows = [(key[0], ids[i], None if j is None else others[j], float(s)) for i, j, s in greedy_pairs(left.name.tolist(), right.name.tolist(), least)]
        return pd.DataFrame(rows, columns=["key", "gold_id", "extracted_id", "score"]).astype({"extracted_id": "Int64"})

    return gold.groupBy("key").cogroup(extracted.groupBy("key")).applyInPandas(group, "key long, gold_id long, extracted_id long, score double")


def entry_counts(gold: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    a = gold.groupBy(key).agg(F.count(F.lit(1)).alias("gold_entry_count"))
    b = extracted.groupBy(key).agg(F.count(F.lit(1)).alias("extracted_entry_count"))
    n = F.coalesce("extracted_entry_count", F.lit(0))
    return a.join(b, key, "left").select(key, "gold_entry_count", n.alias("extracted_entry_count"), (F.col("gold_entry_count") != n).alias("mismatch"))
