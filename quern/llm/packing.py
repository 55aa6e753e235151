"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``longest`` tokens, so the global
histogram of piece lengths has at most ``longest`` rows whatever the input.  On it
dynamic programming picks the bucket boundaries that minimise padding, exactly.
Inside each bucket, pieces in hashed order form batches of ``budget`` tokens, each
piece counted with its padding.

Ranks within a bucket are found without a single-task window: the hash order is
cut into slots, slot counts are summed up, and rows are numbered within slots.

Defined results: a text without tokens (also null) is one row with piece 0,
n_tokens 0, bucket 0 and no batch; nothing is dropped or truncated; repeated rows
(same id) are packed each, ties in hash order going by id, piece and position; an
empty table gives an empty result.  Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Work

LONGEST, BUCKETS, BUDGET = 2048, 16, 65536
#: Rows that one slot holds on average.
SLOT_ROWS = 20_000


def count_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    body = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+$", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(F.concat(F.lit(" "), body), "[\\x20\\x09-\\x0D]+")) - 1)


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets for (length, count) rows, minimising padding; of equal plans that with the smaller bounds first from the top."""
    import numpy as np

    rows = sorted((int(a), int(b)) for a, b in histogram if b)
    if not rows:
        return []
    length = np.array([0] + [a for a, _ in rows], dtype=object).astype(np.int64)
    count = np.concatenate([[0], np.cumsum([b for _, b in rows])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum([a * b for a, b in rows])]).astype(np.int64)
    m = len(rows)
    big = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, big, dtype=np.int64)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, m)):
        now, pick = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + length[j] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], pick[j] = cost[i], i
        choice.append(pick)
        best = now
    out, j = [], m
    for pick in reversed(choice):
        if pick[j] >= 0:
            out.append(int(length[j]))
            j = int(pick[j])
        if j == 0:
            break
    return sorted(out)


def pack(
    spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS,
    budget: int = BUDGET, tokens: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket, batch_id, place, padding."""
    if budget < longest:
        raise ValueError("a batch must hold the longest piece")
    work = Work(spark, "packing")
    n = count_words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if tokens is None else tokens
    narrow = work.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n")), "lengths")
    last = F.greatest(F.ceil(F.col("n") / longest).cast("long") - 1, F.lit(0))
    pieces = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * longest).alias("first_token"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("long").alias("n_tokens")
    )
    histogram = [(r[0], r[1]) for r in pieces.groupBy("n_tokens").count().collect()]  # at most longest + 1 rows
    bounds = optimal_boundaries([x for x in histogram if x[0]], buckets)
    if not bounds:
        bounds = [longest]
    bucket = F.when(F.col("n_tokens") == 0, F.lit(0))
    for b in bounds:
        bucket = bucket.when(F.col("n_tokens") <= b, F.lit(b))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")).cast("binary"))
    slots = max(1, sum(c for _, c in histogram) // SLOT_ROWS)
    keyed = pieces.select("*", bucket.cast("long").alias("bucket"), order.alias("key")).withColumn(
        "slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * slots / float(1 << 32)).cast("int")
    )
    counts = keyed.where("bucket > 0").groupBy("bucket", "slot").count()
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "slot").orderBy("key", "doc_id", "piece")
    ranked = keyed.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["bucket", "slot"], "left")
    rank, room = F.col("offset") + F.col("row"), F.expr(f"{budget} div greatest(bucket, 1)")
    full = F.col("bucket") > 0
    return ranked.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket",
        F.when(full, F.floor(rank / room)).cast("long").alias("batch_id"), F.when(full, rank % room).cast("long").alias("place"),
        F.when(full, F.col("bucket") - F.col("n_tokens")).otherwise(0).cast("long").alias("padding"),
    )


def oracle_sql(longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same result in DuckDB SQL; one CTE per level of the dynamic programme."""
    levels, steps = [], []
    for k in range(1, buckets + 1):
        levels.append(
            f"""l{k} AS MATERIALIZED (SELECT j, CASE WHEN c < was THEN c ELSE was END AS best, CASE WHEN c < was THEN i ELSE -1 END AS pick FROM (
  SELECT b.j, min(p.best + b.len * (b.cnt - a.cnt) - (b.tot - a.tot)) AS c, arg_min(a.j, (p.best + b.len * (b.cnt - a.cnt) - (b.tot - a.tot)) * 4096 + a.j) AS i, any_value(q.best) AS was
  FROM acc b JOIN acc a ON a.j < b.j JOIN l{k - 1} p ON p.j = a.j JOIN l{k - 1} q ON q.j = b.j WHERE p.best < 1000000000000000 OR a.j = b.j - 1 GROUP BY b.j)
  UNION ALL SELECT 0, 0, -1)"""
        )
    for k in range(buckets, 0, -1):
        src = "(SELECT max(j) AS j FROM acc)" if k == buckets else f"t{k + 1}"
        col = "s.j" if k == buckets else "CASE WHEN s.pick >= 0 THEN s.pick ELSE s.j END"
        steps.append(f"t{k} AS (SELECT x.j, l.pick FROM (SELECT {col} AS j FROM {src} s) x JOIN l{k} l ON l.j = x.j)")
    chosen = " UNION ".join(f"SELECT j FROM t{k} WHERE pick >= 0" for k in range(1, buckets + 1))
    return f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
pieces AS (SELECT doc_id, piece, piece * {longest} AS first_token, least({longest}, n - piece * {longest})::BIGINT AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil(n / {longest}.0) AS BIGINT)))) AS piece FROM n)),
h AS (SELECT n_tokens AS len, count(*)::BIGINT AS c FROM pieces WHERE n_tokens > 0 GROUP BY 1),
acc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(c) OVER (ORDER BY len))::BIGINT AS cnt, (sum(c * len) OVER (ORDER BY len))::BIGINT AS tot FROM h UNION ALL SELECT 0, 0, 0, 0),
l0 AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE 1000000000000000 END::BIGINT AS best, -1 AS pick FROM acc),
{', '.join(levels)},
{', '.join(steps)},
bounds AS (SELECT len AS b FROM acc WHERE j IN ({chosen})),
placed AS (SELECT p.*, CASE WHEN n_tokens = 0 THEN 0 ELSE (SELECT min(b) FROM bounds WHERE b >= p.n_tokens) END AS bucket, md5(doc_id || ':' || piece) AS k FROM pieces p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k, doc_id, piece) - 1 AS r FROM placed)
SELECT doc_id, piece, first_token, n_tokens, bucket::BIGINT AS bucket, CASE WHEN bucket > 0 THEN r // ({budget} // bucket) END::BIGINT AS batch_id,
  CASE WHEN bucket > 0 THEN r % ({budget} // bucket) END::BIGINT AS place, CASE WHEN bucket > 0 THEN bucket - n_tokens ELSE 0 END::BIGINT AS padding FROM ranked"""
