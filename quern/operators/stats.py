"""Statistics over run tables."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import wilson


def confusion(df: DataFrame, true: str, predicted: str, labels: list) -> DataFrame:
    """One row per (true, predicted) of ``labels``, zeros kept, with the share of the true label."""
    counts = df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame(list(product(labels, labels)), f"{true} {df.schema[true].dataType.simpleString()}, {predicted} {df.schema[predicted].dataType.simpleString()}")
    full = cells.join(counts, [true, predicted], "left").select(true, predicted, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(true))
    return full.withColumn("pct", F.round(F.try_divide(100.0 * F.col("n"), total), 4))


def per_label(df: DataFrame, true: str, predicted: str, labels: list) -> DataFrame:
    """Recall and precision with Wilson bounds; undefined (null) without a denominator."""
    aggs: list[Column] = []
    for k in labels:
        t, p = F.col(true) == k, F.col(predicted) == k
        aggs.append(F.struct(F.lit(k).alias("label"), F.count(F.when(t, 1)).alias("n_true"), F.count(F.when(p, 1)).alias("n_pred"), F.count(F.when(t & p, 1)).alias("hits")))
    rows = df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    rl, rh = wilson(F.col("hits"), F.col("n_true"))
    pl, ph = wilson(F.col("hits"), F.col("n_pred"))
    r = lambda c: F.round(c, 6)
    return rows.select(
        "label", "n_true", "n_pred", "hits", r(F.try_divide("hits", "n_true")).alias("recall"), r(rl).alias("recall_low"), r(rh).alias("recall_high"),
        r(F.try_divide("hits", "n_pred")).alias("precision"), r(pl).alias("precision_low"), r(ph).alias("precision_high"),
    )


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, which falls in the last."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = F.col(column)
    at = F.least(F.floor((x - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(bins - 1))
    return df.where(x.isNotNull()).join(F.broadcast(edges)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares with intercept from one aggregation of normal sums; (term, coefficient, r_squared)."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(cols)
    target = F.col(y).cast("double")
    sums = df.dropna(subset=[y, *xs]).agg(*(F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)), *(F.sum(c * target) for c in cols), F.sum(target * target), F.sum(target)).first()
    v = np.array(sums, dtype=float)
    a, b, yy, total = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-2], v[-1]
    beta = np.linalg.solve(a, b)
    r2 = 1 - (yy - beta @ b) / (yy - total**2 / a[0, 0])
    return df.sparkSession.createDataFrame([(n, float(c), float(r2)) for n, c in zip(["intercept", *xs], beta)], "term string, coefficient double, r_squared double")


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    m = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    t = F.try_divide(F.col("mean_diff") * F.sqrt(F.col("n").cast("double")), F.col("sd_diff"))
    return m.select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("sd_diff", 6).alias("sd_diff"), F.round(t, 6).alias("t"))


def wilcoxon(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Signed rank sums of non-zero differences, ties at their mean rank."""
    d = pairs.select(key, (F.col(a) - F.col(b)).alias("d")).where("d != 0")
    w = Window.orderBy(F.abs("d"))  # one row a sample of an experiment
    ranked = d.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(F.abs("d"))) - 1) / 2)
    plus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0))
    minus = F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))
    return ranked.agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))


def wilcoxon_exact_p(n: int, w: float) -> float:
    """Two-sided exact probability by counting signed rank sums."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which each field is neither null, '' nor an empty list."""

    def filled(c: str) -> Column:
        kind = records.schema[c].dataType.typeName()
        return F.col(c).isNotNull() & ((F.size(c) > 0) if kind == "array" else (F.col(c).cast("string") != ""))

    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.count(F.when(filled(c), 1)).alias("present"), F.count(F.lit(1)).alias("total")) for c in fields))
    return records.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")
