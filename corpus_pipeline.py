"""A training corpus from documents: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents (the last: packed pieces).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Work, among, free_name, one_per_key, quoted, without
from quern.llm.exact_dedup import exact_dedup
from quern.llm.ngram_join import content_key, surplus_rows
from quern.llm.packing import pack
from quern.llm.quality_classifier import train, with_statistics
from quern.llm.secret_scan import redact, scan_secrets

ORACLE_SQL = None  # a trained classifier decides, which SQL can't express


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score >= 0.5)."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = [(f"c{i}", t) for i, (_, t) in enumerate(docs.dtypes)]
    plain = docs.select(*(quoted(c).alias(k) for c, (k, _) in zip(docs.columns, keep)), F.col("text").alias("whole_text"))
    scored = with_statistics(plain, text_col="whole_text", keep=tuple(keep)).where(model.column() >= 0.5)
    return scored.select(*(F.col(k).alias(c) for c, (k, _) in zip(docs.columns, keep)))


def one_of_each(docs: DataFrame, key: Column, surplus: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``surplus`` (row_key, kept); of those with ``kept`` one row stays.

    The key comes from the row's content, so it is the same however a read is split.
    """
    out = without(docs, key, surplus, "row_key")
    again = surplus.where("kept")  # rows that repeat with their identifier
    if again.take(1):
        repeated = among(docs, key, again, "row_key")
        out = out.unionByName(one_per_key(repeated, key))
    return out.select(*(quoted(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    name = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), sha)
    found = exact_dedup(spark, docs).where("group_size > 1").groupBy(name(F.col("text_sha256")).alias("row_key"))
    surplus = found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1").select("row_key", "kept")
    surplus = Work(spark, "pipeline_exact").save(surplus, "surplus")
    return one_of_each(docs, name(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)), surplus)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id, a null doc_id last."""
    return one_of_each(docs, content_key(), surplus_rows(spark, docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars follows."""
    name = free_name(docs, "found")
    out = scan_secrets(spark, docs, keep=(*docs.columns,), found_col=name)
    some = F.size(name) > 0
    out = out.withColumn("text", F.when(some, redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(quoted(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("secret_scan", secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
