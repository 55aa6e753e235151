"""The operators' queries over the standard tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import packing, quality_rules
from quern.llm.bpe import encode_documents
from quern.llm.exact_dedup import exact_dedup
from quern.llm.html_extract import extract_pages
from quern.llm.lang_id import detect_language
from quern.llm.license_scan import scan_licenses
from quern.llm.ngram_join import ngram_jaccard_join
from quern.llm.packing import pack
from quern.llm.quality_classifier import classify_quality
from quern.llm.quality_rules import apply_quality_rules
from quern.llm.secret_scan import RULES, describe, scan_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, _table(spark, sf_dir, "documents"))
    base = [k for k, r in enumerate(RULES) if r.base]
    of = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    only = F.filter("found", lambda x: x["k"].isin(base))
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(describe(only).cast("binary"), 256).alias("base_sha256"), describe(F.col("found")).alias("spans"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_join(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "n_similar", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1,
    "op2_language_id": op2,
    "op3_bpe": op3,
    "op4_quality_rules": op4,
    "op5_quality_classifier": op5,
    "op6_secret_scan": op6,
    "op7_html_extraction": op7,
    "op8_ngram_jaccard_join": op8,
    "op9_license_scan": op9,
    "op10_packing": op10,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
      sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op10_packing": packing.oracle_sql(),
}
