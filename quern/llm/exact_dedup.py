"""Exact deduplication as a stateful stream.

The arrivals (digest, length, identifier, locator; never the text) are one narrow
table, which a Structured Streaming query reads file by file.  Its state is keyed
by digest and length, lies on disk (RocksDB, checkpointed in the shared folder)
and never expires.  It retains the digest, the stable identifier of the row that
stays, the locator of that row's content, and a count.  Hits, i.e. members of
groups of two or more, are then compared with the retained row byte by byte; a
digest that fails this (a collision) is grouped by its texts instead.

Defined results: a null text counts as empty; a null identifier is smaller than
any other; of rows with equal text and equal identifier exactly one stays; an
empty table gives an empty result.  Extra columns of the input are not read.

Skew: the streaming aggregation combines before it shuffles.  Digests with more
than ``max(hot_rows, rows / 1000)`` copies, of which there are at most a thousand,
are joined by broadcast; where texts meet, their copies are spread by a salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Work, may_be_among

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _locator(docs: DataFrame) -> Column:
    """The file a row lies in; empty where rows come from a join, for which Spark has no single file."""
    from pyspark.errors import AnalysisException

    try:
        docs.select(F.input_file_name()).schema  # noqa: B018
    except AnalysisException:
        return F.lit("").alias("locator")
    return F.input_file_name().alias("locator")


def _run_stream(spark: SparkSession, arrivals: str, checkpoint: str, files: int) -> None:
    schema = "doc_id long, row long, locator string, digest binary, n_bytes int"
    stream = (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(arrivals)
    )
    state = stream.groupBy("digest", "n_bytes").agg(
        F.max(F.struct("doc_id", "row", "locator")).alias("keeper"), F.count(F.lit(1)).alias("n")
    )
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    row_col: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int = 10_000,
    hot_rows: int = 1000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, keep_locator, row.

    ``row`` is ``row_col``, a key of the rows, if there is one, else a number given here.

    ``digest`` gives the state's key; the answer doesn't depend on it.
    """
    work = Work(spark, "exact_dedup")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _locator(docs),
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")).alias("row"),
    )
    arrivals = work.save(
        base.select(
            "doc_id",
            "row",
            "locator",
            digest(F.col("text")).alias("digest"),
            F.octet_length("text").cast("int").alias("n_bytes"),
            *([] if digest is sha256 else [sha256(F.col("text")).alias("sha")]),
        ),
        "arrivals",
    )
    if not arrivals.take(1):
        return arrivals.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes", F.col("locator").alias("keep_locator"), "row",
        )
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    _run_stream(spark, f"{work.path}/arrivals", f"{work.path}/state", files_per_trigger)
    raw = spark.read.format("statestore").load(f"{work.path}/state")
    keeper, n = raw.schema["value"].dataType.names
    state = work.save(
        raw.select("key.*", F.col(f"value.{keeper}.doc_id").alias("keep_id"), F.col(f"value.{keeper}.row").alias("keep_row"),
                   F.col(f"value.{keeper}.locator").alias("keep_locator"), F.col(f"value.{n}").alias("n")),
        "keys",
    )
    work.drop("state")
    rows = state.agg(F.sum("n")).first()[0]
    limit = max(hot_rows, rows // 1000)
    hot = state.where(F.col("n") > limit)  # at most rows / limit <= 1000 of them
    key = ["digest", "n_bytes"]

    # Full bytes of every hit against the retained row's.
    hits = state.where("n > 1")
    seen = may_be_among(base.select("doc_id", "text"), digest(F.col("text")), hits, "digest")
    seen = seen.withColumn("digest", digest(F.col("text"))).withColumn("n_bytes", F.octet_length("text").cast("int"))
    parts = F.expr(f"cast(ceil(n / {limit}) as int)")
    kept_text = (
        seen.withColumnRenamed("text", "keep_text")
        .join(hits.select(*key, "keep_id", "n"), key)
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(*key).agg(F.min("keep_text").alias("keep_text"), F.first("n").alias("n"))
        .select(*key, "keep_text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    spread = (
        seen.join(F.broadcast(hot.select(*key, parts.alias("parts"))), key, "left")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.coalesce("parts", F.lit(1))).cast("int"))
    )
    collided = work.save(spread.join(kept_text, [*key, "part"]).where("text != keep_text").select(*key).distinct(), "collided")

    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes", "keep_locator", "row"]

    def answer(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, key).select(
            "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex(sha)).alias("text_sha256"), "n_bytes", "keep_locator", "row",
        )

    some = bool(collided.take(1))
    plain = arrivals.join(collided, key, "left_anti") if some else arrivals
    result = answer(plain, F.broadcast(hot)).unionByName(
        answer(plain.join(F.broadcast(hot.select(*key)), key, "left_anti"), state.where(F.col("n") <= limit))
    )
    if some:
        again = base.withColumn("digest", digest(F.col("text"))).withColumn("n_bytes", F.octet_length("text").cast("int"))
        again = work.save(
            again.join(collided, key, "left_semi"),
            "again",
        )
        by_text = again.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "row", "locator")).alias("k"), F.count(F.lit(1)).alias("n"))
        result = result.unionByName(
            again.join(by_text, ["digest", "text"]).select(
                "doc_id", F.col("k.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("k.row")).alias("kept"),
                F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_bytes", F.col("k.locator").alias("keep_locator"), "row",
            )
        )
    return result.select(*columns)
