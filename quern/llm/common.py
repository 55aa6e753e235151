"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor only costs
the tasks it was running.  Where the setting is absent, a folder of this machine
is used in local mode (tests), and anything else is refused.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The membership filter has 128 bits a key, within these bounds (16 MB, so it may be broadcast).  Where the larger
#: bound leaves less than 8 bits a key a filter tells little, and the join is done without it.
KEY_BITS, LEAST_BITS, MOST_BITS = (8, 128), 1 << 15, 1 << 27
_SEGMENT = 32768
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """A private folder of one run, with tables that are written once and read back."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that every executor shares")
            base = os.path.join(tempfile.gettempdir(), f"quern-{os.getuid()}")
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table and read it back; the shuffle files of its plan go once it is written."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def filter_bits(keys: DataFrame) -> int:
    """Bits for the filter of ``keys``, a power of two; 0 if there are too many keys for one."""
    n = keys.count()
    return 0 if KEY_BITS[0] * n > MOST_BITS else min(MOST_BITS, max(LEAST_BITS, 1 << max(0, KEY_BITS[1] * n - 1).bit_length()))


def filter_rows(keys: DataFrame, key: Column | str, bits: int) -> DataFrame:
    """At most 4096 rows of 4 KB each: which of ``bits`` hash cells ``key`` takes in ``keys``."""
    cell = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    return keys.select(cell.alias("cell")).groupBy(F.expr(f"cell div {_SEGMENT}").alias("q_segment")).agg(
        F.expr(f"bitmap_construct_agg(cell % {_SEGMENT})").alias("q_bits")
    )


def bit_set(bits: str, at: str) -> Column:
    """Whether the bitmap in column ``bits`` has the bit that the SQL expression ``at`` gives; null without a bitmap."""
    return F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast(({at}) div 8 as int) + 1, 1)), 16, 10) as int), cast(({at}) % 8 as int)) & 1 = 1")


def _packed(df: DataFrame, key: Column) -> DataFrame:
    """All columns as one, so that no name can clash, and the key."""
    return df.select(F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns))).alias("q_row"), key.alias("q_key"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*(F.col("q_row")[f"c{i}"].alias(c) for i, c in enumerate(columns)))


def _marked(packed: DataFrame, rows: DataFrame, bits: int) -> DataFrame:
    cell = F.xxhash64("q_key").bitwiseAND(F.lit(bits - 1))
    at = packed.withColumn("q_cell", cell).withColumn("q_segment", F.expr(f"q_cell div {_SEGMENT}"))
    return at.join(F.broadcast(rows), "q_segment", "left").withColumn("q_maybe", F.coalesce(bit_set("q_bits", f"q_cell % {_SEGMENT}"), F.lit(False)))


def may_be_among(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose key is, or by a filter might be, in ``wanted[column]``; nothing is shuffled."""
    bits = filter_bits(wanted)
    if not bits:
        return df
    return _unpacked(_marked(_packed(df, key), filter_rows(wanted, column, bits), bits).where("q_maybe"), df.columns)


def among(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted[column]``; only rows that a filter lets through are shuffled."""
    bits = filter_bits(wanted)
    packed = _packed(df, key)
    if bits:
        packed = _marked(packed, filter_rows(wanted, column, bits), bits).where("q_maybe").select("q_row", "q_key")
    return _unpacked(packed.join(wanted.select(F.col(column).alias("q_key")), "q_key", "left_semi"), df.columns)


def without(df: DataFrame, key: Column, dropped: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``dropped[column]``.

    Rows that the membership filter clears don't take part in the join, so only about as many rows as
    are dropped get shuffled.  A null key is never dropped.
    """
    bits = filter_bits(dropped)
    packed, gone = _packed(df, key), dropped.select(F.col(column).alias("q_key"))
    if not bits:
        return _unpacked(packed.join(gone, "q_key", "left_anti"), df.columns)
    marked = _marked(packed, filter_rows(dropped, column, bits), bits)
    clear = marked.where(~F.col("q_maybe")).select("q_row")
    return _unpacked(clear.unionByName(marked.where("q_maybe").select("q_row", "q_key").join(gone, "q_key", "left_anti").select("q_row")), df.columns)


def one_per_key(df: DataFrame, key: Column) -> DataFrame:
    """One row of ``df`` for each value of ``key``."""
    return _unpacked(_packed(df, key).dropDuplicates(["q_key"]), df.columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
