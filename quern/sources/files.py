"""Files beside the store: URL lists, query templates, labelled CSVs and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What Python's str.strip takes for white space.
_BLANK = r"[\s\x1C-\x1F\x85   -     　]+"


def stripped(text: Column) -> Column:
    """``text`` without white space of any script at its ends."""
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line): stripped lines that aren't blank; ``ord`` rises in the order of each file's lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), stripped(F.col("value")).alias("line"))
    return rows.where("line != ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select("ord", F.col("line").alias("url"))


def read_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(t_ord, template) and (l_ord, location) of a file of lines; lines that begin with # are comments."""
    lines = read_lines(spark, path).where("not startswith(line, '#')")
    place = F.lower("line").startswith("location:")
    locations = lines.where(place).select(F.col("ord").alias("l_ord"), stripped(F.expr("substring(line, 10)")).alias("location"))
    return lines.where(~place).select(F.col("ord").alias("t_ord"), F.col("line").alias("template")), locations


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Quoted CSV with a header; a quote inside a field is doubled."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_gold(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """Labelled rows: every field stripped, missing ones empty, rows without a key left out."""
    raw = read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns))
    return raw.select(*(stripped(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in columns)).where(F.col(f"`{key}`") != "")


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path whose name is lexically largest among those that match; names begin with a time stamp."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    paths = [s.getPath() for s in found or []]
    return max(paths, key=lambda p: p.getName()).toString() if paths else None
