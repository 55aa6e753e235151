"""The crawls and entries tables: typed, append-only, with the relational guards a file store lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWLS = "crawl_id long, crawl_time double, source_url string, category string, fetch_success boolean"


def entries_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("source_crawl_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_ids(rows: DataFrame, name: str, last: int, *order: str) -> DataFrame:
    """Dense ids after ``last``."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") + last)


def set_category(crawls: DataFrame, found: DataFrame, key: str = "crawl_id") -> DataFrame:
    """``found`` (key, category) wins where it has a category."""
    new = found.select(key, F.col("category").alias("new_category"))
    return crawls.join(new, key, "left").withColumn("category", F.coalesce("new_category", "category")).drop("new_category")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """``child`` without the rows of ``deleted`` parents."""
    return child.join(deleted.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
