"""URL columns, following urllib.parse where Spark's own parser would give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """The authority: host with user and port, case kept; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def is_crawlable(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (domain(url) != "")


def url_label(url: Column, most: int = 40) -> Column:
    """What follows the last double slash, cut to ``most`` characters."""
    return F.substring(F.substring_index(url, "//", -1), 1, most)


def fill_template(template: Column, location: Column) -> Column:
    """The location in place of its mark, or appended after a blank."""
    mark = "{location}"
    return F.when(F.contains(template, F.lit(mark)), F.replace(template, F.lit(mark), location)).otherwise(F.concat_ws(" ", template, location))
