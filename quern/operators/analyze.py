"""Categorising pages and extracting records from them, with a pluggable completion backend."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.config import Category, CrawlConfig, category_rows, spark_type

_BACKENDS: dict[Any, Any] = {}


class Backend(Protocol):
    """Completes a chat; ``labels`` or ``schema`` bound what it may answer."""

    def complete(self, messages: list[dict], labels: list[str] | None = None, schema: dict | None = None, max_tokens: int | None = None) -> str: ...


class RuleBackend:
    """Deterministic stand-in: the first label that the text contains, else the last; ``field: value`` lines as a record."""

    def complete(self, messages: list[dict], labels: list[str] | None = None, schema: dict | None = None, max_tokens: int | None = None) -> str:
        text = messages[-1]["content"]
        if labels:
            low = text.lower()
            return next((x for x in labels if x.lower() in low), labels[-1])
        one = (schema or {}).get("items", schema or {})
        record = {}
        for name in one.get("properties", {}):
            found = re.search(rf"^{re.escape(name)}: *(.*)$", text, re.M)
            record[name] = found[1].strip() if found else None
        return json.dumps([record] if (schema or {}).get("type") == "array" else record)


def backend(make: Callable[[str, int], Backend], path: str, context: int) -> Backend:
    """One backend per worker process and (path, context)."""
    key = (make, path, context)
    if key not in _BACKENDS:
        _BACKENDS[key] = make(path, context)
    return _BACKENDS[key]


def rule_backend(path: str, context: int) -> Backend:
    return RuleBackend()


def _messages(prompt: str, text: str) -> list[dict]:
    return [{"role": "system", "content": prompt}, {"role": "user", "content": f"Text:\n{text}"}]


def _answers(ask: Callable[[str], str | None]) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                try:
                    out.append((ask(text) if text else None, None))
                except Exception as e:  # one page's failure isn't the job's
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["value", "error"])

    return run


def categorized(pages: DataFrame, text: Column, config: CrawlConfig, make: Callable[[str, int], Backend] = rule_backend) -> DataFrame:
    """``pages`` with category (null for empty texts, failures, and answers that name no category) and category_error."""
    names = [c.name for c in config.categories]
    prompt, path, context, most = config.category_prompt, config.category_model_path, config.category_context, config.category_max_tokens
    ask = lambda t: backend(make, path, context).complete(_messages(prompt, t), labels=names, max_tokens=most)
    run = F.pandas_udf(_answers(ask), "value string, error string", F.PandasUDFType.SCALAR_ITER)
    out = pages.withColumn("q_answer", run(text))
    value = F.trim(F.col("q_answer.value"))
    return out.withColumn("category", F.when(value.isin(*names), value)).withColumn("category_error", F.col("q_answer.error")).drop("q_answer")


def with_dimension(pages: DataFrame, spark: SparkSession, config: CrawlConfig) -> DataFrame:
    """``pages`` (category, ...) with is_relevant, process_links and is_list of the category, false where it has none."""
    rows = spark.createDataFrame(category_rows(config), "category string, is_relevant boolean, process_links boolean, is_list boolean")
    joined = pages.join(F.broadcast(rows), "category", "left")  # as many rows as the configuration has categories
    return joined.na.fill(False, ["is_relevant", "process_links", "is_list"])


def extracted(pages: DataFrame, text: Column, links: Column, category: Category, make: Callable[[str, int], Backend] = rule_backend) -> DataFrame:
    """Rows of a relevant category with records (array of the category's struct), their JSON, and links where it follows them.

    A page whose answer isn't of the schema has null records; so does every page of an irrelevant category.
    """
    if not category.is_relevant:
        return pages.withColumns({"records": F.lit(None).cast("array<string>"), "extract_error": F.lit(None).cast("string"), "found_links": F.array().cast("array<string>")})
    prompt, path, context, most, schema = category.prompt, category.model_path, category.context, category.max_tokens, category.fields
    ask = lambda t: backend(make, path, context).complete(_messages(prompt, t), schema=schema, max_tokens=most)
    run = F.pandas_udf(_answers(ask), "value string, error string", F.PandasUDFType.SCALAR_ITER)
    kind = spark_type(schema)
    parsed = F.from_json(F.col("q_answer.value"), kind)
    out = pages.withColumn("q_answer", run(text)).withColumn("records", parsed if category.is_list else F.when(parsed.isNotNull(), F.array(parsed)))
    out = out.withColumn("extract_error", F.col("q_answer.error")).drop("q_answer")
    return out.withColumn("found_links", links if category.process_links else F.array().cast("array<string>"))
