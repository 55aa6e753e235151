"""Search providers: what answers a query with URLs.

A provider yields responses page by page; parsing a response is relational, so any
table of (query, response) can be searched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SearchProvider(Protocol):
    def search(self, query: str, max_results: int) -> list[str]: ...


class PagedProvider:
    """Pages of at most ``page_size`` items; ends at a short or empty page, or at ``max_results`` URLs."""

    def __init__(self, fetch: Callable[[str, int, int], list[dict]], page_size: int = 10) -> None:
        self.fetch, self.page_size = fetch, page_size

    def search(self, query: str, max_results: int) -> list[str]:
        urls: list[str] = []
        start = 1
        while len(urls) < max_results:
            n = min(self.page_size, max_results - len(urls))
            items = self.fetch(query, start, n)
            urls += [x["link"] for x in items if x.get("link")]
            if len(items) < n:
                break
            start += len(items)
        return urls[:max_results]


class JsonProvider:
    """Walks ``results_path`` (dotted) of a JSON answer to a list, and takes ``url_field`` of its objects."""

    def __init__(self, fetch: Callable[[str], Any], results_path: str, url_field: str) -> None:
        self.fetch, self.path, self.url_field = fetch, [x for x in results_path.split(".") if x], url_field

    def search(self, query: str, max_results: int) -> list[str]:
        node = self.fetch(query)
        for step in self.path:
            node = node.get(step) if isinstance(node, dict) else None
        items = node[:max_results] if isinstance(node, list) else []
        return [x[self.url_field] for x in items if isinstance(x, dict) and x.get(self.url_field)]


def response_urls(response: Column, results_path: str, url_field: str, max_results: int) -> Column:
    """The same walk over a column of JSON texts, JVM-side; an answer that isn't so shaped gives an empty array."""
    path = "$" + "".join(f"['{x}']" for x in results_path.split(".") if x)
    items = F.try_variant_get(F.try_parse_json(response), path, "array<variant>")
    first = F.slice(F.coalesce(items, F.array().cast("array<variant>")), 1, max_results)
    urls = F.transform(first, lambda x: F.try_variant_get(x, f"$['{url_field}']", "string"))
    return F.filter(urls, lambda u: u.isNotNull() & (u != ""))


def discover(queries: DataFrame, provider: SearchProvider, max_results: int = 10, pause: float = 0.0) -> DataFrame:
    """(query, url, error): one row per URL found; a query that fails gives one row with its error.

    ``pause`` seconds pass between the calls of one partition, none after its last.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        called = False
        for batch in batches:
            out = []
            for q in batch["query"]:
                if called and pause:
                    time.sleep(pause)
                called = True
                try:
                    out += [(q, u, None) for u in provider.search(q, max_results)]
                except Exception as e:  # one query's failure isn't the batch's
                    out.append((q, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["query", "url", "error"])

    return queries.select("query").mapInPandas(run, "query string, url string, error string")

