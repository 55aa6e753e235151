"""Arrow batches through a Python function, for operators whose inner loop is Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], schema: str) -> DataFrame:
    """Each batch through the function that ``make`` builds once per task; it returns the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every value, null as empty, without decoding."""
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())
