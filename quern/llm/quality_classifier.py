"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are columns.  Boosted trees over them give paths,
each a conjunction of comparisons; a logistic regression with an L1 penalty
weighs them, and the rules that keep a weight compile into one Spark column
expression, so scoring is an ordinary projection over the statistics.

Labels come only from rows outside the held-out fold (crc32 of the id modulo 3 is
1), at most ``train_rows`` of them by hash of the id: the documented bound.
Defined results: a null text counts as empty and is scored as such; repeated rows
get equal scores; with no labels, or labels of one kind only, every score is the
share of label 1 (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches, texts
from quern.llm.trees import boost, lasso_logistic

FEATURES = (
    "words", "word_length", "symbols", "upper", "digits", "punctuation", "exclamation", "pipes", "wide", "distinct_words", "dup_lines", "line_words",
    "lone_words", "top_byte",
)
_CLASS = {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789", "exclamation": b"!", "pipes": b"|",
    "punctuation": b".,;:?'\"()-", "tail": bytes(range(128, 192)), "lead": bytes(range(192, 256)),
}
_WEIGHTS = np.stack([np.isin(np.arange(256), list(v)) for v in _CLASS.values()], axis=1).astype(np.float64)


def statistics(raw: bytes) -> list[float]:
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    c = dict(zip(_CLASS, counts @ _WEIGHTS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = max(1.0, sum(map(len, words)) - c["tail"])
    letters = max(1.0, c["upper"] + c["lower"] + c["lead"])
    per = max(1, n)
    return [
        float(n), chars / per, c["symbols"] / per, c["upper"] / letters, c["digits"] / chars, c["punctuation"] / per, c["exclamation"] / per,
        c["pipes"] / per, c["lead"] / chars, len(set(words)) / per, (len(lines) - len(set(lines))) / max(1, len(lines)), n / max(1, len(lines)),
        sum(len(w) == 1 for w in words) / per, float(counts[33:].max() / chars) if n else 0.0,
    ]


def with_statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[tuple[str, str], ...] = (("doc_id", "long"),)) -> DataFrame:
    """The columns ``keep`` (name, type) and the statistics, one column each."""
    narrow = docs.select(*(F.col(c).cast(t).alias(c) for c, t in keep), F.col(text_col).cast("string").alias("text_"))

    def make() -> Callable:
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            rows = np.array([statistics(raw) for raw in texts(batch.column(len(keep)))], dtype=np.float64).reshape(-1, len(FEATURES))
            return {c: batch.column(i) for i, (c, _) in enumerate(keep)} | {f"f_{f}": pa.array(rows[:, i]) for i, f in enumerate(FEATURES)}

        return step

    return map_batches(narrow, make, ", ".join([*(f"{c} {t}" for c, t in keep), *(f"f_{f} double" for f in FEATURES)]))


class RuleModel:
    """Weighted conjunctions of (feature, value <= threshold?, threshold)."""

    def __init__(self, rules: list[tuple[tuple[tuple[int, bool, float], ...], float]], bias: float) -> None:
        self.rules, self.bias = rules, bias

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for path, w in self.rules:
            z += w * _holds(x, path)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z: Column = F.lit(float(self.bias))
        for path, w in self.rules:
            cond = F.lit(True)
            for f, below, t in path:
                c = F.col(f"f_{FEATURES[f]}")
                cond = cond & ((c <= t) if below else (c > t))
            z = z + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(x: np.ndarray, path: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, below, t in path:
        out &= (x[:, f] <= t) == below
    return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return RuleModel([], float(np.log(p / (1 - p))))
    forest = boost(x, y, trees=trees, depth=depth)
    seen: dict[bytes, tuple] = {}
    for tree in forest.trees:
        for path in tree.paths():
            merged: dict[tuple[int, bool], float] = {}
            for f, below, t in path:  # one bound per feature and side
                was = merged.get((f, below))
                merged[(f, below)] = t if was is None else (min if below else max)(was, t)
            path = tuple(sorted((f, below, t) for (f, below), t in merged.items()))
            column = _holds(x, path)
            if 0 < column.sum() < len(x):
                key = np.packbits(column).tobytes()
                if key not in seen or len(path) < len(seen[key]):
                    seen[key] = path
    paths = sorted(seen.values())
    w, bias = lasso_logistic(np.stack([_holds(x, q) for q in paths], axis=1), y, penalty=penalty)
    return RuleModel([(q, float(v)) for q, v in zip(paths, w) if v], bias)


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", train_rows: int = 4000) -> RuleModel:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("i").cast("string").cast("binary")) % 3 != 1).groupBy("i").agg(F.max("y").alias("y"))
    some = known.orderBy(F.xxhash64("i"), "i").limit(train_rows)  # at most train_rows of 12 bytes
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(some), "i")
    stats = with_statistics(rows, text_col="t", keep=(("i", "long"), ("y", "int"))).collect()
    stats.sort(key=lambda r: (r["i"], *r[2:]))
    x = np.array([r[2:] for r in stats], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in stats], dtype=np.float64))


def classify_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", train_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, text_col=text_col, id_col=id_col, train_rows=train_rows)
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_statistics(renamed).withColumn("score", model.column())
    return scored.select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
