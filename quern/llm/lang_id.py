"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its byte 3-grams and
4-grams (words joined by single spaces, ASCII letters lower-cased), each hashed into a bucket.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample (``train_rows`` texts).  Probabilities are calibrated by
a temperature, and a rejection threshold is set so that accepted predictions of
the calibration part reach ``target`` accuracy.

Defined results: ``und`` with score 0 for a null text or one without a letter;
otherwise always a learned language (``accepted`` tells whether the score passes
the threshold).  Repeated rows get equal results; an empty table gives an empty
one.  With no usable training row all is ``und``.  Texts are read whole, in slices
of bounded memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches, texts

BUCKETS, DIM, SIZES = 1 << 16, 12, (3, 4)
_FOLD = np.array([32 if x <= 32 else x + 32 if 65 <= x <= 90 else x for x in range(256)], dtype=np.uint8)
_SLICE = 1 << 20


def buckets_of(raw: bytes, at: int = 0, most: int = _SLICE) -> np.ndarray:
    """Buckets of the n-grams that begin in ``raw[at : at + most]``."""
    b = _FOLD[np.frombuffer(raw, dtype=np.uint8)[at : at + most + max(SIZES) - 1]].astype(np.uint32)
    out = []
    for n in SIZES:
        k = min(most, len(b) - n + 1)
        if k <= 0:
            continue
        h = b[:k] * np.uint32(0x9E3779B1)
        for j in range(1, n):
            h = (h ^ b[j : j + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def is_held_out(doc_id: int | None, folds: int = 5, fold: int = 0) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


#: A threshold that no score reaches: where the target can't be met, every prediction is rejected.
NEVER = 2.0


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, max(len(text), 1), _SLICE):
            ids = buckets_of(text, at)
            total += self.logits[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        z = self.raw(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(rows: list[tuple[bytes, str]], *, epochs: int = 6, rate: float = 0.5, seed: int = 7, target: float = 0.99) -> Model | None:
    """Rows of (text, language); a fifth of them calibrates."""
    rows = [(t, y) for t, y in rows if t]
    langs = sorted({y for _, y in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = len(rows) // 5 if len(rows) >= 20 else 0
    fit, held = rows[cut:], rows[:cut]
    emb = rng.uniform(-0.1, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    steps, done = epochs * len(fit), 0
    grams = [np.unique(np.concatenate([buckets_of(t, a) for a in range(0, max(len(t), 1), _SLICE)]), return_counts=True) for t, _ in fit]
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, counts = grams[i]
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            v = share @ emb[ids]
            z = v @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[langs.index(fit[i][1])] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = w @ p
            w -= step * np.outer(v, p).astype(np.float32)
            bias -= step * 0.05 * p.astype(np.float32)
            emb[ids] -= step * 20 * share[:, None] * back[None, :].astype(np.float32)
            done += 1
    model = Model(langs, np.ascontiguousarray((emb @ w).astype(np.float32)), bias.astype(np.float64))
    if held:
        z = np.array([model.raw(t) for t, _ in held])
        y = np.array([langs.index(k) if k in langs else -1 for _, k in held])
        best = (np.inf, 1.0)
        for temp in np.geomspace(0.05, 20, 60):
            s = z / temp
            s = s - s.max(axis=1, keepdims=True)
            logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
            best = min(best, (-logp[np.arange(len(y)), y].mean(), float(temp)))
        model.temperature = best[1]
        pairs = sorted(((p, k == yy) for (k, p), (_, yy) in ((model.predict(t), r) for t, r in zip((t for t, _ in held), held))), reverse=True)
        right, model.threshold = 0, NEVER
        for i, (p, ok) in enumerate(pairs, 1):
            right += ok
            tied = i < len(pairs) and pairs[i][0] == p  # a threshold can't part equal scores
            if not tied and right / i >= target:
                model.threshold = p
    return model


def training_rows(docs: DataFrame, *, text_col: str, id_col: str, lang_col: str, rows: int) -> list[tuple[bytes, str]]:
    """At most ``rows`` (text, language) of documents outside the held-out fold, by hash of the id: the documented bound."""
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    learn = learn.select(F.xxhash64(id_col).alias("k"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    edge = [r[0] for r in learn.select("k").orderBy("k").limit(rows).collect()]
    if not edge:
        return []
    picked = learn.where(F.col("k") <= edge[-1]).orderBy("k", "i").limit(rows).collect()
    return [((r["t"] or "").encode(), r["y"]) for r in picked]


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    text = F.col(text_col).cast("string")
    lettered = F.coalesce(text, F.lit("")).rlike("\\p{L}")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(lettered, text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages x 4 bytes

    def make() -> Callable:
        m = shared.value

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            found = [("und", 0.0) if not t or m is None else m.predict(t) for t in texts(batch.column(1))]
            limit = m.threshold if m else 0.0
            return {
                "doc_id": batch.column(0),
                "held_out": pa.array([is_held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()),
                "lang_pred": pa.array([k for k, _ in found], pa.string()),
                "score": pa.array([p for _, p in found], pa.float64()),
                "accepted": pa.array([k != "und" and p >= limit for k, p in found], pa.bool_()),
            }

        return step

    return map_batches(narrow, make, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def detect_language(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", train_rows: int = 3000) -> DataFrame:
    rows = training_rows(docs, text_col=text_col, id_col=id_col, lang_col=lang_col, rows=train_rows)
    return identify(docs, train(rows), text_col=text_col, id_col=id_col)
