"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass.  Their cost and selectivity are measured
on a sample; the cascade then asks them in order of rejection per second and stops
at the first that rejects.  The order changes what is computed, never the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: a null or wordless text has no
word and fails the base rule; repeated rows are judged each; an empty table gives an
empty result.  Extra columns aren't read.  Memory is that of one Arrow batch.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches, texts

SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x < 91)
_NOT_LETTER = bytes(x for x in range(256) if x not in range(65, 91) and x not in range(97, 123))
_NOT_DIGIT = bytes(x for x in range(256) if not 48 <= x < 58)
_NOT_SYMBOL = bytes(x for x in range(256) if x not in SYMBOLS)
_TAIL = bytes(range(128, 192))  # continuation bytes of UTF-8


@dataclass
class Text:
    raw: bytes
    words: list[bytes]
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_lines: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    extra: dict = field(default_factory=dict)


def measure(raw: bytes) -> Text:
    words = raw.split()
    t = Text(raw, words, len(words))
    t.word_chars = sum(map(len, words)) - (0 if raw.isascii() else len(raw) - len(raw.translate(None, _TAIL)))
    t.n_symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    t.n_lines, t.n_dup_lines = len(lines), len(lines) - len(set(lines))
    t.n_repeat_words = repeat_words(words)
    return t


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pair = a[:-2] * len(ids) + a[1:-1]
    if len(ids) < 1 << 20:
        key = pair * len(ids) + a[2:]
    else:  # too many words for one 64-bit number
        _, small = np.unique(pair, return_inverse=True)
        key = small.astype(np.int64) * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _upper(t: Text) -> bool:
    return 2 * len(t.raw.translate(None, _NOT_UPPER)) > len(t.raw.translate(None, _NOT_LETTER)) > 0


def _digits(t: Text) -> bool:
    return 5 * len(t.raw.translate(None, _NOT_DIGIT)) > t.word_chars


def _letterless(t: Text) -> bool:
    return 10 * sum(1 for w in t.words if w.translate(None, _LETTERS) == w) > 4 * t.n_words


def _top_word(t: Text) -> bool:
    return 10 * max(Counter(t.words).values(), default=0) > 4 * t.n_words


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("upper_case", _upper),
    Rule("digits", _digits),
    Rule("exclamation", lambda t: 10 * t.raw.count(b"!") > 3 * t.n_words),
    Rule("letterless_words", _letterless),
    Rule("top_word", _top_word),
)


def order_rules(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> tuple[list[int], list[tuple[str, float, float]]]:
    """Rule indexes by rejection per second on ``sample``, and (name, seconds a text, share rejected)."""
    measured = [t for t in map(measure, sample) if not base_failed(t)]
    report = []
    for r in rules:
        began = time.perf_counter()
        rejected = sum(r.rejects(t) for t in measured)
        spent = time.perf_counter() - began
        n = max(1, len(measured))
        report.append((r.name, max(spent / n, 1e-9), rejected / n))
    order = sorted(range(len(rules)), key=lambda i: (-report[i][2] / report[i][1], report[i][1]))
    return order, report


def apply_quality_rules(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 1000, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept, rejected_by (the first rule that rejected, in the cascade's order)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = [(r[0] or "").encode() for r in narrow.select("text").limit(sample_rows).collect()]  # only orders the rules
    order, _ = order_rules(sample, rules)

    def make() -> Callable:
        cascade = [rules[i] for i in order]

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            rows: list[tuple] = []
            for raw in texts(batch.column(1)):
                t = measure(raw)
                failed = base_failed(t)
                by = "base" if failed else next((r.name for r in cascade if r.rejects(t)), None)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
            return {"doc_id": batch.column(0)} | {k: pa.array(c, kind) for k, c, kind in zip(names, cols, kinds)}

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return map_batches(narrow, make, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY 1),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, a, count(*) AS n FROM pos GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(top.n, 0) AS top_word,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letterless,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^!]', '', 'g')) AS bangs
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
  OR (2 * upper > letters AND letters > 0) OR 5 * digits > word_chars OR 10 * bangs > 3 * n_words OR 10 * letterless > 4 * n_words OR 10 * top_word > 4 * n_words) AS kept FROM f
"""
