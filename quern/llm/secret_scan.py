"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: an OR of ANDs
that every match must satisfy.  The index holds, per segment of documents and per
trigram that some rule asks for, a bitmap of the documents with it.  Queries are
answered by ANDing and ORing bitmaps; only candidates are then matched against
the regex.  A rule from which no trigram follows (hex) scans every document.

A document's place in the index is the hash of its text, so the index needs no row
numbers that could change when a lost task runs again, and equal texts share a
place.  Two texts that share a place by chance only add a candidate.

Spans are leftmost and non-overlapping per kind, in code points, end exclusive;
matches whose measured group is shorter than the rule's minimum are consumed but
not reported.  Defined results: a null text counts as empty and has no span;
repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Work, bit_set, quoted
from quern.llm.ngram_join import lower_ascii

BITS, FILL = 32768, 16384
#: Candidate bitmaps are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 32 << 20
_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0
    probe: str = ""  # a cheaper regex that every match implies
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)

#: More alternatives than this of one literal run are cut before they multiply further.
_MOST_EXACT, _MOST_TERMS = 8, 64


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that any match contains; empty: nothing follows."""
    parser = re._parser  # type: ignore[attr-defined]

    def exact(items: list) -> set[str] | None:
        """All strings of a sequence, where they are few."""
        out = {""}
        for item in items:
            more = one(item)
            if more is None or len(out) * len(more) > _MOST_EXACT:
                return None
            out = {a + b for a, b in product(out, more)}
        return out

    def one(item: tuple) -> set[str] | None:
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return {chr(arg).lower()} if arg < 128 else None
        if op == "IN" and all(str(k) == "LITERAL" and v < 128 for k, v in arg) and len(arg) <= _MOST_EXACT:
            return {chr(v).lower() for _, v in arg}
        if op == "SUBPATTERN":
            return exact(list(arg[-1]))
        if op == "BRANCH":
            parts = [exact(list(x)) for x in arg[1]]
            return None if None in parts else set().union(*parts)  # type: ignore[arg-type]
        if op == "MAX_REPEAT" and arg[1] == 1:
            inner = exact(list(arg[2]))
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        if op == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
            return exact(list(arg[2]) * int(arg[0]))
        if op == "AT":
            return {""}
        return None

    def conj(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
        if not a or not b or len(a) * len(b) > _MOST_TERMS:
            return a or b
        return list({x | y for x, y in product(a, b)})

    def terms(run: set[str]) -> list[frozenset[str]]:
        if any(len(s) < 3 for s in run):
            return []
        return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)]

    def query(items: list) -> list[frozenset[str]]:
        out: list[frozenset[str]] = []
        run = {""}
        for item in items:
            more = one(item)
            if more is not None and len(run) * len(more) <= _MOST_EXACT:
                run = {a + b for a, b in product(run, more)}
                continue
            out, run = conj(out, terms(run)), {""}
            if more is not None:
                run = more
                continue
            op, arg = str(item[0]), item[1]
            if op == "SUBPATTERN":
                out = conj(out, query(list(arg[-1])))
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                out = conj(out, query(list(arg[2])))
            elif op == "BRANCH":
                parts = [query(list(x)) for x in arg[1]]
                out = conj(out, [t for p in parts for t in p] if all(parts) else [])
        return conj(out, terms(run))

    return sorted(query(list(parser.parse(regex))), key=sorted)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of one rule's matches, in linear time."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    measured = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    gaps = F.split(text, rule.regex, -1)
    rows = F.zip_with(
        F.zip_with(whole, measured, lambda a, b: F.struct(F.length(a).alias("n"), (F.length(b) >= rule.least).alias("ok"))),
        F.slice(gaps, 1, F.size(whole)),
        lambda m, g: F.struct(F.length(g).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")),
    )
    kind = "array<struct<s:int,e:int,ok:boolean>>"

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + m["n"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + m["gap"]).alias("s"), (acc["at"] + m["gap"] + m["n"]).alias("e"), m["ok"].alias("ok"))),
                ).alias("out"),
            ),
        )

    # Blocks, so that appending doesn't copy all spans found so far.
    count = F.floor((F.size(rows) + _BLOCK - 1) / _BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.slice(rows, (k - 1) * _BLOCK + 1, F.lit(_BLOCK)))
    blocks = F.when(F.size(rows) > _BLOCK, cut).otherwise(F.array(rows))
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, block: F.transform(
            F.array(within(block, acc["at"])), lambda w: F.struct(w["at"].alias("at"), F.concat(acc["out"], F.array(w["out"])).alias("out"))
        )[0],
        lambda acc: F.flatten(acc["out"]),
    )
    return F.transform(F.filter(joined, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _labelled(hits: Column, k: int) -> Column:
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def build_index(work: Work, docs: DataFrame, trigrams: list[str], segments: int) -> DataFrame:
    """Postings (segment, trigram, bits), written to the shared folder."""
    low = docs.select("segment", "bit", lower_ascii(F.col("text")).alias("low"))
    found = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))), lambda x: x.isNotNull())
    rows = low.select("segment", "bit", F.explode_outer(found).alias("trigram"))  # outer: else the array is computed twice
    return work.save(rows.where("trigram is not null").groupBy("segment", "trigram").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), "index")


def scan_secrets(
    spark: SparkSession, docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    found_col: str = "found",
) -> DataFrame:
    """The columns ``keep`` of every row and ``found_col``: array of (s, k, e), k the rule's index, sorted."""
    work = Work(spark, "secret_scan")
    queries = {k: trigram_query(r.regex) for k, r in enumerate(rules)}
    trigrams = sorted({t for q in queries.values() for term in q for t in term})
    segments = max(1, -(-docs.count() // FILL))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.xxhash64(text)
    placed = docs.select(
        *(quoted(c).alias(f"keep_{i}") for i, c in enumerate(keep)), text.alias("text"), F.pmod(place, F.lit(segments)).alias("segment"),
        F.pmod(F.expr(f"shiftright(xxhash64(3, coalesce(cast(`{text_col}` as string), '')), 8)"), F.lit(BITS)).alias("bit"),
    )
    indexed = [k for k, q in queries.items() if q]
    if indexed:
        index = build_index(work, placed, trigrams, segments)
        values = ", ".join(f"({k}, {j}, {trigrams.index(t)}, {len(term)})" for k in indexed for j, term in enumerate(queries[k]) for t in sorted(term))
        wanted = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS w(rule, term, trigram, needed)"))
        per_term = index.join(wanted, "trigram").groupBy("segment", "rule", "term").agg(
            F.expr("bitmap_and_agg(bits)").alias("bits"), F.count(F.lit(1)).alias("have"), F.first("needed").alias("needed")
        )
        per_rule = per_term.where("have = needed").groupBy("segment", "rule").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        candidates = work.save(per_rule.groupBy("segment").agg(*(F.first(F.when(F.col("rule") == k, F.col("bits")), True).alias(f"bits_{k}") for k in indexed)), "candidates")
        work.drop("index")
        small = segments * len(indexed) * BITS // 8 <= BROADCAST_BYTES
        placed = placed.join(F.broadcast(candidates) if small else candidates, "segment", "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    parts = []
    for k, rule in enumerate(rules):
        if k in indexed:
            maybe = F.coalesce(bit_set(f"bits_{k}", "bit"), F.lit(False))
        else:
            maybe = F.col("text").rlike(rule.probe or rule.regex)
        hits = F.when(maybe, spans(F.col("text"), rule)).otherwise(none)
        parts.append(_labelled(hits, k))
    found = F.array_sort(F.concat(*parts))
    return placed.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), found.alias(found_col))


def describe(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of all spans replaced by ``mark``."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        found,
        state,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
