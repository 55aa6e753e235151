"""License scans by template markup.

A template is a license text with ``[[ optional ]]`` and ``<<n>>`` regions, the
latter replaceable by up to n words.  It compiles to an automaton over words:
mandatory words must match exactly, optional ones may be absent, and replaceable
regions take any words.  A text has a template's label when the automaton accepts
some run of its words.  Starts are found by the template's first mandatory words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  The base
phrases stay whatever the templates say.  score: 1 with a template, 0.5 with phrases
only, else 0.  Defined results: a null text is empty, with no words and no labels;
repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches, texts

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MIT = """[[copyright <<12>>]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<8>> be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and <<8>> disclaims all warranties with regard to
this software including all implied warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
tortious action arising out of or in connection with the use or performance of this software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution {} this software is provided by <<10>> as is and any express or implied warranties including
but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_BSD3 = "[[3]] neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"

TEMPLATES = {
    "mit-text": _MIT,
    "isc": _ISC,
    "bsd-2-clause": _BSD.format(""),
    "bsd-3-clause": _BSD.format(_BSD3),
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "mit-notice": "[[<<3>> is]] released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "gpl-3.0": "licensed under the gnu general public license version 3 [[or later]]",
    "gpl-2.0": "licensed under the gnu general public license version 2 [[or later]]",
    "gpl-notice": """free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version <<2>> of the license or at your option any later version""",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-4.0": "licensed under [[a]] [[creative commons attribution 4 0 international license]] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] cc by sa 4 0",
    "cc-by-nd-4.0": "licensed under [[a]] cc by nd 4 0",
    "cc0-1.0": "cc0 1 0 universal",
}
#: Bytes that aren't word characters become spaces, A-Z becomes a-z.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_EDGE = rb"[0-9a-z\x80-\xff]"
_PHRASE = re.compile(rb"(?<!%s)(?:%s)(?!%s)" % (_EDGE, b"|".join(p.encode().replace(b" ", b" +") for p in PHRASES), _EDGE))


class Automaton:
    """States are positions in ``steps``: (word, None), (None, n) for n free words, or an optional group's bounds."""

    def __init__(self, markup: str) -> None:
        self.steps: list[tuple[bytes | None, int]] = []
        self.skip: dict[int, int] = {}  # from a group's first step to the one after its last
        opened = []
        for token in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
            if token == "[[":
                opened.append(len(self.steps))
            elif token == "]]":
                self.skip[opened.pop()] = len(self.steps)
            elif token[0] == "<":
                self.steps.append((None, int(token[2:-2])))
            else:
                self.steps.append((token.lower().encode(), 0))
        optional = {i for a, b in self.skip.items() for i in range(a, b)}
        mandatory = [i for i, (w, _) in enumerate(self.steps) if w is not None and i not in optional]
        if not mandatory:
            raise ValueError("a template needs a mandatory word")
        self.words = frozenset(self.steps[i][0] for i in mandatory)
        # Optional lead-ins add nothing to acceptance, so runs start at the first mandatory word.
        self.first = mandatory[0]
        self.second = self.steps[mandatory[1]][0] if len(mandatory) > 1 and mandatory[1] == mandatory[0] + 1 else None

    def _close(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, out = list(states), set(states)
        while todo:
            i, used = todo.pop()
            more = []
            if i in self.skip and used == 0:
                more.append((self.skip[i], 0))
            if i < len(self.steps) and self.steps[i][0] is None:
                more.append((i + 1, 0))
            for s in more:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self._close({(self.first, 0)})
        end = len(self.steps)
        for w in words[at:]:
            nxt = set()
            for i, used in states:
                if i == end:
                    return True
                word, free = self.steps[i]
                if word == w:
                    nxt.add((i + 1, 0))
                elif word is None and used < free:
                    nxt.add((i, used + 1))
            states = self._close(nxt)
            if not states:
                return False
        return any(i == end for i, _ in states)

    def found(self, words: list[bytes], where: dict[bytes, list[int]]) -> bool:
        if not all(w in where for w in self.words):
            return False
        for at in where[self.steps[self.first][0]]:
            if (self.second is None or words[at + 1 : at + 2] == [self.second]) and self.accepts_at(words, at):
                return True
        return False


def scan(raw: bytes, automata: dict[str, Automaton], anchors: re.Pattern) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score."""
    t = raw.translate(_TABLE)
    n_words = len(t.split())
    if not anchors.search(t):
        return n_words, 0, None, None, "", "", 0.0
    words = t.split()
    places = [(len(t[: m.start()].split()), PHRASES[b" ".join(m[0].split()).decode()]) for m in _PHRASE.finditer(t)]
    base = {label for _, label in places}
    where: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    more = {label for label, a in automata.items() if a.found(words, where)}
    score = 1.0 if more else 0.5 if base else 0.0
    return (
        n_words, len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | more)), score,
    )


def anchor_pattern(automata: dict[str, Automaton]) -> re.Pattern:
    """What every phrase or template contains: its longest mandatory word, and that of every phrase."""
    need = {max(a.words, key=lambda w: (len(w), w)) for a in automata.values()} | {max(p.split(), key=len).encode() for p in PHRASES}
    return re.compile(b"|".join(re.escape(w) for w in sorted(need)))


def scan_licenses(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make() -> Callable:
        automata = {k: Automaton(v) for k, v in templates.items()}
        anchors = anchor_pattern(automata)

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            rows = [scan(raw, automata, anchors) for raw in texts(batch.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            return {"doc_id": batch.column(0)} | {k: pa.array(c, kind) for k, c, kind in zip(names, cols, kinds)}

        return step

    return map_batches(narrow, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
