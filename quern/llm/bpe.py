"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text proposes cuts, each moved to the next white space, so
equal passages of different documents fall into equal chunks.  A chunk is encoded
once per worker and kept in a bounded cache.  Where two chunks meet, the words on
both sides of the join are encoded together; if that differs from the two parts
encoded apart, a wider window is tried, and if none agrees the two chunks are
joined and encoded as one, until joins agree exactly.

Inside a new chunk the same reuse goes on with words, where the tokenizer's own
pattern can't cross white space (that is read from its file); else the library
encodes the chunk whole.  Results are those of the library, which tests hold
against it text by text.

Defined results: a null text counts as empty and gives no ids; repeated rows are
encoded each; an empty table gives an empty result.  Memory is bounded by the
cache's limit and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches, texts

WINDOW, MASK = 16, (1 << 7) - 1  # a cut after every 128th word or so
_GEAR = np.random.default_rng(1).integers(1, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.array([x in b" \t\n\r\x0b\x0c" for x in range(256)])
#: Words and pieces of words kept per worker; a full cache is emptied.  Chunks are kept up to CHUNK_BYTES of text.
WORDS, PIECES, CHUNK_BYTES = 150_000, 700_000, 24 << 20
#: Texts of these characters only are their own normal form, and lower() changes them letter by letter.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level BPE writes bytes as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def cuts(raw: bytes) -> list[int]:
    """Content-defined cut points: white space whose preceding window hashes to 0 under the mask."""
    if len(raw) < 2 * WINDOW:
        return []
    b = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(_SPACE[b])
    at = at[at >= WINDOW]
    if not len(at):
        return []
    h = _GEAR[b]
    for k in (1, 2, 4, 8):  # h[i] covers 2 * k bytes from i
        h = h[:-k] * np.uint32(0x01000193) + (h[k:] ^ (h[k:] >> np.uint32(15)))
    h = h[at - WINDOW]
    return at[((h ^ (h >> np.uint32(13))) & np.uint32(MASK)) == 0].tolist()


class Encoder:
    """Encodes and decodes as the tokenizers library does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.by_word = _word_bound(spec)
        self.spaced = spec.get("decoder") is None  # decoding joins the tokens by spaces
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.token: dict[int, bytes] = {}
        self.repaired = 0

    def ids(self, raw: bytes) -> list[int]:
        return self.lib.encode(raw.decode("utf-8"), add_special_tokens=False).ids

    def _encoded(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Little-endian ids, and tokens each followed by a space."""
        return np.array(ids, dtype="<u4").tobytes(), b"".join(map(self._token, ids)) if self.spaced else b""

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        """One match of the pattern, already in normal form: only the model is left to run."""
        tokens = self.lib.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS))
        ids = array("I", [t.id for t in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes(), "".join([t.value + " " for t in tokens]).encode() if self.spaced else b""
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        self.pieces[piece] = out
        return out

    def _plain(self, text: str) -> tuple[bytes, bytes]:
        get, new = self.pieces.get, self._piece
        parts = [get(p) or new(p) for p in _PIECE.findall(text.lower())]
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _words(self, raw: bytes) -> tuple[bytes, bytes]:
        """White space separates for good, so words are encoded apart."""
        text = raw.decode("utf-8")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        parts = []
        for w in raw.split():
            part = self.words.get(w)
            if part is None:
                word = w.decode("utf-8")
                part = self._plain(word) if _PLAIN.fullmatch(word) and "<|" not in word else self._encoded(self.ids(w))
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[w] = part
            parts.append(part)
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _token(self, i: int) -> bytes:
        t = self.token.get(i)
        if t is None:
            t = self.token[i] = (self.lib.id_to_token(i) or "").encode() + b" "
        return t

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        out = self.chunks.get(raw)
        if out is not None:
            return out
        if self.by_word:
            out = self._words(raw)
        else:
            out = self._encoded(self.ids(raw))
        if self.held + len(raw) > CHUNK_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[raw] = out
        self.held += len(raw)
        return out

    def _side(self, raw: bytes) -> bytes:
        if not self.by_word:
            return self._encoded(self.ids(raw))[0]
        return self._words(raw)[0]

    def _agrees(self, left: bytes, right: bytes) -> bool:
        """Whether a window around the join encodes as its two sides do."""
        for n in (1, 4):
            a, b = _last(left, n), _first(right, n)
            key = (a, b)
            ok = self.joins.get(key)
            if ok is None:
                ok = self._encoded(self.ids(a + b))[0] == self._side(a) + self._side(b)
                if len(self.joins) >= WORDS // 4:
                    self.joins.clear()
                self.joins[key] = ok
            if ok:
                return True
        return False

    def encode(self, raw: bytes) -> tuple[bytes, bytes]:
        """Little-endian 32-bit ids, and the decoded text."""
        ends = cuts(raw)
        if not ends:
            ids, said = self._chunk(raw)
        else:
            pieces, at = [], 0
            for end in [*ends, len(raw)]:
                piece = raw[at:end]
                at = end
                if pieces and not self._agrees(pieces[-1], piece):
                    pieces[-1] += piece  # encoded as one
                    self.repaired += 1
                else:
                    pieces.append(piece)
            done = [self._chunk(p) for p in pieces]
            ids, said = b"".join([d[0] for d in done]), b"".join([d[1] for d in done])
        if self.spaced:
            return ids, said[:-1]
        return ids, self.lib.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False).encode()


def _word_bound(spec: dict) -> bool:
    """Whether the file's pre-tokenizer splits by a pattern that white space never takes part in, with nothing that looks across it."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), {})
    pattern = split.get("pattern", {}).get("Regex", "")
    return (
        split.get("invert") is True
        and split.get("behavior") == "Removed"
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and {n["type"] for n in norm.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


def _last(raw: bytes, n: int) -> bytes:
    """The last ``n`` words; the white space before them isn't part."""
    parts = raw.rsplit(None, n)
    return b" ".join(parts[-n:]) if parts else b""


def _first(raw: bytes, n: int) -> bytes:
    parts = raw.split(None, n)[:n]
    return raw[: len(raw) - len(raw.lstrip())] + b" ".join(parts)


_SHARED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so caches outlive tasks."""
    if path not in _SHARED:
        _SHARED[path] = Encoder(path)
    return _SHARED[path]


def encode_documents(docs: DataFrame, tokenizer: str, *, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids (little-endian 32-bit) and decoded."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text

    def make() -> Callable:
        enc = encoder(tokenizer)

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            n, a, b, ids, said = [], [], [], [], []
            for raw in texts(batch.column(1)):
                i, d = enc.encode(raw)
                n.append(len(i) // 4)
                a.append(hashlib.sha256(i).hexdigest())
                b.append(hashlib.sha256(d).hexdigest())
                if with_ids:
                    ids.append(i)
                if with_text:
                    said.append(d)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.binary())
            if with_text:
                out["decoded"] = pa.array(said, pa.binary()).cast(pa.string())
            return out

        return step

    return map_batches(narrow, make, schema)
