"""Byte-level BPE by contiguous rank arrays, and cached word tokenisation for packing.

A word's parts are kept as an array of boundaries and, beside it, the ranks of adjacent pairs. The least rank is looked
for again and again, its boundary deleted, and the two neighbouring ranks refreshed. Words over LONG_WORD bytes (a line
without spaces) use a heap over the same ranks instead, so time stays n log n; results are equal.

Edge cases: null text counts as empty and has no ids; the strings of special tokens in a text become their ids, as in the
tokenizers library with its defaults; texts are encoded whole; repeated rows are answered alike; only doc_id and text
are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, prepare

#: Fixed value: how byte-level BPE vocabularies of this family cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Words whose ids a worker process remembers, about 200 bytes each.
CACHE_WORDS = 600_000


def _ranges(kind: str) -> str:
    """A character class's inside: the plain characters (see PLAIN) whose Unicode category starts so."""
    return "".join(f"\\U{c:08x}" for c in range(0x180) if unicodedata.category(chr(c)).startswith(kind))


_L, _N, _S = _ranges("L"), _ranges("N"), r"\t-\r\x20\x85\xa0"
#: Texts of Latin characters and usual punctuation only: their normal form, lower case and classes are the same in every
#: Unicode version, so that the standard library's faster matcher gives the same words.
PLAIN = re.compile("[\x00-\x1b\x20-ſ‐-‧€]*")
FAST_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: A chunk holds no space but one in front, as no word of FAST_PATTERN does, so each chunk can be cut into words alone.
CHUNKS = r" ?\S+|\s+(?!\S)|\s+"
FAST_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Vocabulary:
    """Token ids, pair ranks and special tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        back = {c: b for b, c in byte_chars().items()}
        vocab = told["model"]["vocab"]
        raw = lambda t: bytes(back[c] for c in t)
        ids = {raw(t): i for t, i in vocab.items()}
        self.bytes_of = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> rank, id of the merged part
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


NONE = 1 << 60


def encode_word(word: bytes, v: Vocabulary) -> list[int]:
    """The ids of one word."""
    ids = [v.single[b] for b in word]
    if len(ids) > LONG_WORD:
        return _encode_long(ids, v.merge)
    get, no = v.merge.get, (NONE, -1)
    near = [get(p, no) for p in zip(ids, ids[1:])]
    while near:
        low = min(near)
        if low[0] == NONE:
            break
        i = near.index(low)
        ids[i : i + 2] = [low[1]]
        del near[i]
        if i:
            near[i - 1] = get((ids[i - 1], ids[i]), no)
        if i < len(near):
            near[i] = get((ids[i], ids[i + 1]), no)
    return ids


def _encode_long(ids: list[int], merge: dict) -> list[int]:
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if not live[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], live[j], after[i] = new, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (m := merge.get((ids[x], ids[y]))):
                heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
    return [t for t, on in zip(ids, live) if on]


class _Words(dict):
    """Word or chunk of words -> its ids as little-endian unsigned 32-bit integers; emptied when full."""

    def __init__(self, cut, encode):
        super().__init__()
        self.cut, self.encode = cut, encode

    def __missing__(self, chunk):
        if len(self) >= CACHE_WORDS:
            self.clear()
        words = self.cut(chunk)
        if len(words) == 1:
            ids = self.encode(words[0])
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = b"".join([self[w] for w in words])
        self[chunk] = out
        return out


class ByteBPE:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.words = _Words(re.compile(FAST_PATTERN).findall, lambda w: encode_word(w.encode(), v))
        self.rare = _Words(lambda w: [w], lambda w: encode_word(w.encode(), v))
        self.slow, self.chunks = regex.compile(PATTERN).findall, re.compile(CHUNKS).findall
        top = max(v.bytes_of) + 1
        self.pieces = [v.bytes_of.get(i, b"") for i in range(top)]

    def _ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, self.chunks(text)))
        return b"".join(map(self.rare.__getitem__, self.slow(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        v = self.vocabulary
        if v.cut is None or not any(s in text for s in v.special):
            return self._ids(text)
        out, last = [], 0
        for m in v.cut.finditer(text):
            out += [self._ids(text[last : m.start()]), struct.pack("<I", v.special[m[0]])]
            last = m.end()
        return b"".join(out) + self._ids(text[last:])

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBPE:
    """The encoder of this worker process: its word cache outlives a task."""
    return ByteBPE(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, ids_sha256, decoded_sha256; a row per row, no shuffle. path is the tokenizer's
    file, which every executor has."""
    prepare(docs.sparkSession)

    def columns():
        bpe = byte_bpe(path)

        def f(texts):
            ids = [bpe.encode(t) for t in texts]
            return {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            }

        return f

    return map_texts(docs, ["doc_id"], columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")


class CachedTokenizer:
    """Ids as the tokenizers library gives them for a vocabulary of lower-cased words with word ends. The library's model
    encodes each distinct word once, written in the characters that stand for its bytes: what the library does before and
    after its model is known for a word and isn't done a word. A text of other characters than plain ones goes to the
    library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        tokens, chars = self.whole.model.tokenize, byte_chars()

        def ids(word):
            if not (word.isascii() and word.isprintable()):  # printable ASCII stands for itself
                word = "".join([chars[b] for b in word.encode()])
            return [t.id for t in tokens(word)]

        self.words = _Words(re.compile(FAST_WORDS).findall, ids)

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=1)
def cached_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this worker process: its word cache outlives a task."""
    return CachedTokenizer(path)
