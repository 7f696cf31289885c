"""SentencePiece encoding and decoding (BPE models), with the span of the original text that each piece comes from.

1. Normalisation reads the text from left to right. At each place the longest rule of the model's compiled character map
   (a double-array trie) that fits is taken, else one character as it is; user-defined symbols are taken whole. For every
   byte it writes, it notes the byte of the original text that this came from (alignment).
2. The normalised text is cut in front of runs of word marks, where the vocabulary has no piece that crosses such a cut,
   and each chunk is merged by piece scores; chunks are remembered. Unknown characters become byte pieces, if the model
   has them.
3. A piece's begin and end in the normalised text are looked up in the alignment: its span of original bytes. Of the byte
   pieces of one character the last holds its span, the others are empty and stand at its begin.

Edge cases: null text counts as empty and has no ids; texts are encoded whole, however long; strings of control pieces in
a text are ordinary text; repeated rows and ids are answered alike, a row each; an empty table gives an empty result; only
doc_id and text are read. Models of another kind than BPE, with word marks at the end of words, or with a map for decoding
are refused.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, prepare

MARK = "▁"
_MARK = MARK.encode()
#: Fixed values of the model file: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Symbols of a chunk from which on a heap finds the best pair; results are equal.
LONG_CHUNK = 64
#: Chunks in each of the two generations that a worker process remembers, about 250 bytes each, and the longest of them.
CHUNKS, CHUNK_LENGTH = 500_000, 64
_NONE = 1 << 60
#: Stands for a control piece while texts are joined: no UTF-8 has it, so that such a text is decoded piece by piece.
_NOTHING = b"\xff"
_REPLACEMENT = "�".encode()


def _fields(data: bytes):
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a size, a double-array trie of UTF-8 keys, and replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        (n,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
        self.texts = blob[4 + n :]
        self.first = {b for b in range(256) if self._step(self._offset(self.units[0]), b)}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, place: int, byte: int) -> int | None:
        """The unit that follows by a byte."""
        at = place ^ byte
        if at < len(self.units) and self.units[at] & 0x800000FF == byte:
            return at
        return None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        place, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node = self._step(place, data[i])
            if node is None:
                break
            unit = self.units[node]
            place = node ^ self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[place] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.texts[start : self.texts.index(0, start)]


class _Chunks(dict):
    """Chunk -> its pieces. When full it begins anew, and what is asked for again comes over from the last generation."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk):
        got = self.old.get(chunk)
        if got is None:
            got = self.encode(chunk)
        if len(chunk) <= CHUNK_LENGTH:
            if len(self) >= CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


class PieceModel:
    """Pieces and settings of a model file, its normaliser, encoder and decoder."""

    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser, denormaliser = {}, {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1])
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer |= dict(_fields(value))  # of repeated messages the later fields count
            elif number == 3:
                normaliser |= dict(_fields(value))
            elif number == 5:
                denormaliser |= dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or denormaliser.get(2):
            raise ValueError("only BPE models with word marks in front and without a map for decoding are read")
        self.map = CharMap(normaliser[2]) if normaliser.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.byte_ids) == 256
        self.ids = {p.decode(): i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.reserved = {p.decode("utf-8", "replace"): i for i, p in enumerate(self.pieces) if self.kinds[i] not in (NORMAL, USER, UNUSED)}
        places = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: places[self.scores[i]] for p, i in self.ids.items()}
        user = sorted((p for p, i in self.ids.items() if self.kinds[i] == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        self.user_bytes = re.compile(b"|".join(re.escape(p.encode()) for p in user)) if user else None
        whole = UNUSED in self.kinds or any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile(r"(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.simple = self.user is None and UNUSED not in self.kinds
        self.plain = self.map is None and self.user is None and not self.squeeze and self.escape
        self.side_by_side = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.chunks = _Chunks(self._parted)
        self._decimals = [b"%d" % i for i in range(len(self.pieces))]
        self._decoded = [self._surface(i) for i in range(len(self.pieces))]
        quiet = [b for b in range(33, 127) if not (self.map and b in self.map.first) and not any(p.encode()[0] == b for p in user)]
        self._quiet = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in quiet) + b"]+" if quiet else b"(?!)")

    # --- normalisation -------------------------------------------------------------------------------------------

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in data that it came from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._plain(data) if self.plain else self._by_rules(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """normalise() where every character stands for itself and only spaces are written as marks."""
        raw = np.frombuffer(data, np.uint8)
        at = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        at = np.repeat(at, np.where(raw == 32, 3, 1))
        front = np.zeros(3 * self.dummy, np.int64)
        return _MARK * self.dummy + data.replace(b" ", _MARK), np.concatenate([front, at, [len(data)]])

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """How much of data is taken at a place, and what is written for it."""
        if self.user_bytes and (m := self.user_bytes.match(data, at)):
            return len(m[0]), m[0]
        if self.map and data[at] in self.map.first and (found := self.map.longest(data, at)):
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        char = data[at : at + n]
        try:
            char.decode()
            return n, char
        except UnicodeDecodeError:
            return 1, _REPLACEMENT

    def _by_rules(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(data)
        if self.squeeze:
            while at < end and (step := self._prefix(data, at))[1] == b" ":
                at += step[0]
            if at == end:
                return b"", np.zeros(1, np.int64)
        space = _MARK if self.escape else b" "
        out, align = bytearray(), []
        if self.dummy:
            out += space
            align += [at] * len(space)
        after_space = self.squeeze
        while at < end:
            if m := self._quiet.match(data, at):
                out += m[0]
                align.extend(range(at, m.end()))
                at, after_space = m.end(), False
                continue
            taken, text = self._prefix(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                after_space = text.endswith(b" ") and self.squeeze
                if self.escape:
                    text = text.replace(b" ", _MARK)
                out += text
                align += [at] * len(text)
            elif not self.squeeze:
                after_space = False
            at += taken
        if self.squeeze:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        align.append(at)
        return bytes(out), np.array(align, np.int64)

    # --- encoding ------------------------------------------------------------------------------------------------

    def _symbols(self, chunk: str) -> tuple[list[str], list[bool]]:
        """Characters and user-defined symbols of a chunk; the latter are never merged."""
        if self.user is None:
            return list(chunk), [False] * len(chunk)
        parts, fixed, last = [], [], 0
        for m in self.user.finditer(chunk):
            parts += [*chunk[last : m.start()], m[0]]
            fixed += [False] * (m.start() - last) + [True]
            last = m.end()
        return parts + list(chunk[last:]), fixed + [False] * (len(chunk) - last)

    def _merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the pair of the best score, leftmost among equals, is merged until none is left."""
        rank, made = self.rank, {}
        if self.simple and len(chunk) <= LONG_CHUNK:
            parts, get = list(chunk), rank.get
            near = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            while near and (low := min(near)) != _NONE:
                i = near.index(low)
                parts[i] += parts[i + 1]
                del near[i], parts[i + 1]
                if i:
                    near[i - 1] = get(parts[i - 1] + parts[i], _NONE)
                if i < len(near):
                    near[i] = get(parts[i] + parts[i + 1], _NONE)
            return parts
        parts, fixed = self._symbols(chunk)

        def told(a: str, b: str, still: bool) -> int:
            if still or (r := rank.get(a + b)) is None:
                return _NONE
            if self.kinds[self.ids[a + b]] == UNUSED:
                made[a + b] = (a, b)
            return r

        if len(parts) > LONG_CHUNK:
            parts = _merge_long(parts, fixed, told)
        else:
            near = [told(a, b, x or y) for a, b, x, y in zip(parts, parts[1:], fixed, fixed[1:])]
            while near and (low := min(near)) != _NONE:
                i = near.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del near[i], fixed[i]
                fixed[i] = False
                if i:
                    near[i - 1] = told(parts[i - 1], parts[i], fixed[i - 1])
                if i < len(near):
                    near[i] = told(parts[i], parts[i + 1], fixed[i + 1])
        if not made:
            return parts
        out, todo = [], parts[::-1]
        while todo:  # pieces that are marked unused are parted again
            p = todo.pop()
            if p in made and self.kinds[self.ids[p]] == UNUSED:
                todo += made[p][::-1]
            else:
                out.append(p)
        return out

    def _parted(self, chunk: str) -> bytes:
        """The chunk's pieces as pairs of 32-bit integers: id, and length in normalised bytes. It is parted between
        characters that stand side by side in no piece, where nothing can be merged."""
        if not self.simple:
            return self._encode_chunk(chunk)
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.side_by_side]
        if not cuts:
            return self._encode_chunk(chunk)
        return b"".join([self.chunks[chunk[i:j]] for i, j in zip([0, *cuts], [*cuts, len(chunk)])])

    def _encode_chunk(self, chunk: str) -> bytes:
        told = []
        for p in self._merge(chunk):
            i = self.reserved[p] if p in self.reserved else self.ids.get(p, self.unknown)
            n = len(p) if p.isascii() else len(p.encode())
            if i == self.unknown and self.fallback:
                for b in p.encode():
                    told += [self.byte_ids[b], 0]
                told[-1] = n
            else:
                told += [i, n]
        return struct.pack(f"<{len(told)}i", *told)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and ends of pieces in the text's UTF-8 bytes. A piece begins where the one before ends."""
        data = text.encode()
        if self.plain:
            normal, align = MARK * (self.dummy and bool(text)) + text.replace(" ", MARK), None
        else:
            normal, align = self.normalise(data)
            normal = normal.decode()
        told = np.frombuffer(b"".join(map(self.chunks.__getitem__, self.cut(normal))), "<i4").reshape(-1, 2)
        ids, ends = told[:, 0], np.cumsum(told[:, 1], dtype=np.int64)
        if not self.fallback and (ids == self.unknown).any():  # unknown characters side by side are one piece
            last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
            ids, ends = ids[last], ends[last]
        places = self._plain_places(data, ends) if align is None else align[ends]
        first = 0 if align is None else align[0]
        return ids, np.append(first, places)[: len(ids)], places

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return b",".join(map(self._decimals.__getitem__, ids.tolist()))

    def _plain_places(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """What _plain() aligns these ends of pieces with, without a place for every byte: marks are of three bytes, one
        of them for the space, and the mark in front is for nothing."""
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        marks = spaces + 2 * np.arange(len(spaces)) + 3 * self.dummy
        return np.maximum(ends - 3 * self.dummy - 2 * marks.searchsorted(ends), 0)

    # --- decoding ------------------------------------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return _NOTHING if kind == CONTROL else self.unknown_text if kind == UNKNOWN else self.pieces[i].replace(_MARK, b" ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: word marks are spaces, the one in front of the text goes; byte pieces that aren't UTF-8
        become replacement characters, byte by byte."""
        front, seen, at = [], False, 0
        if self.dummy or self.squeeze:
            while at < len(ids) and self.kinds[ids[at]] != BYTE and not seen:  # until something stands in front
                raw = self._decoded[ids[at]]
                word = self.kinds[ids[at]] not in (CONTROL, UNKNOWN)
                if word and self.pieces[ids[at]].startswith(_MARK):
                    raw, seen = raw[1:], not self.squeeze
                front.append(raw)
                seen |= bool(raw) and raw != _NOTHING
                at += 1
        parts = front + list(map(self._decoded.__getitem__, ids[at:]))
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            kinds = [self.kinds[i] for i in ids]
        out, at = [], 0
        while at < len(parts):  # runs of byte pieces by themselves
            end = at + 1
            if kinds[at] == BYTE:
                while end < len(parts) and kinds[end] == BYTE:
                    end += 1
            out.append("" if kinds[at] == CONTROL else _each_byte(b"".join(parts[at:end])))
            at = end
        return "".join(out)


def _each_byte(data: bytes) -> str:
    """UTF-8 text, where each byte that doesn't begin a whole character becomes a replacement character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1
    return "".join(out)


def _merge_long(parts: list[str], fixed: list[bool], told) -> list[str]:
    """The merge of a long chunk with a heap of pairs, in n log n."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (r := told(parts[i], parts[j], fixed[i] or fixed[j])) != _NONE:
            heapq.heappush(heap, (r, i, j, len(parts[i]) + len(parts[j])))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p]


@functools.lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """The model of this worker process: what it remembers outlives a task."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, ids, begins, ends (of each piece in the text's UTF-8 bytes); a row per row, no shuffle."""
    prepare(docs.sparkSession)

    def columns():
        model = piece_model(path)

        def f(texts):
            got = [model.encode(t) for t in texts]
            return {"ids": _list([g[0] for g in got], pa.int32()), "begins": _list([g[1] for g in got], pa.int64()), "ends": _list([g[2] for g in got], pa.int64())}

        return f

    return map_texts(docs, ["doc_id"], columns, "ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text; a row per row, no shuffle. Null ids decode to an empty text."""
    prepare(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = piece_model(path)
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, ids_sha256 (of decimals joined by commas), decoded_sha256, spans_sha256 (of
    begin and end of each piece in original bytes, as little-endian 64-bit integers), covered (the spans follow each
    other without gaps from the text's first byte to its last): encode() and decode() of a row at once, no shuffle. path
    is the model's file, which every executor has."""
    prepare(docs.sparkSession)

    def columns():
        model = piece_model(path)

        def f(texts):
            n, one, two, three, four = [], [], [], [], []
            for t in texts:
                ids, begins, ends = model.encode(t)
                n.append(len(ids))
                one.append(hashlib.sha256(model.decimals(ids)).hexdigest())
                two.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
                three.append(hashlib.sha256(np.stack([begins, ends], 1).astype("<i8").tobytes()).hexdigest())
                four.append(not len(ids) or bool(begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all()))
            return {
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(one, pa.string()),
                "decoded_sha256": pa.array(two, pa.string()),
                "spans_sha256": pa.array(three, pa.string()),
                "covered": pa.array(four, pa.bool_()),
            }

        return f

    return map_texts(docs, ["doc_id"], columns, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered boolean")
