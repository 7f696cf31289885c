"""Packing by shortest-pack-first over the length histogram.

Documents become token ids (with an end id) and are cut where they are longer than a sequence. Only the histogram of
piece lengths comes to the driver: its size is bounded by sequence length times SALTS, whatever the corpus holds. From
the longest length to the shortest, pieces go to the emptiest open packs that still have room (the shortest pack first),
as counts of packing patterns, never piece by piece. Where packs stay open by GRAIN ids or more, the emptiest are taken
apart again, as far as their ids fit into the gaps of the others: again longest first into the shortest pack, the last
piece of a pack being cut to a multiple of GRAIN that fills it, and its rest going back to the histogram. So fewer than
GRAIN of a sequence's slots stay empty, but for one or two sequences in all.

The patterns are then joined back by rank: a piece's rank among those of its length says which copy of which pattern it
fills, and if it is cut there, which rank its rest has among the rests of that length. Ranks are made within (length,
salt) and shifted by the counts before them, so a length (or an id) that a third of all documents share is ranked by many
tasks. Token ids never leave the task that made them: a piece carries the checksum of every GRAIN ids of it, from which
those of its parts follow.

Edge cases: null text counts as empty (a piece with the end id only); repeated rows and ids are packed as often as they
come; ties in length are broken by the place in the stored table; an empty table gives an empty result; very long texts
are tokenised whole; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skein.session import scratch

from .bpe import cached_tokenizer
from .common import prepare, saved

SEQUENCE = 4096
SALTS = 64
#: Ids between two places where a piece may be cut.
GRAIN = 64


def pieces_of(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """doc_id, text -> doc_id, start, length, ids_crc32, doc_tokens, marks (the checksum of every GRAIN ids, 4 bytes each),
    a row per piece of at most size ids."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = cached_tokenizer(path).encode
        for b in batches:
            row, start, length, crc, total, marks = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = encode(t or "") + end
                for a in range(0, len(ids), 4 * size):
                    part = ids[a : a + 4 * size]
                    row.append(i)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
                    each = [zlib.crc32(part[k : k + 4 * GRAIN]) for k in range(0, len(part), 4 * GRAIN)]
                    marks.append(struct.pack(f"<{len(each)}I", *each))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)] + [pa.array(marks, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, marks binary")


#: A pattern: how many packs, and (length, ids taken of it) of their pieces in order; fewer taken: cut, the rest is another
#: piece.
Pattern = tuple[int, list[tuple[int, int]]]


def _shortest_first(pieces: dict[int, int], packs: dict[int, list[Pattern]], size: int, grain: int | None) -> list[Pattern]:
    """Put pieces (length -> count), longest first, into the emptiest of the open packs (fill -> patterns; changed in
    place). Without a grain a piece that fits in none begins a new pack; with it the piece is cut to fill the emptiest,
    and only what is left without any open pack begins new ones. Returns the packs that are full. At most one open pattern
    is split for each length and fill, so the work depends on the histogram only."""
    full: list[Pattern] = []
    pieces = dict(pieces)
    heap = [-n for n in pieces]
    heapq.heapify(heap)
    close = grain or 1

    def put(fill: int, pattern: Pattern) -> None:
        (packs[fill] if size - fill >= close else full).append(pattern)

    while heap:
        length = -heapq.heappop(heap)
        todo = pieces.pop(length, 0)
        while todo:
            # the shortest pack comes first, while the piece fits or may be cut
            fill = min((f for f, p in packs.items() if p and (grain or f + length <= size)), default=None)
            if fill is None:
                each = max(1, size // length)
                copies = todo // each
                if not copies:
                    each, copies = todo, 1
                todo -= copies * each
                put(length * each, (copies, [(length, length)] * each))
                continue
            copies, held = packs[fill].pop()
            if not packs[fill]:
                del packs[fill]
            if copies > todo:
                packs[fill].append((copies - todo, held))
                copies = todo
            todo -= copies
            taken = length if fill + length <= size else (size - fill) // grain * grain
            put(fill + taken, (copies, [*held, (length, taken)]))
            if taken < length:
                if length - taken not in pieces:
                    heapq.heappush(heap, taken - length)
                pieces[length - taken] = pieces.get(length - taken, 0) + copies
    return full


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE, grain: int | None = GRAIN) -> list[Pattern]:
    """Shortest-pack-first: patterns that hold every piece of the histogram once, and every rest of a cut. Without a grain
    nothing is cut."""
    packs: dict[int, list[Pattern]] = defaultdict(list)
    full = _shortest_first(histogram, packs, size, None)
    while grain:
        for fill in [f for f in packs if size - f < grain]:
            full += packs.pop(fill)
        if not packs:
            break
        room = {f: (size - f) // grain * grain for f in packs}
        low = min(packs)
        copies, held = max(packs[low], key=lambda p: p[0])
        free = sum(room[f] * c for f, ps in packs.items() for c, _ in ps)
        # so many packs of this pattern fit into the gaps of all others and of this pattern's remaining ones
        apart = min(copies, free // (low + room[low]))
        if not apart:
            break
        packs[low].remove((copies, held))
        if copies > apart:
            packs[low].append((copies - apart, held))
        if not packs[low]:
            del packs[low]
        freed: dict[int, int] = defaultdict(int)
        for length, _ in held:
            freed[length] += apart
        full += _shortest_first(freed, packs, size, grain)
    for p in packs.values():
        full += p
    return full


def places(patterns: list[Pattern], histogram: dict[int, int]) -> dict[int, tuple[list[int], list[tuple]]]:
    """length -> first ranks in order, and (first rank, first sequence, offset, taken, first rank of the rests): the ranks
    from one first rank to the next of that length fill this place of sequences first_sequence.. Rests rank behind the
    histogram's own pieces."""
    rows: dict[int, list[tuple]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    rests = dict(histogram)
    sequence = 0
    for copies, held in patterns:
        offset = 0
        for length, taken in held:
            rest = -1
            if taken < length:
                rest = rests.get(length - taken, 0)
                rests[length - taken] = rest + copies
            rows[length].append((used[length], sequence, offset, taken, rest))
            used[length] += copies
            offset += taken
        sequence += copies
    return {n: ([r[0] for r in rs], rs) for n, rs in rows.items()}


def parts_of(length: int, rank: int, where: dict[int, tuple[list[int], list[tuple]]]):
    """(ids taken, sequence, offset) of each part of the piece of that length and rank."""
    while True:
        firsts, rows = where[length]
        first, sequence, offset, taken, rest = rows[bisect_right(firsts, rank) - 1]
        yield taken, sequence + rank - first, offset
        if taken == length:
            return
        length, rank = length - taken, rest + rank - first


_ZEROS = bytes(4 * GRAIN)


def checksum(marks: tuple[int, ...], last: int) -> int:
    """The checksum of ids from those of every GRAIN of them, the last of `last` ids: of one text behind another it is the
    first's, carried over as many zero bytes, and the second's."""
    out = marks[0]
    for k, m in enumerate(marks[1:], 2):
        zeros = _ZEROS if k < len(marks) else _ZEROS[: 4 * last]
        out = zlib.crc32(zeros, out ^ 0xFFFFFFFF) ^ 0xFFFFFFFF ^ m
    return out


def pack(pieces: DataFrame, size: int = SEQUENCE, salts: int = SALTS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, marks, ...) cut to parts, without marks and with sequence_id and offset.
    Sequences are filled from 0 without gaps. Pieces without marks stay whole."""
    spark = pieces.sparkSession
    folder = scratch(spark, "packing")
    salted = saved(pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), f"{folder}/pieces")
    salted = salted.withColumn("place", F.monotonically_increasing_id())  # only breaks ties
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size * salts rows
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        before[r["length"], r["salt"]] = histogram[r["length"]]
        histogram[r["length"]] += r["n"]
    cuts = "marks" in salted.columns
    patterns = packing_patterns(dict(histogram), size, GRAIN if cuts else None)
    table = spark.sparkContext.broadcast((places(patterns, dict(histogram)), before))  # bounded by size and salts
    w = Window.partitionBy("length", "salt").orderBy("place")
    ranked = salted.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    names = [c for c in salted.columns if c not in ("salt", "place", "marks")]
    ranked = ranked.select(*names, "salt", "rank", *(["marks"] if cuts else []))
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in salted.select(*names).schema)

    def run(batches):
        where, ahead = table.value
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            length, salt, rank, start, crc = (col(c) for c in ("length", "salt", "rank", "start", "ids_crc32"))
            row, new = [], {"start": [], "length": [], "ids_crc32": [], "sequence_id": [], "offset": []}
            for i, (n, s, r) in enumerate(zip(length, salt, rank)):
                at, marks = 0, None
                for taken, sequence, offset in parts_of(n, r + ahead[n, s], where):
                    if taken == n:
                        own = crc[i]
                    else:
                        if marks is None:
                            raw = b.column(b.schema.get_field_index("marks"))[i].as_py()
                            marks = struct.unpack(f"<{len(raw) // 4}I", raw)
                        own = checksum(marks[at // GRAIN : -(-(at + taken) // GRAIN)], (taken - 1) % GRAIN + 1)
                    row.append(i)
                    for k, v in zip(new, (start[i] + at, taken, own, sequence, offset)):
                        new[k].append(v)
                    at += taken
            index = pa.array(row, pa.int64())
            cols = [pa.array(new[c], pa.int64()) if c in new else b.column(b.schema.get_field_index(c)).take(index) for c in names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(new[c], pa.int64()) for c in ("sequence_id", "offset")], names=names + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{told}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = SEQUENCE) -> DataFrame:
    """doc_id, text -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces_of(docs, path, end_id, size), size)
