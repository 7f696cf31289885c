"""RAD files as a Spark data source: chunks written by tasks, and read by chunk offsets.

A RAD folder (see sources.parts) holds a header, which tells how many chunks there are, and a part of whole chunks for
each task; its parts in order are a RAD file. A single file is read, too.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions.molecule import pack, packed_width, target_word
from skein.session import in_order, ship
from skein.sources.parts import HEADER, PartsWriter, as_one_file, bodies, mounted, publish

__all__ = ["as_one_file", "read_rad", "write_rad"]

#: Struct codes and type numbers of the format's unsigned integers, by their bytes.
_FORM = {1: "B", 2: "H", 4: "I", 8: "Q"}
_TYPE = {1: 1, 2: 2, 4: 3, 8: 4}
MAX_CHUNK = 1 << 30
#: Bytes of chunks that a reading task takes, about.
PART_BYTES = 64 << 20
SCHEMA = "record long, barcode string, umi string, target string, forward boolean"


def header(names: list[str], barcode: int, umi: int, chunks: int) -> bytes:
    def text(t: str) -> bytes:
        raw = t.encode()
        if len(raw) > 0xFFFF:
            raise ValueError("a target's name is longer than 65535 bytes")
        return struct.pack("<H", len(raw)) + raw

    tag = lambda t, k: text(t) + struct.pack("<B", k)
    if len(names) > 1 << 31:
        raise ValueError("more than 2^31 targets")
    out = struct.pack("<BQ", 0, len(names)) + b"".join(map(text, names)) + struct.pack("<Q", chunks)
    out += struct.pack("<H", 2) + tag("cblen", 2) + tag("ulen", 2)
    out += struct.pack("<H", 2) + tag("b", _TYPE[packed_width(barcode)]) + tag("u", _TYPE[packed_width(umi)])
    return out + struct.pack("<H", 1) + tag("compressed_ori_refid", 3) + struct.pack("<HH", barcode, umi)


def parse_header(f) -> tuple[list[str], int, str]:
    """Target names, chunks, and the form of a record's head; f stands behind the header after it."""

    def take(form: str) -> tuple:
        return struct.unpack("<" + form, f.read(struct.calcsize("<" + form)))

    text = lambda: f.read(take("H")[0]).decode()
    _, n = take("BQ")
    names = [text() for _ in range(n)]
    (chunks,) = take("Q")
    kinds = [[(text(), take("B")[0]) for _ in range(take("H")[0])] for _ in range(3)]
    take("HH")
    form = {1: "B", 2: "H", 3: "I", 4: "Q"}
    return names, chunks, "<I" + "".join(form[k] for _, k in kinds[1])


def records_of(chunk: bytes, form: str) -> list[tuple[int, int, list[int]]]:
    """(barcode, umi, words) of each record in a chunk's body."""
    out, at, head = [], 0, struct.calcsize(form)
    while at < len(chunk):
        n, b, u = struct.unpack_from(form, chunk, at)
        out.append((b, u, list(struct.unpack_from(f"<{n}I", chunk, at + head))))
        at += head + 4 * n
    return out


@dataclass
class _Chunks(InputPartition):
    path: str
    at: int
    size: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _head(self) -> str:
        return os.path.join(self.path, HEADER) if os.path.isdir(self.path) else self.path

    def partitions(self):
        with open(self._head(), "rb") as f:
            parse_header(f)
            body = f.tell()
        if os.path.isdir(self.path):
            files = [(n, 0) for n in bodies(self.path)]
        else:
            files = [(self.path, body)]
        out, first = [], 0
        for name, at in files:
            end = os.path.getsize(name)
            with open(name, "rb") as f:
                begin, before = at, first
                while at < end:
                    f.seek(at)
                    size, records = struct.unpack("<II", f.read(8))
                    at, first = at + size, first + records
                    if at - begin >= PART_BYTES or at >= end:
                        out.append(_Chunks(name, begin, at - begin, before))
                        begin, before = at, first
        return out or [_Chunks(self._head(), 0, 0, 0)]

    def read(self, partition: _Chunks):
        with open(self._head(), "rb") as f:
            names, _, form = parse_header(f)
        record, at, end = partition.first, partition.at, partition.at + partition.size
        with open(partition.path, "rb") as f:
            f.seek(at)
            while at < end:
                size, _ = struct.unpack("<II", f.read(8))
                at += size
                cols = [[], [], [], [], []]
                for b, u, words in records_of(f.read(size - 8), form):
                    for w in words:
                        for c, v in zip(cols, (record, str(b), str(u), names[w & 0x7FFFFFFF], bool(w >> 31))):
                            c.append(v)
                    record += 1
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["record", "barcode", "umi", "target", "forward"])


class _Writer(PartsWriter):
    """Rows (b, u, words) in order -> chunks, which are counted. A chunk that is not empty ends before it would grow over
    the budget."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.barcode, self.umi = int(options["barcode"]), int(options["umi"])
        self.budget = max(1, int(options["budget"]))

    def body(self, batches, f) -> int:
        form = "<I" + _FORM[packed_width(self.barcode)] + _FORM[packed_width(self.umi)]
        mask_b, mask_u = ((1 << 8 * packed_width(n)) - 1 for n in (self.barcode, self.umi))
        held, size, chunks = [], 8, 0

        def close() -> None:
            nonlocal size, chunks
            if held:
                f.write(struct.pack("<II", size, len(held)))
                f.writelines(held)
                chunks += 1
            held.clear()
            size = 8

        for b in batches:
            for barcode, umi, words in zip(*(c.to_pylist() for c in b.columns)):
                if not words:
                    raise ValueError("a record needs a hit")
                r = struct.pack(form, len(words), barcode & mask_b, umi & mask_u) + struct.pack(f"<{len(words)}I", *words)
                if held and size + len(r) > self.budget:
                    close()
                if size + len(r) > 0xFFFFFFFF:
                    raise ValueError("a record is longer than 2^32 bytes")
                held.append(r)
                size += len(r)
        close()
        return chunks


class RadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rad"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(mounted(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write_rad(records: DataFrame, dictionary: DataFrame, path: str, barcode: int = 16, umi: int = 12, max_chunk: int = MAX_CHUNK) -> None:
    """records (ord, barcode, umi, hits: array<struct<target_id, forward>>) -> a RAD folder at a mounted path, in order of
    ord; it takes the place of an older one at the end. Without records there is the header only."""
    spark = records.sparkSession
    ship(spark)
    spark.dataSource.register(RadSource)
    rows = records.select("ord", pack(F.col("barcode")).alias("b"), pack(F.col("umi")).alias("u"), F.transform("hits", lambda h: target_word(h["target_id"], h["forward"])).alias("words"))
    rows = in_order(rows, "ord").select("b", "u", "words")
    names = [r[0] for r in dictionary.orderBy("target_id").select("target").collect()]  # as many as the annotation has
    publish(rows, "rad", path, lambda chunks: header(names, barcode, umi, chunks), barcode=barcode, umi=umi, budget=max_chunk)


def read_rad(spark: SparkSession, path: str) -> DataFrame:
    """barcode and umi (packed, decimal), target, forward; a row per hit, with the record's place."""
    ship(spark)
    spark.dataSource.register(RadSource)
    return spark.read.format("rad").load(path)
