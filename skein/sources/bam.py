"""Tagged alignments as BAM: compressed blocks of records written by tasks, and read back part by part.

A BAM folder (see sources.parts) holds the header's blocks, a part of whole records for each task, and the end mark; its
parts in order are a BAM file. A folder's parts and single files are read by ranges of bytes, many tasks a file. A range
has the records that start in the blocks which start in it. Its first block is found by a block's mark and by blocks that
follow it without a gap; its first record, which may stand anywhere in the block or begin in none of it, is the first place
from which record after record fits the format to the end of what was unpacked (at least GUESS bytes, or the file's end).
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.session import in_order, ship
from skein.sources.parts import HEADER, PartsWriter, bodies, mounted, publish
from skein.sources.writers import CONTIG

#: Bytes of a block before compression.
BLOCK = 65280
#: Bytes of a file that a reading task takes, and bytes that must be records for a guess of where one starts.
PART_BYTES, GUESS = 32 << 20, 1 << 18
#: Fixed values of the format: how a block and its extra field begin; codes of bases.
_MARK, _EXTRA = bytes((31, 139, 8, 4)), b"BC\2\0"
_CODES = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
SCHEMA = "name string, flag int, contig string, pos long, mapq int, cigar string, sequence string, cell string, umi string, genes string, gene string"
TAGS = ("CB", "CR", "UB", "UR", "GX", "GN", "XT")


def block(data: bytes) -> bytes:
    """One compressed block: gzip with its own length in an extra field."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[a : a + BLOCK]) for a in range(0, len(data), BLOCK))


def header(genes: list[str], command: str, version: str) -> bytes:
    text = "@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@SQ\tSN:{g}\tLN:{CONTIG}\n" for g in genes) + f"@PG\tID:skein\tPN:skein\tVN:{version}\tCL:{command}\n"
    raw = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(genes))
    for g in genes:
        name = g.encode() + b"\0"
        raw += struct.pack("<i", len(name)) + name + struct.pack("<i", CONTIG)
    return blocks(raw)


def _bin(end: int) -> int:
    """The index bin of an alignment from place 0 to `end`, exclusive."""
    last = max(end, 1) - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if not last >> shift:
            return first
    return 0


def record(name: str, contig: int, sequence: str, quality: bytes | None, tags: dict[str, str | None]) -> bytes:
    """One alignment at a contig's first place, all bases matching."""
    n, read = len(sequence), name.encode() + b"\0"
    if len(read) > 255:
        raise ValueError(f"a name of over 254 bytes doesn't fit the format: {name}")
    codes = [_CODES.get(c, 15) for c in sequence.upper()] + [0] * (n % 2)
    cigar = struct.pack("<I", n << 4) if n else b""
    body = struct.pack("<iiBBHHHiiii", contig, 0, len(read), 255, _bin(n), len(cigar) // 4, 0, n, -1, -1, 0) + read + cigar
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (quality if quality is not None else b"\xff" * n)
    body += b"".join(f"{t}Z{v}".encode() + b"\0" for t, v in tags.items() if v is not None)
    return struct.pack("<i", len(body)) + body


class _Writer(PartsWriter):
    def body(self, batches, f) -> int:
        held, records = bytearray(), 0
        for b in batches:
            for name, contig, sequence, quality, barcode, umi, genes, xt in zip(*(c.to_pylist() for c in b.columns)):
                held += record(name, contig, sequence, quality, dict(zip(TAGS, (barcode, barcode, umi, umi, genes, genes, xt))))
                records += 1
                while len(held) >= BLOCK:
                    f.write(block(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if held:
            f.write(blocks(bytes(held)))
        return records


def _block_at(f, at: int) -> tuple[int, bytes] | None:
    """Length and content of the block at a place of a file; None at the file's end. ValueError where no block stands."""
    f.seek(at)
    head = f.read(18)
    if not head:
        return None
    if len(head) < 18 or head[:4] != _MARK or head[12:16] != _EXTRA:
        raise ValueError("not a file of compressed blocks")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    body = f.read(size - 18)
    try:
        data = zlib.decompress(body[:-8], -15)
    except zlib.error as e:
        raise ValueError("a compressed block is broken") from e
    if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a compressed block is broken")
    return size, data


def first_block(f, begin: int, end: int) -> int | None:
    """Where the first block that starts in [begin, end) stands: one that is whole, with another or the end behind it."""
    f.seek(begin)
    window, found = f.read(min(end - begin, 1 << 16) + 16), -1
    while (found := window.find(_MARK, found + 1)) >= 0 and begin + found < end:
        if window[found + 12 : found + 16] != _EXTRA:
            continue
        try:
            size, _ = _block_at(f, begin + found)
            _block_at(f, begin + found + size)
        except ValueError:
            continue
        return begin + found
    return None


def fits(data: bytes, at: int, contigs: int, whole: bool) -> bool:
    """Whether records follow each other from this place to the end of data, which is the file's if whole."""
    seen = 0
    while at + 36 <= len(data):
        size, contig, pos, name, _, _, ops, _, n, other, further, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if size < 32 or not (-1 <= contig < contigs and -1 <= other < contigs) or min(pos, further) < -1 or name < 1 or n < 0:
            return False
        if 32 + name + 4 * ops + (n + 1) // 2 + n > size:
            return False
        text = data[at + 36 : at + 36 + name]
        if (len(text) == name and text[-1]) or not all(33 <= c <= 126 for c in text[: name - 1]):
            return False
        at += 4 + size
        seen += 1
    return seen > 0 and (at == len(data) if whole else True)


class _Range:
    """The unpacked bytes from a block on, and up to where records of a range of bytes may start."""

    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        self.file, self.at, self.held, self.place = open(path, "rb"), begin, b"", 0
        self.end, self.limit, self.over = end, None, False

    def more(self) -> bool:
        """Unpacks the next block."""
        if self.limit is None and self.end is not None and self.at >= self.end:
            self.limit = self.place + len(self.held)
        got = None if self.over else _block_at(self.file, self.at)
        if got is None:
            self.over = True
            return False
        self.at += got[0]
        self.held += got[1]
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        self.place += len(out)
        return out

    def here(self) -> bool:
        """Whether a record that starts in the range stands next."""
        while not self.held and self.more():
            pass
        return bool(self.held) and (self.limit is None or self.place < self.limit)

    def to_record(self, contigs: int) -> None:
        """On to the first place from which records follow each other."""
        least = GUESS
        while True:
            while len(self.held) < least and self.more():
                pass
            for at in range(len(self.held)):
                if fits(self.held, at, contigs, self.over):
                    self.take(at)
                    return
            if self.over:
                self.take(len(self.held))
                return
            least *= 2

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def contigs(self) -> list[str]:
        """Reads the header."""
        if self.take(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        self.take(self.number())
        out = []
        for _ in range(self.number()):
            out.append(self.take(self.number())[:-1].decode())
            self.take(4)
        return out


def _parsed(raw: bytes, contigs: list[str]) -> tuple:
    contig, pos, k, mapq, _, ops, flag, n, _, _, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + k
    cigar = "".join(f"{w >> 4}{'MIDNSHP=X'[w & 15]}" for w in struct.unpack_from(f"<{ops}I", raw, at))
    at += 4 * ops
    letters = "=ACMGRSVTWYHKDBN"
    sequence = "".join(letters[b >> 4] + letters[b & 15] for b in raw[at : at + (n + 1) // 2])[:n]
    at += (n + 1) // 2 + n
    tags, sizes = {}, {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            tags[tag], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            at += 5 + sizes[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += sizes[kind]
    return raw[32 : 31 + k].decode(), flag, contigs[contig] if contig >= 0 else None, pos + 1, mapq, cigar, sequence, tags.get("CB"), tags.get("UB"), tags.get("GX"), tags.get("XT")


@dataclass
class _Part(InputPartition):
    head: str
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int = PART_BYTES):
        self.path, self.size = path, size

    def partitions(self):
        head, files = self.path, [self.path]
        if os.path.isdir(self.path):
            head = os.path.join(self.path, HEADER)
            files = bodies(self.path) or [head]
        ranges = [(f, a, min(a + self.size, os.path.getsize(f))) for f in files for a in range(0, os.path.getsize(f), self.size)]
        return [_Part(head, *r) for r in ranges] or [_Part(head, head, 0, 0)]

    def read(self, partition: _Part):
        p, s = partition, _Range(partition.head)
        contigs, begin = s.contigs(), p.begin
        if begin:
            with open(p.path, "rb") as f:
                begin = first_block(f, begin, p.end)
            if begin is None:
                return
        if begin or p.path != p.head:
            s = _Range(p.path, begin, p.end)
        else:
            s = _Range(p.path, 0, p.end)
            s.contigs()
        if begin:
            s.to_record(len(contigs))
        rows = []
        while s.here():
            rows.append(_parsed(s.take(s.number()), contigs))
            if len(rows) == 2000:
                yield self.batch(rows)
                rows = []
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()] + [pa.string()] * 6
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagged_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(mounted(self.options["path"]), int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write_bam(records: DataFrame, genes: DataFrame, path: str, command: str = "", version: str = "1") -> None:
    """convert()'s alignments and genes (gene) -> a BAM folder at a mounted path, in input order. A gene's place among the
    sorted genes is its contig's number; the genes come to the driver, as many as the annotation has."""
    spark = records.sparkSession
    ship(spark)
    spark.dataSource.register(BamSource)
    names = [r[0] for r in genes.select("gene").distinct().orderBy("gene").collect()]
    ids = spark.createDataFrame([(g, i) for i, g in enumerate(names)], "primary_gene string, contig int")
    rows = in_order(records.join(ids, "primary_gene"), "ord")
    raw = F.expr("if(quality_text is null, null, unhex(array_join(transform(sequence(1, length(quality_text)), i -> lpad(hex(ascii(substring(quality_text, i, 1)) - 33), 2, '0')), '')))")
    rows = rows.select("name", "contig", "sequence", raw.alias("quality"), "barcode", "umi", "genes", "xt")
    publish(rows, "tagged_bam", path, lambda _: header(names, command, version), block(b""))


def read_bam(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """name, flag, contig, pos (from 1), mapq, cigar, sequence, and the tags cell (CB), umi (UB), genes (GX), gene (XT), of a
    folder or a file; a task for each part_bytes."""
    ship(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("tagged_bam").option("part_bytes", part_bytes).load(path)
