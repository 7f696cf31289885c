"""Alignments from a pipe: bytes that arrive become files of whole lines in the shared folder, for streams to read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession

#: Bytes of a file, about.
FILE_BYTES = 256 << 20
_READ = 1 << 20


def spooled(spark: SparkSession, source: BinaryIO, folder: str, size: int = FILE_BYTES) -> Iterator[str]:
    """Writes source to folder/lines-<k>.json, a file at a time, and tells each when it is whole. A file holds whole lines of
    `size` bytes or a few more (a longer line stays in one file); it appears by a rename, and no more than a megabyte and
    the line at hand is held."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rest, k = b"", 0
    while True:
        hidden, written, out = path(f"{folder}/_lines-{k:08d}.json"), 0, None
        while written < size:
            data = source.read(_READ)
            cut = (rest + data).rpartition(b"\n") if data else (rest, b"", b"")
            rest = cut[2]
            whole = cut[0] + cut[1]
            if whole:
                out = out or fs.create(hidden, True)
                out.write(bytearray(whole))
                written += len(whole)
            if not data:
                break
        if out:
            out.close()
            name = f"{folder}/lines-{k:08d}.json"
            fs.rename(hidden, path(name))
            k += 1
            yield name
        if not data:
            return
