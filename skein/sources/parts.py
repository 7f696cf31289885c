"""Folders of binary parts, written by tasks: `part-<task>` files that, with a header before and an end behind, make one
file in order of name. Tasks write their own part under a hidden name, the commit names those that count, the header comes
last, and the folder appears by rename. No body passes through the driver. Paths are such that the driver and executors
have mounted.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

HEADER, END = "part-header", "part-~end"


@dataclass
class Written(WriterCommitMessage):
    temp: str
    name: str
    count: int


class PartsWriter(DataSourceArrowWriter):
    """Subclasses give body(batches, file) -> a count that the header needs."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def body(self, batches, f) -> int:
        raise NotImplementedError

    def write(self, iterator) -> Written:
        name = f"part-{TaskContext.get().partitionId():08d}"
        temp = os.path.join(self.path, f".{name}-{uuid.uuid4().hex}")
        os.makedirs(self.path, exist_ok=True)
        with open(temp, "wb") as f:
            return Written(temp, name, self.body(iterator, f))

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            os.replace(m.temp, os.path.join(self.path, m.name))
        with open(os.path.join(self.path, ".count"), "w") as f:
            f.write(str(sum(m.count for m in messages)))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temp):  # what others wrote here stays
                os.remove(m.temp)


def mounted(path: str) -> str:
    return path[len("file://") :] if path.startswith("file://") else path


def bodies(folder: str) -> list[str]:
    return [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.startswith("part-") and n not in (HEADER, END)]


def publish(rows: DataFrame, form: str, path: str, header: Callable[[int], bytes], end: bytes = b"", **options) -> None:
    """Writes rows, in their partitions' order, by the data source `form`; an older folder is replaced at the end."""
    path = mounted(path)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        rows.write.format(form).mode("append").options(path=temp, **options).save()
        told = os.path.join(temp, ".count")
        with open(told) as f:
            count = int(f.read())
        for n in os.listdir(temp):
            if n.startswith("."):  # the count, and attempts that didn't count
                os.remove(os.path.join(temp, n))
        for name, data in ((HEADER, header(count)), (END, end)):
            if data:
                with open(os.path.join(temp, name), "wb") as f:
                    f.write(data)
        if os.path.exists(path):
            os.replace(path, f"{temp}.old")
        os.replace(temp, path)
        shutil.rmtree(f"{temp}.old", ignore_errors=True)
    except BaseException:
        shutil.rmtree(temp, ignore_errors=True)
        raise


def as_one_file(folder: str, path: str) -> None:
    """A folder's parts behind each other in one file, for tools that need one; whoever calls copies all bytes."""
    temp, end = f"{path}.tmp", os.path.join(folder, END)
    with open(temp, "wb") as out:
        for n in [os.path.join(folder, HEADER), *bodies(folder), *([end] if os.path.exists(end) else [])]:
            with open(n, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 24)
    os.replace(temp, path)
