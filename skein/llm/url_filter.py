"""URL rules in a sorted digest array.

The rules (host, path, verdict) are written once as a binary file into the shared folder: sorted 64-bit xxhash keys, the
offsets of the full rule strings, and the strings. Every executor gets the file through the cluster's file distribution
and memory-maps it. A batch of URLs makes its probes (each host suffix with each prefix whose length some rule path
has), finds them in the keys with one vectorised binary search, and confirms the stored full string, so a collision of
digests cannot decide. The longest confirmed rule wins.

Edge cases: a null URL, an empty one or one without `://` has an empty host and path and fits no rule; a URL that fits
no rule gets the default verdict (allow: this is a list of exceptions, unlisted addresses pass); equal rules given twice
keep the first verdict; without rules every URL gets the default; repeated rows are judged alike; only page_id and url
are read.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from skein.session import scratch

from .common import prepare

#: A file goes to every executor's disk, not its heap; rules that take more than this make several files, all of which a
#: URL is looked up in.
MAX_INDEX_BYTES = 256 << 20

_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no `://`."""
    if not url:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def build_index(rules: list[tuple[str, str]], keyed=xxhash.xxh64_intdigest) -> bytes:
    """The file of rules (`host/path`, verdict)."""
    first: dict[str, str] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        first.setdefault(host.translate(_LOWER) + slash + path, verdict)
    entries = sorted((keyed(r.encode()), r.encode(), v.encode()) for r, v in first.items())
    keys = np.array([k for k, _, _ in entries], dtype="<u8")
    blob = b"".join(r + b"\0" + v for _, r, v in entries)
    at = np.cumsum([0] + [len(r) + 1 + len(v) for _, r, v in entries]).astype("<u8")
    lengths = np.array(sorted({len(r) - len(r.partition("/")[0]) for r in first}), dtype="<u8")
    labels = max((r.partition("/")[0].count(".") + 1 for r in first), default=0)
    return struct.pack("<QQQ", len(keys), len(lengths), labels) + keys.tobytes() + at.tobytes() + lengths.tobytes() + blob


class DigestArray:
    """A memory-mapped file of build_index()."""

    def __init__(self, path: str, keyed=xxhash.xxh64_intdigest):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m, self.labels = struct.unpack_from("<QQQ", self.data)  # labels: the most that a rule's host has
        self.keys = np.frombuffer(self.data, "<u8", n, 24)
        self.at = np.frombuffer(self.data, "<u8", n + 1, 24 + 8 * n)
        self.lengths = np.frombuffer(self.data, "<u8", m, 24 + 8 * (2 * n + 1)).tolist()
        self.blob = 24 + 8 * (2 * n + 1 + m)
        self.keyed = keyed

    def find(self, probes: list[str]) -> list[str | None]:
        """The verdict of each probe that is a rule."""
        out: list[str | None] = [None] * len(probes)
        if not len(self.keys) or not probes:
            return out
        raw = [p.encode() for p in probes]
        want = np.fromiter(map(self.keyed, raw), np.uint64, len(raw))
        low, high = np.searchsorted(self.keys, want, "left"), np.searchsorted(self.keys, want, "right")
        for i in np.nonzero(low < high)[0]:
            for j in range(low[i], high[i]):
                rule, _, verdict = self.data[self.blob + int(self.at[j]) : self.blob + int(self.at[j + 1])].partition(b"\0")
                if rule == raw[i]:
                    out[i] = verdict.decode()
                    break
        return out

    def judge(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        """host, path, longest fitting rule or None, verdict."""
        split = [split_url(u) for u in urls]
        probes, owner = [], []
        for i, (host, path) in enumerate(split):
            if not host:
                continue
            ends = [n for n in self.lengths if n <= len(path)]
            at = len(host) + 1
            for _ in range(self.labels):  # longer endings than any rule's host needn't be looked up
                at = host.rfind(".", 0, at - 1) + 1
                suffix = host[at:]
                probes.extend(suffix + path[:n] for n in ends)
                owner.extend([i] * len(ends))
                if not at:
                    break
        best: dict[int, tuple[int, str, str]] = {}
        for i, p, v in zip(owner, probes, self.find(probes)):
            if v is not None and (i not in best or len(p) > best[i][0]):
                best[i] = (len(p), p, v)
        return [(*s, best[i][1], best[i][2]) if i in best else (*s, None, default) for i, s in enumerate(split)]


def _slices(rules: list[tuple[str, str]], most: int):
    """Runs of rules whose files take about `most` bytes at most."""
    first, size = 0, 0
    for i, (rule, verdict) in enumerate(rules):
        own = 18 + len(rule.encode()) + len(verdict.encode())
        if size and size + own > most:
            yield rules[first:i]
            first, size = i, 0
        size += own
    yield rules[first:]


def judge_all(indexes: list[DigestArray], urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
    """The longest rule of all files decides, of equal ones the first file's."""
    best = indexes[0].judge(urls, default)
    for index in indexes[1:]:
        best = [b if a[2] is None or (b[2] is not None and len(b[2]) >= len(a[2])) else a for a, b in zip(index.judge(urls, default), best)]
    return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", most: int = MAX_INDEX_BYTES) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict; a row per row, no shuffle."""
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    names, folder = [], scratch(spark, "rules")
    for k, some in enumerate(_slices(rules, most)):
        path = f"{folder}-{k}.idx"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(build_index(some)))
        out.close()
        spark.sparkContext.addFile(path)
        names.append(path.rsplit("/", 1)[1])

    def run(batches):
        indexes = [DigestArray(SparkFiles.get(n)) for n in names]
        for b in batches:
            rows = judge_all(indexes, b.column(1).to_pylist(), default)
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["page_id", "host", "path", "rule", "verdict"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
