"""Training order: a keyed permutation of all sequences, written as fixed-stride shards.

Token ids of the documents a task reads, each document closed by an end id, are laid end to end and cut into sequences of
one size; only a task's last one is padded. They are written once, with the task's number and their place in it; a
sequence's number is its place after all sequences of the tasks before, so numbers are dense, 0..N-1, and need no shuffle
(one count a task comes to the driver). A balanced Feistel network over the next even power of two, walked along its
cycles until it falls below N, sends a number to its slot in the global order. No shuffle table is kept: the key alone
gives the order and its inverse. Slots are dealt in ranges of shard_rows to shards; each shard is one file of records of
one stride in slot order, so that slot k stands in shard k // shard_rows at byte (k % shard_rows) * stride. A reader
resumes at any slot by one seek, reading one file in sequence.

Only task and place go through Python for the slot; ids stay with the JVM, and a record goes straight to the partition of
its shard, without sampling. Shards are written in passes over ranges of slots, so only one pass's records are in flight.
Files are written by Spark's own writer (any store, committed by task, safe against lost executors). A record is the ids
as little-endian unsigned integers of `width` bytes and an end byte.

Resuming: the sequences, and their layout (count, key, sizes), are stored beside the shards. A second run into the same
folder cuts nothing anew, leaves passes that have ended (their _SUCCESS is there) and writes the others; with another key
or size it is refused. Where a sequence is cut follows from how the input is split over tasks, so a new folder filled by
another cluster may hold the same ids in another order; a folder once begun doesn't change.

Edge cases: null text counts as empty (the end id only); a null doc_id stays null in the lists; repeated rows are all
written; an empty table writes no shard; very long texts are cut, never shortened; ids that don't fit the width are
refused; only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.session import exists, shuffles_dropped

from .bpe import cached_tokenizer
from .common import mix64, prepare, saved

SEQUENCE = 2048
SHARD_ROWS = 4096
PASSES = 4
ROUNDS = 6
#: Tasks that write a pass, at most; with more shards than that a task writes several.
WRITERS = 20_000


def stride_of(size: int = SEQUENCE, width: int = 2) -> int:
    return width * size + 1


def feistel(x: np.ndarray, key: int, n: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at x: a balanced Feistel network with cycle walking."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        return (left << h) | right

    out = once(np.asarray(x, dtype=np.uint64).copy())
    while (over := out >= np.uint64(max(n, 1))).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def sequences_of(docs: DataFrame, path: str, end_id: int, pad_id: int, size: int = SEQUENCE, width: int = 2) -> DataFrame:
    """doc_id, text -> ids (binary, width * size bytes), n_tokens (without padding), ids_crc32, doc_ids (of the documents
    in it, in order), start (ids of the first of them that stand in earlier sequences), task and place in it."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    pad = int(pad_id).to_bytes(width, "little")
    form, most = f"<u{width}", (1 << 8 * width) - 1

    def run(batches):
        encode = cached_tokenizer(path).encode
        held, whose = bytearray(), []  # ids not yet cut; [doc_id, bytes of it already cut, bytes of it held]
        task, place = TaskContext.get().partitionId(), 0

        def cut(n):
            part, n = bytes(held[:n]), n
            del held[:n]
            docs_in, start = [w[0] for w in whose], whose[0][1] // width
            while n:
                take = min(n, whose[0][2])
                whose[0][1] += take
                whose[0][2] -= take
                n -= take
                if not whose[0][2]:
                    whose.pop(0)
            return part, docs_in[: len(docs_in) - max(0, len(whose) - bool(whose and whose[0][1]))], start

        def batch(rows):
            nonlocal place
            place += len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] + pad * (size - len(r[0]) // width) for r in rows], pa.binary()),
                    pa.array([len(r[0]) // width for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[0]) for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(id_type)),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(range(place - len(rows), place), pa.int64()),
                ],
                names=["ids", "n_tokens", "ids_crc32", "doc_ids", "start", "task", "place"],
            )

        id_type = pa.int64()
        for b in batches:
            id_type, rows = b.column(0).type, []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encode(t or "") + end, "<u4")
                if ids.max() > most:
                    raise ValueError(f"ids over {most} don't fit a record of {width} bytes an id")
                part = ids.astype(form).tobytes()
                held += part
                whose.append([d, 0, len(part)])
                while len(held) >= width * size:
                    rows.append(cut(width * size))
            if rows:
                yield batch(rows)
        if held:
            yield batch([cut(len(held))])

    return docs.select("doc_id", "text").mapInArrow(run, f"ids binary, n_tokens long, ids_crc32 long, doc_ids array<{kind}>, start long, task int, place long")


def assign_slots(sequences: DataFrame, key: int) -> tuple[DataFrame, int]:
    """Stored sequences (task, place, ...) -> with number (0..N-1) and slot (the permutation of it) instead of task and
    place, and N. One count a task comes to the driver, and eight bytes a task go back."""
    told = {r[0]: r[1] for r in sequences.groupBy("task").agg(F.count(F.lit(1))).collect()}
    counts = np.zeros(max(told, default=-1) + 2, np.int64)
    counts[[t + 1 for t in told]] = list(told.values())
    ahead = sequences.sparkSession.sparkContext.broadcast(np.cumsum(counts))
    n = int(counts.sum())

    @F.arrow_udf("struct<number: bigint, slot: bigint>")
    def placed(task: pa.Array, place: pa.Array) -> pa.Array:
        number = ahead.value[task.to_numpy()] + place.to_numpy()
        return pa.StructArray.from_arrays([pa.array(number), pa.array(feistel(number, key, n))], names=["number", "slot"])

    names = [c for c in sequences.columns if c not in ("task", "place")]
    return sequences.withColumn("at", placed("task", "place")).select(*names, "at.number", "at.slot"), n


def write_shards(slots: DataFrame, n: int, path: str, shard_rows: int = SHARD_ROWS, passes: int = PASSES) -> None:
    """slot, ids -> path/pass=<p>/shard=<s>/part-*: the records of slots s * shard_rows .. in order."""
    spark = slots.sparkSession
    shards = -(-n // shard_rows)
    each = max(1, -(-shards // passes))
    group = -(-each // WRITERS)
    placed = slots.select("slot", F.col("ids").cast("string").alias("ids"), F.floor(F.col("slot") / shard_rows).cast("long").alias("shard"))
    for p in range(-(-shards // each)):
        out, first, last = f"{path}/pass={p}", p * each, min(shards, (p + 1) * each) - 1
        if exists(spark, f"{out}/_SUCCESS"):
            continue
        own = placed.where(F.col("shard").between(first, last)).withColumn("writer", F.floor((F.col("shard") - first) / group).cast("int"))
        own = own.repartitionById(-(-(last - first + 1) // group), "writer").sortWithinPartitions("shard", "slot").select("shard", "ids")
        with shuffles_dropped(spark):
            own.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").mode("overwrite").text(out)


def read_shards(spark: SparkSession, path: str, size: int = SEQUENCE, width: int = 2):
    """An RDD of the records' ids (bytes) in written shards, read by fixed stride: a large shard splits over tasks."""
    return spark.sparkContext.binaryRecords(f"{path}/pass=*/shard=*", stride_of(size, width)).map(lambda r: bytes(r[:-1]))


def materialise(
    docs: DataFrame, tokenizer: str, out: str, key: int = 20240229, end_id: int = 2, pad_id: int = 0, size: int = SEQUENCE, shard_rows: int = SHARD_ROWS, width: int = 2, passes: int = PASSES
) -> DataFrame:
    """Writes the shards of docs to out, or ends what an earlier run into out began, and returns where each sequence
    stands: number, slot, shard, byte (of its record in the shard), n_tokens, ids_crc32, doc_ids, start."""
    spark = docs.sparkSession
    prepare(spark)
    layout = {"key": key, "end_id": end_id, "pad_id": pad_id, "size": size, "shard_rows": shard_rows, "width": width, "passes": passes}
    if exists(spark, f"{out}/layout/_SUCCESS"):
        told = spark.read.parquet(f"{out}/layout").first().asDict()
        if {k: told[k] for k in layout} != layout:
            raise ValueError(f"{out} was begun with {told}, not {layout}")
        stored = spark.read.parquet(f"{out}/sequences")
        slots, n = assign_slots(stored, key)
        if n != told["n"]:
            raise ValueError(f"{out}/sequences holds {n} sequences, not {told['n']}")
    else:
        stored = saved(sequences_of(docs, tokenizer, end_id, pad_id, size, width), f"{out}/sequences")
        slots, n = assign_slots(stored, key)
        spark.createDataFrame([tuple(layout.values()) + (n,)], ", ".join(f"{k} long" for k in [*layout, "n"])).coalesce(1).write.mode("overwrite").parquet(f"{out}/layout")
    write_shards(slots.select("ids", "slot"), n, out, shard_rows, passes)
    return slots.select(
        "number", "slot", F.floor(F.col("slot") / shard_rows).cast("long").alias("shard"), ((F.col("slot") % shard_rows) * stride_of(size, width)).alias("byte"), "n_tokens", "ids_crc32", "doc_ids", "start"
    )
