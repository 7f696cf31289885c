"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.session import remove, saved, scratch, ship

#: Rows in one Arrow batch: whole texts may be long, so batches stay small.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_texts(docs: DataFrame, keep: list[str], fn: Callable[[list[str]], dict], schema: str, with_text: bool = False) -> DataFrame:
    """Add columns made from whole texts (null: empty). fn turns a list of texts into a dict of columns; it is built in
    each task by calling the zero-argument factory given. with_text returns the text, too, as it is."""
    names = keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fn()
        for b in batches:
            texts = [t or "" for t in b.column(len(names)).to_pylist()]
            cols = f(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(names) + with_text)] + [v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()],
                names=names + ["text"] * with_text + list(cols),
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    kept += ", text string" * with_text
    return docs.select(*names, F.col("text").cast("string")).mapInArrow(run, f"{kept}, {schema}")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Parts that the rows of a group are dealt to.
PARTS = 1024


def with_group(rows: DataFrame, keys: list[str], within: str, first: list[Column], again: list[Column]) -> DataFrame:
    """rows with aggregates of their group (of equal keys, never null) added, though one group may hold a third of all rows:
    a group's rows are dealt to PARTS parts by the column `within`. `first` aggregates a part, `again` the parts' results,
    which then reach the rows by way of their part, so no task meets more than a part of a group's rows or PARTS results."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(within), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy(*keys, "__part").agg(*first)
    told = parts.select(*keys, "__part").join(parts.groupBy(*keys).agg(*again), keys)
    return dealt.join(told, [*keys, "__part"]).drop("__part")


def with_told(rows: DataFrame, table: DataFrame, keys: list[str], within: str) -> DataFrame:
    """rows left-joined with a table that has one row a key, though one key (or null) may be that of a third of all rows:
    rows are dealt to PARTS parts by the column `within`, and what the table tells of a key goes to its parts."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(within), F.lit(PARTS)).cast("int"))
    told = dealt.select(*keys, "__part").distinct().join(table, keys)
    return dealt.join(told, [*keys, "__part"], "left").drop("__part")


#: Edges that a task contracts at once.
CONTRACT = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task -> (node, smallest node of its component) for every node that isn't the smallest. A task of many
    edges does so for each CONTRACT of them or a few more, so that what it holds is bounded."""
    parent: dict = {}

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    def stars(schema):
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], schema.field(k).type) for k in (0, 1)], names=["u", "v"])

    edges = 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        edges += b.num_rows
        if edges > CONTRACT:
            yield stars(b.schema)
            edges = 0
    if parent:
        yield stars(b.schema)


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """Components of an undirected graph: edges (u, v) of integers or binaries -> (node, component), where component is
    the smallest node reachable. Edges are contracted to stars in chunks of CONTRACT first; then rounds of large-star and
    small-star join the chunks' stars until all are stars of their smallest nodes; a node that very many edges share is
    dealt to parts. A round is written to the shared folder, and only counts come to the driver. Loops and nulls are ignored; nodes without edges are not returned."""
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType.simpleString()
    raw = saved(edges.select("u", "v").where("u is not null and v is not null and u <> v"), f"{folder}/raw")
    chunks = -(-raw.count() // CONTRACT)
    e = saved(raw.coalesce(max(1, chunks)).mapInArrow(_contract, f"u {kind}, v {kind}"), f"{folder}/cc0")
    k = 0
    while chunks > 1:
        once = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if once.where("n > 1").isEmpty() and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        k += 1
        both = with_group(e.union(e.select("v", "u")), ["u"], "v", [F.min("v").alias("m")], [F.min("m").alias("m")])
        large = both.where("v > u").withColumn("m", F.least("u", "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, f"{folder}/cc{k}a")
        m = with_group(large, ["u"], "v", [F.min("v").alias("m")], [F.min("m").alias("m")])
        small = m.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/cc{k}")
        remove(spark, f"{folder}/cc{k}a")
        remove(spark, f"{folder}/cc{k - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is changed in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
