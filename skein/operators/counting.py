"""Molecule counts, gene bodies by range, and how faithful node scores are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Width of the bins that make the range join an equi-join.
BIN = 1 << 14
#: Steps of a path that one task sums up.
BLOCK = 1 << 18


def molecule_counts(records: DataFrame) -> DataFrame:
    """records (cell, gene, umi) -> gene, cell, count of distinct umi; position plays no part."""
    return records.where("gene is not null").groupBy("gene", "cell").agg(F.count_distinct("umi").alias("count"))


def cell_gene_matrix(counts: DataFrame) -> DataFrame:
    """gene, cell, count -> a row per cell with all its genes: cell, genes (a map of gene to count, in byte order). A map
    has no limit of columns; pivot() by a known, small gene list gives a wide table."""
    each = F.array_sort(F.collect_list(F.struct("gene", "count")))
    return counts.groupBy("gene", "cell").agg(F.sum("count").alias("count")).groupBy("cell").agg(F.map_from_entries(each).alias("genes"))


def wide(counts: DataFrame, genes: list[str]) -> DataFrame:
    """A column per gene of the list."""
    return counts.groupBy("cell").pivot("gene", genes).agg(F.sum("count"))


def running_total(rows: DataFrame, key: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """rows with `total`, the sum of value over a key's rows up to this one by order (whole numbers, distinct in a key). A
    key's rows are dealt to blocks of `block` orders, their sums are added up over the key's blocks, and inside a block a
    window goes on from there: no task holds more than a block's rows, or one sum for each block of a key."""
    dealt = rows.withColumn("__block", F.floor(F.col(order) / block))
    sums = dealt.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(key, "__block", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__begun"))
    inside = F.sum(value).over(Window.partitionBy(key, "__block").orderBy(order))
    return dealt.join(begun, [key, "__block"]).withColumn("total", (F.col("__begun") + inside).cast("long")).drop("__block", "__begun")


def node_spans(steps: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """steps (path, step_ord, node) and nodes (node, length) -> path, node, node_start, node_end (0-based, half-open)."""
    s = running_total(steps.join(nodes, "node"), "path", "step_ord", "length", block).withColumnRenamed("total", "node_end")
    return s.select("path", "step_ord", "node", (F.col("node_end") - F.col("length")).cast("long").alias("node_start"), "node_end")


def overlaps(spans: DataFrame, features: DataFrame, width: int = BIN, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """spans (path, node, node_start, node_end) and features (path, gene, start, end), half-open -> path, node, gene, start
    and the columns of keep, wherever they overlap. Both sides are cut into bins, so it is an equi-join; a pair is told in the bin where its
    overlap starts, once."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = spans.where("node_end > node_start").withColumn("bin", bins("node_start", "node_end"))
    right = features.where("end > start").withColumn("bin", bins("start", "end"))
    hit = left.join(right, ["path", "bin"]).where("start < node_end and end > node_start")
    return hit.where(F.col("bin") == F.floor(F.greatest("start", "node_start") / width)).select("path", "node", "gene", "start", *keep)


def fidelity(subpaths: DataFrame, most: int | None = None) -> DataFrame:
    """subpaths (node_score, mapper_score, and if there is one base_quality, the subpath's mean) -> one row: subpaths,
    matching, per mille of them (rounded down), and mean base qualities of matching and of deviating ones. With `most`
    only so many subpaths are looked at (a quick look at a large run)."""
    same = F.col("node_score") == F.col("mapper_score")
    n, ok = F.count(F.lit(1)), F.count_if(same)
    told = [n.alias("subpaths"), ok.alias("matching"), F.when(n > 0, F.floor(ok * 1000 / n)).cast("long").alias("per_mille")]
    if "base_quality" in subpaths.columns:
        told += [F.avg(F.when(on, F.col("base_quality"))).alias(k) for k, on in (("quality_matching", same), ("quality_deviating", ~same))]
    return (subpaths.limit(most) if most else subpaths).agg(*told)
