"""Exon and intron ledgers of genes, and the count modes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MODES = ("gene", "genefull", "genefull_exonoverintron", "genefull_ex50pas")


def path_layers(paths: DataFrame, exon: DataFrame, body: DataFrame) -> DataFrame:
    """paths (path) with the maps exon and body (path, gene) -> path, gene, is_exon. The full name is looked up among
    exons, then the name without copy suffix; then the same in bodies. The first hit wins; a path without any is left
    out. The maps are annotation; Spark broadcasts them where their size allows."""
    bare = F.regexp_replace("path", "_[HR][0-9]+$", "")
    out = paths.select("path", bare.alias("bare")).distinct()
    for k, (m, on) in enumerate(((exon, "path"), (exon, "bare"), (body, "path"), (body, "bare"))):
        out = out.join(m.select(F.col("path").alias(f"key{k}"), F.col("gene").alias(f"gene{k}")), F.col(on) == F.col(f"key{k}"), "left").drop(f"key{k}")
    gene = F.coalesce(*[F.col(f"gene{k}") for k in range(4)])
    return out.select("path", gene.alias("gene"), F.coalesce("gene0", "gene1").isNotNull().alias("is_exon")).where("gene is not null")


def node_genes(steps: DataFrame, layers: DataFrame) -> DataFrame:
    """steps (path, step_ord, node, path_rev) -> node, gene, is_exon (any), gene_rev (of the last step by path, then step)."""
    last = F.max_by("path_rev", F.struct("path", "step_ord"))
    return steps.join(layers, "path").groupBy("node", "gene").agg(F.bool_or("is_exon").alias("is_exon"), last.alias("gene_rev"))


def ledger(mappings: DataFrame, genes: DataFrame) -> DataFrame:
    """mappings (read, node, read_rev, aligned) and genes (node, gene, is_exon, gene_rev) -> read, gene, exonic, intronic,
    fwd, rev, and read_length where mappings have it. Mappings without aligned bases are dropped before the join."""
    n = F.col("aligned")
    same = F.col("read_rev") == F.col("gene_rev")
    part = lambda on: F.sum(F.when(on, n).otherwise(0)).cast("long")
    length = [F.max("read_length").alias("read_length")] if "read_length" in mappings.columns else []
    return (
        mappings.where("aligned > 0")
        .join(genes, "node")
        .groupBy("read", "gene")
        .agg(part(F.col("is_exon")).alias("exonic"), part(~F.col("is_exon")).alias("intronic"), part(same).alias("fwd"), part(~same).alias("rev"), *length)
    )


def count_mode(entries: DataFrame, lengths: DataFrame | None, mode: str) -> DataFrame:
    """Ledger entries, and lengths (read, read_length) unless they have them -> the genes a mode keeps: read, target, forward."""
    if mode not in MODES:
        raise ValueError(f"count mode must be one of {MODES}, not {mode}")
    e = entries.where("exonic + intronic > 0").withColumn("forward", F.col("fwd") >= F.col("rev"))
    w = Window.partitionBy("read")
    if mode == "gene":
        e = (e if lengths is None else e.join(lengths, "read")).where("exonic > 0 and 2 * exonic >= read_length")
    if mode == "genefull_ex50pas":
        e = e.where("not (intronic = 0 and not forward)")
    better = {"genefull_exonoverintron": "intronic = 0", "genefull_ex50pas": "exonic > intronic"}.get(mode)
    if better:
        e = e.withColumn("any_better", F.bool_or(F.expr(better)).over(w)).where(f"({better}) or not any_better")
    return e.select("read", F.col("gene").alias("target"), "forward")
