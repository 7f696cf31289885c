"""Gene bodies on a graph: genes of an annotation, projected on reference paths, become paths of their own.

The steps of a gene's path are the steps of its sequence's path that its span overlaps, in order; a gene on the reverse
strand walks them backwards, each reversed. The gene map follows from the new paths' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skein.operators.counting import node_spans, overlaps
from skein.sources.writers import gene_map_of_new_paths


def gene_bodies(genes: DataFrame, nodes: DataFrame, steps: DataFrame, suffix: str = "_R1") -> DataFrame:
    """genes (path, gene, start, end, reverse; as from readers.read_gtf), nodes (node, seq) and steps (path, step_ord,
    node, path_rev) -> steps of the new paths: path (gene and suffix), step_ord, node, path_rev. A gene given twice
    (on two paths, say) keeps the spans in order of path and start, one path for all."""
    spans = node_spans(steps, nodes.select("node", F.length("seq").cast("long").alias("length")))
    hit = overlaps(spans, genes.select("path", "gene", "start", "end", "reverse"), keep=["step_ord", "node_start", "reverse"])
    hit = hit.join(steps.select("path", "step_ord", "path_rev"), ["path", "step_ord"])
    along = F.when(F.col("reverse"), -F.col("node_start")).otherwise(F.col("node_start"))
    w = Window.partitionBy("gene").orderBy("path", "start", along)
    return hit.select(
        F.concat("gene", F.lit(suffix)).alias("path"),
        (F.row_number().over(w) - 1).alias("step_ord"),
        "node",
        (F.col("path_rev") != F.col("reverse")).alias("path_rev"),
    )


def annotate(genes: DataFrame, nodes: DataFrame, steps: DataFrame, suffix: str = "_R1") -> tuple[DataFrame, DataFrame]:
    """All steps with those of gene bodies added, and the map (path, gene) of the paths that are new."""
    after = steps.select("path", "step_ord", "node", "path_rev").union(gene_bodies(genes, nodes, steps, suffix))
    return after, gene_map_of_new_paths(steps, after)
