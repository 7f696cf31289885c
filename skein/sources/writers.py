"""Writers: tagged alignments as SAM text, maps and the summary in their order, gene maps of new paths.

Spark's own text writer and committer do the work, on any store: what fails leaves nothing behind. An output is a folder
whose part files, in order of name, are the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.operators.attribute import transcript_of
from skein.session import in_order

#: Fixed value: the length told of every gene, which has no sequence of its own here.
CONTIG = 1 << 28


def sam_lines(records: DataFrame) -> DataFrame:
    """records (ord, name, sequence, quality_text, barcode, umi, genes, primary_gene, xt) -> ord, value (a SAM line)."""
    seq = F.when(F.col("sequence") == "", F.lit("*")).otherwise(F.col("sequence"))
    cigar = F.when(F.col("sequence") == "", F.lit("*")).otherwise(F.concat(F.length("sequence").cast("string"), F.lit("M")))
    tags = [F.concat(F.lit(f"{t}:Z:"), F.col(c)) for t, c in (("CB", "barcode"), ("CR", "barcode"), ("UB", "umi"), ("UR", "umi"), ("GX", "genes"), ("GN", "genes"), ("XT", "xt"))]
    return records.select("ord", F.concat_ws("\t", "name", F.lit("0"), "primary_gene", F.lit("1"), F.lit("255"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), seq, F.coalesce("quality_text", F.lit("*")), *tags).alias("value"))


def sam_header(genes: DataFrame, command: str, version: str) -> DataFrame:
    """genes (gene) -> ord (negative, before any record), value: one @SQ a gene, in byte order."""
    spark = genes.sparkSession
    ranked = genes.select("gene").distinct().orderBy("gene").withColumn("k", F.monotonically_increasing_id())
    contigs = ranked.select((F.col("k") - (1 << 61)).alias("ord"), F.concat(F.lit("@SQ\tSN:"), "gene", F.lit(f"\tLN:{CONTIG}")).alias("value"))
    ends = [(-(1 << 62), "@HD\tVN:1.6\tSO:unsorted"), (-1, f"@PG\tID:skein\tPN:skein\tVN:{version}\tCL:{command}")]
    return spark.createDataFrame(ends, "ord long, value string").union(contigs)


def write_sam(records: DataFrame, genes: DataFrame, path: str, command: str = "", version: str = "1") -> None:
    """Header and alignments in input order."""
    lines = sam_header(genes, command, version).union(sam_lines(records))
    in_order(lines, "ord").select("value").write.mode("overwrite").text(path)


def by_place(alignments: DataFrame, contig: str = "primary_gene", pos: str = "pos") -> DataFrame:
    """Alignments in coordinate order: contig, position, then the input's order."""
    return alignments.orderBy(contig, pos, "ord")


def write_rows(rows: DataFrame, order: str, columns: list[str], path: str) -> None:
    """Columns as tab-separated text in an order of their own (annotation-sized: one part)."""
    rows.orderBy(order).select(F.concat_ws("\t", *columns)).coalesce(1).write.mode("overwrite").text(path)


def write_map(rows: DataFrame, path: str) -> None:
    """target, gene as sorted text."""
    write_rows(rows, "target", ["target", "gene"], path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The counters, a line each, in the summary's fixed order."""
    write_rows(summary, "place", ["key", "value"], path)


def write_rejected(rejected: DataFrame, path: str) -> None:
    """A warning for each group whose name couldn't be read."""
    told = rejected.select("ord", F.concat(F.lit("warning: skipping "), "read", F.lit(": molecule "), "status").alias("value"))
    in_order(told, "ord").select("value").write.mode("overwrite").text(path)


def gene_map_of_new_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that a step added (path) -> path, gene: its name without the copy suffix."""
    return after.select("path").distinct().join(before.select("path"), "path", "left_anti").select("path", transcript_of(F.col("path")).alias("gene"))
