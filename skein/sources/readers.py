"""Readers: alignments as JSON lines, graphs as GFA, path maps, FASTQ, SAM text, GTF, count tables, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.operators.checks import InputError
from skein.session import saved, scratch

#: The fields of an alignment in its JSON form; 64-bit integers arrive as strings, bytes as base64.
READ_SCHEMA = (
    "name string, sequence string, quality string, start array<int>, subpath array<struct<score:int, next:array<int>, "
    "connection:array<struct<next:int,score:int>>, path:struct<mapping:array<struct<position:struct<node_id:string,"
    "offset:string,is_reverse:boolean>, edit:array<struct<from_length:int,to_length:int,sequence:string>>>>>>>"
)


def place_columns() -> list:
    """value, file, block, id of a text source (streaming, too): where each line stands."""
    return [F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]


def numbered(lines: DataFrame, columns: list[str] = ["value"]) -> DataFrame:  # noqa: B006
    """place_columns() -> value (or what columns names), ord: the lines' dense place over all files in path order. One
    count a file block comes together in a small table; lines themselves are not shuffled. Ids need only be dense and
    ascending within a block. Lines are scanned twice: give stored ones, since files may be split otherwise when a second
    scan is planned."""
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return lines.join(base, ["file", "block"]).select(*columns, (F.col("base") + F.col("id") - F.col("first")).alias("ord"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(saved(spark.read.text(path).select(*place_columns()), scratch(spark, "lines")))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, quality (binary), start, subpath, ord; absent values take their defaults. ord is the place among
    the lines that aren't blank: ids are given to those alone, after the filter. The lines are written to the shared
    folder first, with their places."""
    kept = spark.read.text(path).where("trim(value) <> ''").select(*place_columns())
    return parse_alignments(numbered(saved(kept, scratch(spark, "lines"))))


def parse_alignments(lines: DataFrame) -> DataFrame:
    """value (JSON), ord -> read_alignments' columns."""
    return normalise(lines.select(F.from_json("value", READ_SCHEMA).alias("r"), "ord").select("r.*", "ord"))


def normalise(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("sequence", F.lit("")).alias("sequence"),
        F.unbase64("quality").alias("quality"),
        F.coalesce("start", F.expr("cast(array() as array<int>)")).alias("start"),
        F.expr(
            "transform(coalesce(subpath, array()), s -> struct(coalesce(s.score, 0) as score, array_union(coalesce(s.next, array()), transform(coalesce(s.connection, array()), c -> coalesce(c.next, 0))) as next, "
            "transform(coalesce(s.path.mapping, array()), m -> struct(bigint(coalesce(m.position.node_id, '0')) as node, bigint(coalesce(m.position.offset, '0')) as offset, coalesce(m.position.is_reverse, false) as is_reverse, "
            "transform(coalesce(m.edit, array()), e -> struct(bigint(coalesce(e.from_length, 0)) as from_length, bigint(coalesce(e.to_length, 0)) as to_length, coalesce(e.sequence, '') as sequence)) as edit)) as mapping))"
        ).alias("subpath"),
        "ord",
    )


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, seq) and steps (path, step_ord, node, path_rev)."""
    f = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    nodes = f.where("f[0] = 'S'").select(F.expr("bigint(f[1])").alias("node"), F.expr("f[2]").alias("seq"))
    steps = f.where("f[0] = 'P'").select(F.expr("f[1]").alias("path"), F.posexplode(F.split(F.expr("f[2]"), ",")).alias("step_ord", "s")).where("s <> ''")
    return nodes, steps.select("path", "step_ord", F.expr("bigint(substring(s, 1, length(s) - 1))").alias("node"), F.expr("right(s, 1) = '-'").alias("path_rev"))


def map_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """value -> path, gene of a map's rows, and of the rows that lack one of the two (null: no such field). Blank lines and
    those that start with # are no rows."""
    f = lines.where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t", -1).alias("f"))
    rows = f.select(F.try_element_at("f", F.lit(1)).alias("path"), F.try_element_at("f", F.lit(2)).alias("gene"))
    return rows, rows.where("gene is null or path = '' or gene = ''")


def read_path_map(spark: SparkSession, path: str) -> DataFrame:
    """path, gene. Blank lines and those that start with # are skipped; two non-empty fields are needed."""
    rows, bad = map_rows(spark.read.text(path))
    if not bad.isEmpty():
        raise InputError(f"a path map row needs two non-empty fields: {bad.first()}")
    if rows.isEmpty():
        raise InputError("the path map has no rows")
    return rows.distinct()


def tag_fastq(spark: SparkSession, path: str, barcode: str) -> DataFrame:
    """FASTQ records with `_<barcode>_<counter as UMI>` added to their names: name, sequence, quality, in order of ord."""
    from skein.functions.molecule import umi_of

    t = numbered_lines(spark, path).withColumn("rec", F.floor(F.col("ord") / 4)).withColumn("k", F.col("ord") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    r = t.groupBy("rec").agg(pick(0).alias("h"), pick(1).alias("sequence"), pick(3).alias("quality"))
    name = F.concat(F.element_at(F.split(F.expr("substring(h, 2)"), r"\s"), 1), F.lit(f"_{barcode}_"), umi_of(F.col("rec")))
    return r.select(F.col("rec").alias("ord"), name.alias("name"), "sequence", "quality")


def read_gtf(spark: SparkSession, path: str, feature: str = "gene") -> DataFrame:
    """path (sequence name), gene, start, end (0-based, half-open), reverse."""
    f = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", "\t", -1).alias("f")).where(F.expr("size(f) >= 9") & (F.expr("f[2]") == feature))
    return f.select(F.expr("f[0]").alias("path"), F.regexp_extract(F.expr("f[8]"), 'gene_id "([^"]+)"', 1).alias("gene"), F.expr("bigint(f[3]) - 1").alias("start"), F.expr("bigint(f[4])").alias("end"), F.expr("f[6] = '-'").alias("reverse"))


def read_sam_tags(spark: SparkSession, path: str) -> DataFrame:
    """SAM text -> name, pos, cell (CB), umi (UB), gene (XT); absent tags are null."""
    t = spark.read.text(path).where("not startswith(value, '@') and value <> ''")
    tag = lambda n: F.nullif(F.regexp_extract("value", f"\t{n}:Z:([^\t]*)", 1), F.lit(""))
    f = F.split("value", "\t")
    return t.select(f[0].alias("name"), f[3].cast("long").alias("pos"), tag("CB").alias("cell"), tag("UB").alias("umi"), tag("XT").alias("gene"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell, count from a table with a header; lines that start with # are comments."""
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").schema("gene string, cell string, count long").csv(path)


def read_matrix(spark: SparkSession, matrix: str, rows: str, cols: str) -> DataFrame:
    """A MatrixMarket file with the names of its rows and columns -> cell, gene, count."""
    m = numbered_lines(spark, matrix).where("not startswith(value, '%')")
    body = m.join(m.agg(F.min("ord").alias("o")), m["ord"] > F.col("o")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    e = body.select(F.expr("bigint(f[0]) - 1").alias("r"), F.expr("bigint(f[1]) - 1").alias("c"), F.expr("double(f[2])").alias("count"))
    name = lambda p, k, n: numbered_lines(spark, p).select(F.col("ord").alias(k), F.col("value").alias(n))
    return e.join(name(rows, "r", "cell"), "r").join(name(cols, "c", "gene"), "c").select("cell", "gene", "count")
