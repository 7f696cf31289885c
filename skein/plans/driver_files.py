"""The conversion, the readers and the sinks over the star-schema tables, written as the files that they are made for.

An order is a read: its first record has one subpath with a mapping a line, some have a record without subpaths, too, or
that alone; some names can't be read. Files go to the shared folder and are read back from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skein.functions import molecule as mol, quality, scoring
from skein.operators import attribute, counting
from skein.plans.annotate import annotate
from skein.plans.convert import Options, adjusted_mappings, convert, edit_rows, interned, scored_mappings, subpath_scores
from skein.session import ROWS_A_TASK, parted, saved, scratch, tasks_for
from skein.sources import bam, graph_store, rad, readers, writers
from skein.streaming import convert as stream


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def alignments(spark, d) -> DataFrame:
    """The columns of readers.read_alignments. Lines are dealt by read before they are collected, to tasks whose number
    follows the lines': no scan holds lists of all the lines it reads."""
    q = "bigint(l_quantity)"
    edit = f"named_struct('from_length', if(l_returnflag = 'R' and l_linestatus = 'O', bigint(0), {q}), 'to_length', if(l_returnflag = 'R' and l_linestatus = 'F', bigint(0), {q}), 'sequence', if(l_returnflag = 'N', 'A', ''))"
    mapping = F.expr(f"named_struct('node', l_partkey, 'offset', bigint(0), 'is_reverse', l_suppkey % 2 = 1, 'edit', array({edit}))")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", mapping.alias("m"))
    lines = _t(spark, d, "lineitem")
    reads = lines.repartition(tasks_for(spark, lines.count()), "l_orderkey").withColumn("line", line).groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["m"]).alias("mapping"))
    tag = F.concat(F.lit("r"), "k", F.lit("_"), mol.umi_of(F.col("k") % 1000, 16), F.lit("_"), mol.umi_of(F.col("k")))
    name = F.when(F.col("k") % 17 == 0, F.concat(F.lit("r"), "k")).when(F.col("k") % 17 == 1, F.concat(tag, F.lit("A"))).when(F.col("k") % 17 == 2, F.concat(F.expr("substring(cast(k as string), 1, 0)"), F.regexp_replace(tag, ".$", "X"))).otherwise(tag)
    total = "aggregate(mapping, bigint(0), (a, m) -> a + m.edit[0].to_length)"
    sub = "array(named_struct('score', 0, 'next', cast(array() as array<int>), 'mapping', mapping))"
    reads = reads.select("k", name.alias("name"), F.expr(f"array(struct(if(k % 13 = 0, filter({sub}, x -> false), {sub}) as subpath, repeat('A', int({total})) as sequence, 0 as n), struct(filter({sub}, x -> false) as subpath, '' as sequence, 1 as n))").alias("recs"))
    each = reads.select("k", "name", F.explode(F.expr("if(k % 9 = 0, recs, slice(recs, 1, 1))")).alias("r"))
    return each.select("name", "r.sequence", F.lit(None).cast("binary").alias("quality"), F.expr("cast(array() as array<int>)").alias("start"), "r.subpath", (2 * F.col("k") + F.col("r.n")).alias("ord"))


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.repeat(F.lit("A"), 50).alias("seq"))
    copies = p.select(F.concat("p_brand", F.lit("_H"), (F.col("p_size") % 3 + 1).cast("string")).alias("path"), F.col("p_partkey").alias("node"), (F.col("p_size") % 2 == 1).alias("path_rev"))
    kinds = p.select(F.concat("p_type", F.lit("_R1")).alias("path"), F.col("p_partkey").alias("node"), (F.col("p_size") % 2 == 0).alias("path_rev"))
    steps = copies.union(kinds)
    return nodes, steps.select("path", F.col("node").alias("step_ord"), "node", "path_rev")


def maps(spark, d, mode: str) -> tuple[DataFrame, DataFrame | None]:
    names = graph(spark, d)[1].select("path").distinct()
    bare = attribute.transcript_of(F.col("path"))
    gene = F.concat(F.lit("G"), (F.length(bare) % 5).cast("string"))
    if mode == "score":
        return names.select("path", gene.alias("gene")), None
    return names.where("path like '%\\\\_H_'").select("path", F.concat(F.lit("G"), F.right(bare, F.lit(1))).alias("gene")), names.where("path like '%\\\\_R1'").select(bare.alias("path"), gene.alias("gene"))


def converted(spark, d, **options) -> dict[str, DataFrame]:
    o = Options(**options)
    exon, body = maps(spark, d, o.count_mode)
    return convert(spark, alignments(spark, d), *graph(spark, d), exon, o, body)


def _hit_text(out: dict[str, DataFrame]) -> DataFrame:
    hit = F.transform("hits", lambda h: F.concat(h["target_id"].cast("string"), F.when(h["forward"], "+").otherwise("-")))
    return out["records"].select("read", "barcode", "umi", F.array_join(hit, ";").alias("hits"))


def _summary(out):
    return out["summary"].select("key", "value")


def _sam(spark, d):
    out = converted(spark, d, strand="both", alignments="omit")
    to = scratch(spark, "sam")
    writers.write_sam(out["alignments"], out["tx2gene"], to, "run", "1")
    return spark.read.text(to).select(F.col("value").alias("line"))


def _sam_tags(spark, d):
    out = converted(spark, d, alignments="first")
    to = scratch(spark, "sam")
    writers.write_sam(out["alignments"], out["tx2gene"], to)
    return readers.read_sam_tags(spark, to)


def _fidelity(spark, d):
    """Alignments with a score of the mapper's, and one quality for all bases of a read, read back from JSON lines."""
    a = alignments(spark, d)
    score = "aggregate(s.mapping, 0, (t, m) -> t + int(if(m.edit[0].sequence <> '', -4 * m.edit[0].from_length, m.edit[0].to_length)))"
    a = a.withColumn("subpath", F.expr(f"transform(subpath, s -> named_struct('score', {score}, 'mapping', s.mapping))"))
    raw = F.base64(F.unhex(F.expr("repeat(lpad(hex(floor(ord / 2) % 42), 2, '0'), length(sequence))")))
    got = readers.read_alignments(spark, _written(a, _json(a, raw.alias("quality")), "json"))
    f = counting.fidelity(subpath_scores(got))
    return f.select("subpaths", "matching", "per_mille", *[F.floor(F.round(F.col(c) * 1000, 6)).cast("long").alias(c) for c in ("quality_matching", "quality_deviating")])


def _bam(spark, d):
    out = converted(spark, d, alignments="omit")
    to = scratch(spark, "bam")
    bam.write_bam(out["alignments"], out["tx2gene"], to, "run", "1")
    return bam.read_bam(spark, to)


def _rad_order(spark, d):
    """Records by their place in the file, which are told apart by tasks whose number follows the hits'."""
    out = converted(spark, d)
    to = scratch(spark, "rad")
    rad.write_rad(out["records"], out["dictionary"], to, max_chunk=1000)
    return rad.read_rad(spark, to).select("record", "umi").repartition(tasks_for(spark, out["targets"].count()), "record").distinct()


def _lines(write, rows: DataFrame, name: str) -> DataFrame:
    """A written file's lines with their numbers."""
    to = scratch(rows.sparkSession, name)
    write(rows, to)
    return readers.numbered_lines(rows.sparkSession, to).select("ord", F.col("value").alias("line"))


def _bad_map_rows(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 6 == 0, F.concat("p_brand", F.lit("\tG"))).when(k % 6 == 1, F.col("p_brand")).when(k % 6 == 2, F.concat("p_brand", F.lit("\t")))
    line = line.when(k % 6 == 3, F.concat(F.lit("\t"), "p_type")).when(k % 6 == 4, F.lit("")).otherwise(F.concat(F.lit("#"), "p_brand"))
    to = _written(_t(spark, d, "part"), line, "map")
    return readers.map_rows(spark.read.text(to))[1]


def _outside(spark, d):
    """Edits that reach beyond nodes of 30 bases."""
    a = alignments(spark, d).where("size(subpath) > 0").withColumn("quality", F.unhex(F.repeat(F.lit("20"), F.length("sequence"))))
    nodes = graph(spark, d)[0].select("node", F.repeat(F.lit("A"), F.lit(30)).alias("seq"))
    scored = scoring.score_edits(edit_rows(a, bases=True), ["read", "rec", "sub"], F.col("read_offset"), F.col("read_total"))
    return quality.outside(quality.placed_bases(scored, nodes)).select("node", "read_pos", "to_length")


def _rad(spark, d):
    out = converted(spark, d)
    to = scratch(spark, "rad")
    rad.write_rad(out["records"], out["dictionary"], to, max_chunk=1000)
    return rad.read_rad(spark, to).select("barcode", "umi", "target", "forward")


def _written(df: DataFrame, value, name: str) -> str:
    to = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(to)
    return to


def _json(a: DataFrame, *more: Column) -> Column:
    """Of each alignment, with scores if it has any."""
    scored = "'score', s.score, " if "score" in a.schema["subpath"].dataType.elementType.names else ""
    sub = F.expr(f"transform(subpath, s -> named_struct({scored}'path', named_struct('mapping', transform(s.mapping, m -> named_struct('position', named_struct('node_id', string(m.node), 'is_reverse', m.is_reverse), 'edit', m.edit)))))")
    return F.concat(F.to_json(F.struct("name", "sequence", *more, sub.alias("subpath"))), F.when(F.col("ord") % 5 == 0, F.lit("\n\n")).otherwise(F.lit("")))


def _in_order(spark, folder: str) -> None:
    """Gives a folder's files times of change in the order of their names, as a stream takes them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = sorted((f.getPath() for f in fs.listStatus(at)), key=lambda p: p.getName())
    last = int(time.time()) * 1000
    for i, p in enumerate(paths):
        fs.setTimes(p, last - 1000 * (len(paths) - i), -1)


def _streamed(spark, d, **options) -> dict[str, DataFrame]:
    """The conversion over a stream of files of lines, half of them a batch; reads go on in the next file."""
    to, out = scratch(spark, "stream-in"), scratch(spark, "stream")
    with parted(spark, _t(spark, d, "lineitem").count()):
        a = saved(alignments(spark, d), scratch(spark, "reads"))
    files = 2 * max(1, -(-a.count() // (2 * ROWS_A_TASK)))
    a.repartitionByRange(files, "ord").sortWithinPartitions("ord").select(_json(a).alias("value")).write.text(to)
    _in_order(spark, to)
    o = Options(**options)
    exon, body = maps(spark, d, o.count_mode)
    told = (*graph(spark, d), exon)
    known = interned(told[1], exon, scratch(spark, "graph"))
    stream.stream_convert(spark, to, *told, out, f"{out}/checkpoint", o, body, files_per_batch=files // 2, graph=known).awaitTermination()
    return stream.finish(spark, *told, out, o, body, known)


def _scan_alignments(spark, d):
    """As JSON lines with 64-bit numbers as strings, blank lines between."""
    a = alignments(spark, d)
    line = _json(a)
    got = readers.read_alignments(spark, _written(a, line, "json"))
    m = scored_mappings(got).groupBy("read").agg(F.count(F.lit(1)).alias("mappings"), F.sum("score").cast("long").alias("score"), F.sum("node").cast("long").alias("nodes"))
    per = got.groupBy(F.col("name").alias("read")).agg(F.count(F.lit(1)).alias("records"), (F.max("ord") - F.min("ord")).cast("long").alias("span"))
    return per.join(m, "read", "left")


def _scan_gfa(spark, d):
    nodes, steps = graph(spark, d)
    walks = steps.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_ord", "node", "path_rev"))), lambda s: F.concat(s["node"].cast("string"), F.when(s["path_rev"], "-").otherwise("+"))), ",").alias("w"))
    lines = nodes.select(F.concat(F.lit("S\t"), "node", F.lit("\t"), "seq").alias("l")).union(walks.select(F.concat(F.lit("P\t"), "path", F.lit("\t"), "w", F.lit("\t*"))))
    n, s = readers.read_gfa(spark, _written(lines, F.col("l"), "gfa"))
    return s.join(n.select("node", F.length("seq").alias("bases")), "node").select("path", "node", "path_rev", "bases", F.col("step_ord").alias("place"))


def _laid(spark, d) -> graph_store.Graph:
    """The graph in a store, opened anew from its folder."""
    to = scratch(spark, "store")
    graph_store.write_graph(*graph(spark, d), to)
    return graph_store.open_graph(spark, to)


def _scan_store(spark, d):
    """Every step with its node's bases: both tables lie in buckets by node, so that they meet where they are."""
    g = _laid(spark, d)
    place = F.row_number().over(Window.partitionBy("path").orderBy("step_ord")) - 1
    each = g.walks.join(g.nodes, "node").join(g.paths, "path_id")
    return each.select("path", "node", "path_rev", F.length("seq").alias("bases"), place.cast("int").alias("place"))


def _over_store(spark, d, mode="score"):
    """The conversion with a stored graph, of which the maps name some paths."""
    g, (exon, body) = _laid(spark, d), maps(spark, d, mode)
    return convert(spark, alignments(spark, d), g.nodes, g.steps, exon, Options(count_mode=mode), body, attribute.restricted(g.interned, exon))


def _scan_map(spark, d):
    t2g, _ = maps(spark, d, "score")
    lines = t2g.select(F.concat("path", F.lit("\t"), "gene", F.lit("\textra\n# note\n")).alias("l"))
    return readers.read_path_map(spark, _written(lines, F.col("l"), "map"))


def _scan_fastq(spark, d):
    c = _t(spark, d, "customer").where("c_custkey is not null")
    rec = F.concat(F.lit("@c"), "c_custkey", F.lit(" x\nACGT\n+\nIIII"))
    return readers.tag_fastq(spark, _written(c.orderBy("c_custkey").coalesce(1), rec, "fastq"), "AAAC").select("ord", "name", "sequence", "quality")


def _features(spark, d) -> DataFrame:
    s = _t(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string")).alias("path"), F.concat(F.lit("S"), k.cast("string")).alias("gene"), ((k * 37) % 900).alias("start"), ((k * 37) % 900 + 120).alias("end"), (k % 2 == 1).alias("reverse"))


def _scan_gtf(spark, d):
    f = _features(spark, d)
    line = F.concat_ws("\t", "path", F.lit("x"), F.lit("gene"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("reverse"), "-").otherwise("+"), F.lit("."), F.concat(F.lit('a "b"; gene_id "'), "gene", F.lit('";')))
    return readers.read_gtf(spark, _written(f, line, "gtf"))


def _bodies(spark, d) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("node"), F.repeat(F.lit("A"), F.col("p_size")).alias("seq"))
    steps = p.select("path", F.col("node").alias("step_ord"), "node", (F.col("node") % 4 == 0).alias("path_rev"))
    return annotate(_features(spark, d), p.select("node", "seq"), steps)


def _headed(spark, head: str, body: DataFrame, to: str) -> str:
    """One file: the head's lines, then the body's."""
    first = spark.createDataFrame([(0, head)], "k int, value string")
    first.union(body.select(F.lit(1), body.columns[0])).repartition(1).sortWithinPartitions("k").select("value").write.text(to)
    return to


def _scan_counts(spark, d):
    e = _t(spark, d, "events").where("event_type is not null and user_id is not null").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    body = e.select(F.concat_ws("\t", "event_type", F.col("user_id").cast("string"), F.col("n").cast("string")))
    return readers.read_counts(spark, _headed(spark, "# counts\ngene\tcell\tcount", body, scratch(spark, "counts")))


def _scan_matrix(spark, d):
    """Customers as rows, nations as columns, both by name files."""
    c = _t(spark, d, "customer").groupBy((F.col("c_custkey") % 50).alias("r"), F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    body = c.select(F.concat_ws(" ", (F.col("r") + 1).cast("string"), (F.col("k") + 1).cast("string"), F.col("n").cast("string")))
    to = _headed(spark, "%%MatrixMarket matrix coordinate integer general\n%\n50 25 0", body, scratch(spark, "matrix"))
    rows = _written(spark.range(0, 50, 1, 1), F.concat(F.lit("cell"), "id"), "rows")
    cols = _written(_t(spark, d, "nation").orderBy("n_nationkey").coalesce(1), F.col("n_name"), "cols")
    return readers.read_matrix(spark, to, rows, cols).select("cell", "gene", F.col("count").cast("long").alias("count"))


def _qualadj(spark, d):
    """Every base by its own quality, both read ends, nodes read either way. Bases repeat after 5 places, qualities after 14,
    nodes' bases after 2."""
    with parted(spark, _t(spark, d, "lineitem").count()):
        a = saved(alignments(spark, d).where("size(subpath) > 0"), scratch(spark, "reads"))
    n = "length(sequence)"
    k = "floor(ord / 2)"
    bases = f"array_join(transform(sequence(0, 4), i -> substring('ACGTN', int(({k} + i * i) % 5) + 1, 1)), '')"
    hexes = f"array_join(transform(sequence(0, 13), i -> lpad(hex(({k} * 7 + i * 3) % 42), 2, '0')), '')"
    a = a.withColumn("quality", F.expr(f"unhex(substring(repeat({hexes}, int({n} / 14) + 1), 1, 2 * {n}))"))
    a = a.withColumn("sequence", F.expr(f"substring(repeat({bases}, int({n} / 5) + 1), 1, {n})"))
    base = lambda j: F.expr(f"substring('ACGT', int((p_partkey + {j}) % 4) + 1, 1)")
    nodes = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.repeat(F.concat(base(0), base(1)), F.lit(25)).alias("seq"))
    made = adjusted_mappings(a, nodes)
    with parted(spark, made.count()):
        return saved(made.groupBy("read", "node").agg(F.sum("score").cast("long").alias("score"), F.sum("aligned").cast("long").alias("aligned")), scratch(spark, "adjusted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "run_summary": lambda s, d: _summary(converted(s, d, strand="forward")),
        "run_summary_ledger": lambda s, d: _summary(converted(s, d, count_mode="genefull_ex50pas", strand="reverse")),
        "convert_records": lambda s, d: _hit_text(converted(s, d)),
        "convert_records_ledger": lambda s, d: _hit_text(converted(s, d, count_mode="genefull_exonoverintron")),
        "rejected_groups": lambda s, d: converted(s, d)["rejected"].select("read", "status"),
        "stream_records": lambda s, d: _hit_text(_streamed(s, d)),
        "stream_summary": lambda s, d: _summary(_streamed(s, d, strand="forward")),
        "rad_roundtrip": _rad,
        "bam_rows": _sam,
        "fidelity_of_alignments": _fidelity,
        "bam_binary_rows": _bam,
        "rad_order": _rad_order,
        "tx2gene_lines": lambda s, d: _lines(writers.write_map, converted(s, d)["tx2gene"], "tx2gene"),
        "summary_lines": lambda s, d: _lines(writers.write_summary, converted(s, d, strand="forward")["summary"], "summary"),
        "warning_lines": lambda s, d: _lines(writers.write_rejected, converted(s, d)["rejected"], "warnings"),
        "bad_map_rows": _bad_map_rows,
        "edits_outside": _outside,
        "scan_sam_tags": _sam_tags,
        "scan_alignments": _scan_alignments,
        "scan_gfa": _scan_gfa,
        "scan_graph_store": _scan_store,
        "store_records": lambda s, d: _hit_text(_over_store(s, d)),
        "store_records_ledger": lambda s, d: _hit_text(_over_store(s, d, "genefull_exonoverintron")),
        "scan_path_map": _scan_map,
        "scan_fastq": _scan_fastq,
        "scan_gtf": _scan_gtf,
        "scan_counts": _scan_counts,
        "scan_matrix": _scan_matrix,
        "gene_body_paths": lambda s, d: _bodies(s, d)[0],
        "gene_body_map": lambda s, d: _bodies(s, d)[1],
        "qualadj_scores": _qualadj,
    }
