"""The engine's operators over the star-schema tables, seen as alignments, with their SQL.

A read is an order; its lines in (line, part, supplier, price) order are edits: returned and fulfilled lines delete,
other returned ones insert, N mismatches, A matches; quantity is the length. A node is a part. Paths are a part's brand
copy and its type; genes are made of part keys and sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.functions import molecule as mol, scoring
from skein.operators import attribute, checks, counting, ledger as led, network
from skein.plans import driver_files
from skein.session import parted, saved, scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: What orders the edits of a read.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def edits(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    returned = F.col("l_returnflag") == "R"
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"),
        *ORDER,
        F.col("l_partkey").alias("node"),
        (F.col("l_suppkey") % 2 == 1).alias("read_rev"),
        F.when(returned & (F.col("l_linestatus") == "O"), 0).otherwise(q).cast("long").alias("from_length"),
        F.when(returned & (F.col("l_linestatus") == "F"), 0).otherwise(q).cast("long").alias("to_length"),
        (F.col("l_returnflag") == "N").alias("mismatch"),
    )


def mappings(spark, d) -> DataFrame:
    return scored(edits(spark, d))


def scored(e: DataFrame) -> DataFrame:
    return scoring.score_edits(e, ["read"], order=ORDER).withColumn("aligned", scoring.aligned_bases())


def emptied(spark, d) -> DataFrame:
    """Edits of short lines become empty ones: they score 0 and end no gap, but their nodes count."""
    e = edits(spark, d)
    short = F.greatest("from_length", "to_length") <= 20
    return e.withColumn("f", F.when(short, 0).otherwise(F.col("from_length"))).withColumn("to_length", F.when(short, F.lit(0)).otherwise(F.col("to_length")).cast("long")).withColumn("from_length", F.col("f").cast("long")).drop("f")


def node_paths(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    copies = p.select(F.col("p_partkey").alias("node"), F.concat("p_brand", F.lit("_H"), (F.col("p_size") % 3 + 1).cast("string")).alias("path"), (F.col("p_size") % 2 == 1).alias("path_rev"))
    kinds = p.select(F.col("p_partkey").alias("node"), F.concat("p_type", F.lit("_R1")).alias("path"), (F.col("p_size") % 2 == 0).alias("path_rev"))
    return copies.union(kinds)


_GRAPHS: dict[tuple[str, str], attribute.Interned] = {}


def graph(spark, d) -> attribute.Interned:
    """node_paths with its classes, interned once for an application, as a graph is once for all reads."""
    key = spark.sparkContext.applicationId, d
    if key not in _GRAPHS:
        _GRAPHS[key] = attribute.intern(node_paths(spark, d), scratch(spark, "graph"))
    return _GRAPHS[key]


def node_genes(spark, d) -> DataFrame:
    """By the engine's own classification: two gene layers of paths whose steps are parts, the last step deciding."""
    p = _t(spark, d, "part")
    gene = lambda n: F.concat(F.lit("G"), (F.col(n) % 7).cast("string"))
    one = p.select(F.when(F.col("p_size") <= 25, F.concat(F.lit("e"), gene("p_partkey"))).otherwise(F.concat(F.lit("b"), gene("p_partkey"))).alias("path"), F.col("p_partkey").alias("node"), gene("p_partkey").alias("gene"), (F.col("p_size") <= 25).alias("is_exon"), (F.col("p_size") % 2 == 1).alias("path_rev"))
    two = p.where("p_size % 3 = 0").select(F.concat(F.lit("c"), gene("p_size")).alias("path"), F.col("p_partkey").alias("node"), gene("p_size").alias("gene"), F.lit(False).alias("is_exon"), (F.col("p_size") % 2 == 0).alias("path_rev"))
    both = one.union(two)
    return led.node_genes(both.select("path", F.col("node").alias("step_ord"), "node", "path_rev"), both.select("path", "gene", "is_exon").distinct())


def targets(spark, d) -> DataFrame:
    """Written once, by tasks whose number follows the lines'."""
    known = graph(spark, d)
    with parted(spark, _t(spark, d, "lineitem").count()):
        return saved(attribute.targets(mappings(spark, d), known), scratch(spark, "targets"))


def counted(spark, d, mode) -> DataFrame:
    """One scan of the lines and one exchange by read: its length, where the mode asks for it, is a window's sum."""
    e = edits(spark, d).withColumn("aligned", scoring.aligned_bases())
    if mode == "gene":
        e = e.withColumn("read_length", F.sum("aligned").over(Window.partitionBy("read")).cast("long"))
    return led.count_mode(led.ledger(e, node_genes(spark, d)), None, mode)


_MODES = {"gene": "gene", "genefull": "genefull", "exonoverintron": "genefull_exonoverintron", "ex50pas": "genefull_ex50pas"}


def _names(spark, d) -> DataFrame:
    """Customers' names as molecule names, of every status."""
    c = _t(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    bc, umi = F.translate(F.lpad(F.conv(k.cast("string"), 10, 4), 16, "0"), "0123", "ACGT"), mol.umi_of(k)
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("_"), bc, F.lit("_"), umi))
        .when(k % 7 == 1, F.concat(bc, F.lit("_"), umi))
        .when(k % 7 == 2, F.concat(F.lit("r_x_"), F.lower(bc), F.lit("_"), umi))
        .when(k % 7 == 3, F.concat(F.lit("r_"), bc, F.lit("_"), F.substring(umi, 1, 11)))
        .when(k % 7 == 4, F.concat(F.lit("r_"), F.translate(bc, "G", "X"), F.lit("_"), umi))
        .when(k % 7 == 5, F.concat(F.lit("r_"), bc, F.lit("_")))
        .otherwise(F.concat(F.lit("r_"), bc, F.lit("_"), umi))
    )
    return c.select("c_custkey", name.alias("name"))


def _molecule_status(spark, d):
    m = mol.molecule(F.col("name"))
    return _names(spark, d).select("c_custkey", m["status"].alias("status"), F.when(m["status"] == "ok", m["original_name"]).alias("original_name"))


def _molecule_pack(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    bc = mol.umi_of(F.col("o_custkey"), 16)
    return o.select("o_orderkey", bc.alias("barcode"), mol.pack(bc).alias("packed"), mol.pack(mol.umi_of(F.col("o_orderkey"), 12)).alias("packed_umi"))


def _contiguity(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id")
    return checks.scattered(e, "user_id", "event_id").select("user_id", F.col("first").cast("long").alias("first_event"), "span", F.col("n").alias("events"))


def _strand_counters(spark, d):
    t = targets(spark, d)
    per = t.groupBy("read").agg(F.count_if("forward").alias("f"), F.count_if(~F.col("forward")).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("f") == 0).alias("filtered_forward"), F.count_if(F.col("r") == 0).alias("filtered_reverse"))


def _multigene(spark, d):
    out = None
    for name, mode in _MODES.items():
        n = counted(spark, d, mode).groupBy("read").agg(F.count(F.lit(1)).alias("genes")).agg(F.count_if(F.col("genes") > 1).alias("dropped"), F.count_if(F.col("genes") == 1).alias("kept"))
        n = n.select(F.lit(name).alias("mode"), "dropped", "kept")
        out = n if out is None else out.union(n)
    return out


def _small(spark, d):
    return _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))


def _missing_nodes(spark, d):
    return checks.missing(edits(spark, d), _small(spark, d), "node")


def _conflicts(spark, d):
    """Brands whose copies have several sizes: a target with two genes is refused."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("target"), F.concat(F.lit("G"), (F.col("p_size") % 3).cast("string")).alias("gene"))
    return checks.conflicting(p.where("target like '%1' or gene = 'G0'"), "target", "gene")


def _unknown_targets(spark, d):
    return attribute.unknown(targets(spark, d), _dictionary(spark, d).where("target_id % 5 <> 0"))


def _semi_join(spark, d):
    return node_paths(spark, d).join(_t(spark, d, "part").where("p_size <= 10").select(F.concat("p_type", F.lit("_R1")).alias("path")).distinct(), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("steps"))


def _fallback_join(spark, d):
    exon = node_paths(spark, d).where("path like '%_H1'").select("path", F.lit("E").alias("gene")).distinct()
    body = node_paths(spark, d).select(attribute.transcript_of(F.col("path")).alias("path")).distinct().select("path", F.concat(F.lit("B:"), "path").alias("gene"))
    return led.path_layers(node_paths(spark, d).select("path"), exon, body)


def _dictionary(spark, d):
    return attribute.dictionary(node_paths(spark, d).select(attribute.transcript_of(F.col("path")).alias("target")))


def _gene_union(spark, d):
    g = node_genes(spark, d)
    return attribute.dictionary(g.where("is_exon").select(F.col("gene").alias("target")).union(g.where("not is_exon").select("gene")))


def _new_paths(spark, d):
    p = node_paths(spark, d).select("path").distinct()
    return p.join(p.where("path like '%_H1' or path like '%_H2'"), "path", "left_anti")


def _records(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("gene"), F.col("props").alias("umi"), F.col("event_id").alias("pos"))


def _network(spark, d):
    """UMIs of five bases, many of one count and some of high ones, in few cells."""
    k = F.col("event_id")
    e = _t(spark, d, "events").select((F.col("user_id") % 7).alias("cell"), F.col("event_type").alias("gene"), mol.umi_of(k * k % 1024, 5).alias("umi"))
    return network.network_counts(e)


def _position_independence(spark, d):
    """Counts don't change when records move; they do where a record's UMI changes. All rows that differ are told."""
    a = counting.molecule_counts(_records(spark, d))
    moved = _records(spark, d).withColumn("pos", F.col("pos") + 50000)
    b = counting.molecule_counts(moved.withColumn("umi", F.when(F.col("pos") % 40 == 0, F.lit("other")).otherwise(F.col("umi"))))
    return checks.difference(a, b)


def _matrix(spark, d):
    m = counting.cell_gene_matrix(counting.molecule_counts(_records(spark, d)))
    return m.select("cell", F.array_join(F.transform(F.map_entries("genes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";").alias("genes"))


def _gene_sets(spark, d, policy="omit"):
    genes = _dictionary(spark, d).select("target", F.concat(F.lit("GENE"), (F.col("target_id") % 9).cast("string")).alias("gene"))
    return attribute.gene_sets(targets(spark, d), genes, policy)


def _dag_offsets(spark, d):
    """Six subpaths an order, edges and lengths from the order's key."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("read"))
    o = o.withColumn("lengths", F.expr("transform(sequence(0, 5), i -> bigint((read * (i + 3)) % 11 + 1))"))
    o = o.withColumn("nexts", F.expr("transform(sequence(0, 5), i -> filter(sequence(0, 5), j -> j > i and (read * (i + 1) + i + 7 * j) % 3 = 0))")).withColumn("starts", F.expr("cast(array() as array<int>)"))
    return o.select("read", F.posexplode(scoring.read_offsets("lengths", "nexts", "starts")).alias("subpath", "read_offset"))


def _spans(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("step_ord"), F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("length"))
    return counting.node_spans(p.select("path", "step_ord", "node"), p.select("node", "length"))


def _range_join(spark, d):
    s = _t(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 3 + 1).cast("string")).alias("path"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("gene"), ((F.col("s_suppkey") * 37) % 900).alias("start"))
    f = s.withColumn("end", F.col("start") + 120)
    return counting.overlaps(_spans(spark, d), f, 256).select("path", "node", "gene")


def _fidelity(spark, d):
    m = mappings(spark, d).groupBy("read").agg(F.sum("score").cast("long").alias("node_score"), F.sum(F.when(F.col("mismatch"), -4 * F.col("from_length")).otherwise(F.col("to_length"))).cast("long").alias("mapper_score"))
    f = counting.fidelity(m.withColumn("base_quality", F.col("read") % 42))
    return f.select("subpaths", "matching", "per_mille", *[F.floor(F.col(c) * 1000).cast("long").alias(c) for c in ("quality_matching", "quality_deviating")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    flag = lambda s, d: targets(s, d).select("read", "target", "fwd", "rev", "forward")
    out = {
        "flagship_targets": flag,
        "node_scores": lambda s, d: mappings(s, d).groupBy("read", "node").agg(F.sum("score").cast("long").alias("score"), F.sum("aligned").cast("long").alias("aligned")),
        "hst_tally": lambda s, d: attribute.tally(mappings(s, d), graph(s, d)),
        "winners": lambda s, d: attribute.winners(attribute.tally(mappings(s, d), graph(s, d))).select("read", "path", "score"),
        "orientation": lambda s, d: targets(s, d).groupBy("forward").agg(F.count(F.lit(1)).alias("targets")),
        "strand_forward": lambda s, d: attribute.strand(targets(s, d), "forward").select("read", "target"),
        "strand_reverse": lambda s, d: attribute.strand(targets(s, d), "reverse").select("read", "target"),
        "strand_counters": _strand_counters,
        "multigene_dropped": _multigene,
        "molecule_status": _molecule_status,
        "molecule_pack": _molecule_pack,
        "contiguity_violations": _contiguity,
        "missing_nodes": _missing_nodes,
        "conflicting_genes": _conflicts,
        "unknown_targets": _unknown_targets,
        "semi_join_paths": _semi_join,
        "fallback_join": _fallback_join,
        "target_dictionary": _dictionary,
        "gene_union": _gene_union,
        "new_paths": _new_paths,
        "target_histogram": lambda s, d: attribute.histogram(targets(s, d)),
        "umi_counts": lambda s, d: counting.molecule_counts(_records(s, d)),
        "umi_network_counts": _network,
        "cell_gene_matrix": _matrix,
        "position_independence": _position_independence,
        "gene_sets_xt": _gene_sets,
        "gene_sets_first": lambda s, d: _gene_sets(s, d, "first"),
        "node_genes": node_genes,
        "tally_with_empty_edits": lambda s, d: attribute.tally(scored(emptied(s, d)), graph(s, d)),
        "dag_offsets": _dag_offsets,
        "gene_body_range_join": _range_join,
        "fidelity_rate": _fidelity,
        "encoded_targets": lambda s, d: attribute.encode(targets(s, d), _dictionary(s, d)).select("read", "target_id", mol.target_word(F.col("target_id"), F.col("forward")).alias("word")),
    }
    out |= driver_files.queries()
    for name, mode in _MODES.items():
        out[f"count_{name}"] = lambda s, d, mode=mode: attribute.unique_only(counted(s, d, mode)).select("read", "target", "forward")
    return out
