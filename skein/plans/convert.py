"""The conversion of alignments into compatibility records.

Parsed alignments are written once to the shared folder; what the checks and all outputs need of them follows in two
narrow tables, a row per read group and a row per mapping, so no output parses or scores anew. Flat scores are a fold
within the row: the only shuffle of mappings is that of the tally, by read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions import molecule as mol, quality, scoring
from skein.operators import attribute, checks, ledger as led
from skein.operators.checks import InputError
from skein.session import parted, saved, scratch, split, tasks_for

#: The summary's keys in their order.
SUMMARY = (
    "input_records input_read_groups emitted_groups no_compatible_transcript_groups strand_filtered_groups multigene_dropped_groups unaligned_reads "
    "raw_molecule_missing_groups raw_molecule_malformed_groups raw_molecule_unsupported_groups raw_molecule_skipped_groups grouping_recurrence_failures "
    "emitted_target_count_histogram"
).split()


@dataclass(frozen=True)
class Options:
    barcode_length: int = 16
    umi_length: int = 12
    failures: str = "skip"
    strand: str = "both"
    count_mode: str = "score"
    scores: str = "flat"
    #: Tagged alignments: off, omit (XT of reads of one gene only) or first (XT is always the first gene).
    alignments: str = "off"

    def check(self, has_body: bool) -> None:
        mol.check_lengths(self.barcode_length, self.umi_length)
        if self.failures not in ("skip", "fail"):
            raise ValueError("molecule identity failures: skip or fail")
        if self.strand not in attribute.STRANDS:
            raise ValueError(f"strand: one of {attribute.STRANDS}")
        if self.count_mode not in ("score", *led.MODES):
            raise ValueError(f"count mode: score or one of {led.MODES}")
        if self.scores not in ("flat", "qualadj"):
            raise ValueError("scores: flat or qualadj")
        if self.alignments not in ("off", "omit", "first"):
            raise ValueError("alignments: off, omit or first")
        if (self.count_mode != "score") != has_body:
            raise ValueError("the gene count modes need a body map, and only they do")


def edit_rows(reads: DataFrame, bases: bool = False) -> DataFrame:
    """A row per edit: read, rec, sub, map, ord, node, read_rev, from_length, to_length, mismatch, read_offset, read_total.
    With bases, also the read's bases and qualities under the edit (quals null where the record has no quality for each
    base) and ref_pos, its place in the node."""
    sizes = "aggregate({0}, bigint(0), (a, x) -> a + x.{1})"
    lengths = F.expr(f"transform(subpath, s -> aggregate(s.mapping, bigint(0), (c, m) -> c + {sizes.format('m.edit', 'to_length')}))")
    own = ["sequence", "quality"] if bases else []
    r = reads.select(F.col("name").alias("read"), F.col("ord").alias("rec"), F.length("sequence").alias("read_total"), *own, lengths.alias("lengths"), F.expr("transform(subpath, s -> s.next)").alias("nexts"), "start", "subpath")
    r = r.select("read", "rec", "read_total", *own, scoring.read_offsets("lengths", "nexts", "start").alias("offsets"), F.posexplode("subpath").alias("sub", "s"))
    ahead = [F.expr(f"aggregate(slice(s.mapping, 1, map), bigint(0), (c, m) -> c + {sizes.format('m.edit', 'to_length')})").alias("ahead")] if bases else []
    r = r.select("read", "rec", "sub", "read_total", *own, F.expr("offsets[sub]").alias("read_offset"), "s", F.posexplode(F.col("s.mapping")).alias("map", "m"))
    # a mapping without edits is one empty edit: it scores 0, but its node counts
    none = "named_struct('from_length', bigint(0), 'to_length', bigint(0), 'sequence', '')"
    r = r.select("read", "rec", "sub", "map", "read_total", *own, "read_offset", *ahead, "m", F.posexplode_outer(F.col("m.edit")).alias("e_ord", "e"))
    r = r.withColumn("e_ord", F.coalesce("e_ord", F.lit(0))).withColumn("e", F.expr(f"coalesce(e, {none})"))
    if bases:
        before = "slice(m.edit, 1, e_ord)"
        at = f"int(read_offset + ahead + {sizes.format(before, 'to_length')} + 1)"
        full = "sequence <> '' and octet_length(quality) = length(sequence)"
        own = [
            F.expr(f"substring(sequence, {at}, int(e.to_length))").alias("bases"),
            F.expr(f"if({full}, substring(quality, {at}, int(e.to_length)), null)").alias("quals"),
            F.expr(f"m.offset + {sizes.format(before, 'from_length')}").alias("ref_pos"),
        ]
    return r.select(
        "read", "rec", "sub", "map", "read_total", "read_offset", F.col("m.node").alias("node"), F.col("m.is_reverse").alias("read_rev"), F.struct("map", "e_ord").alias("ord"), "e.from_length", "e.to_length", (F.col("e.sequence") != "").alias("mismatch"), *own
    )


def scored_mappings(reads: DataFrame) -> DataFrame:
    """read, rec, node, read_rev, score, aligned: a row per mapping, those that score 0 too, by a fold within the row."""
    lengths = F.expr("transform(subpath, s -> aggregate(s.mapping, bigint(0), (c, m) -> c + aggregate(m.edit, bigint(0), (a, x) -> a + x.to_length)))")
    r = reads.select(F.col("name").alias("read"), F.col("ord").alias("rec"), F.length("sequence").alias("total"), lengths.alias("lengths"), F.expr("transform(subpath, s -> s.next)").alias("nexts"), "start", "subpath")
    r = r.withColumn("offsets", scoring.read_offsets("lengths", "nexts", "start"))
    r = r.select("read", "rec", "total", F.explode(F.arrays_zip("subpath", "offsets")).alias("s"))
    r = r.select("read", "rec", F.explode(scoring.fold_mappings("s.subpath.mapping", "s.offsets", "total")).alias("m"))
    return r.select("read", "rec", "m.node", "m.read_rev", "m.score", "m.aligned")


def subpath_scores(reads: DataFrame) -> DataFrame:
    """read, rec, sub, node_score (what its mappings score here), mapper_score (what the alignment says), base_quality (mean
    of the bases under the subpath, null where the record hasn't a quality for each base): a row per subpath, without a
    shuffle, for counting.fidelity."""
    lengths = F.expr("transform(subpath, s -> aggregate(s.mapping, bigint(0), (c, m) -> c + aggregate(m.edit, bigint(0), (a, x) -> a + x.to_length)))")
    r = reads.select(F.col("name").alias("read"), F.col("ord").alias("rec"), "sequence", "quality", lengths.alias("lengths"), F.expr("transform(subpath, s -> s.next)").alias("nexts"), "start", "subpath")
    r = r.withColumn("offsets", scoring.read_offsets("lengths", "nexts", "start")).withColumn("total", F.length("sequence"))
    r = r.select("read", "rec", "sequence", "quality", "total", F.posexplode(F.arrays_zip("subpath", "offsets", "lengths")).alias("sub", "s"))
    made = r.withColumn("scores", scoring.fold_mappings("s.subpath.mapping", "s.offsets", "total"))
    under = "aggregate(sequence(1, int(s.lengths)), bigint(0), (a, i) -> a + int(conv(hex(substring(quality, int(s.offsets + i), 1)), 16, 10))) / s.lengths"
    return made.select(
        "read", "rec", "sub", F.expr("aggregate(scores, bigint(0), (a, m) -> a + m.score)").alias("node_score"), F.col("s.subpath.score").cast("long").alias("mapper_score"),
        F.expr(f"if(s.lengths > 0 and octet_length(quality) = total, {under}, null)").alias("base_quality"),
    )


def adjusted_mappings(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """scored_mappings with scores by base quality where a record has a quality for each base: a row per edit, since node
    sequences come by a join. They are scored and checked in one pass, which is written to the shared folder."""
    spark = reads.sparkSession
    rows = reads.agg(F.sum(F.expr("aggregate(subpath, bigint(0), (t, s) -> t + size(s.mapping))"))).first()[0] or 0
    edits = edit_rows(reads, bases=True)
    scored = scoring.score_edits(edits, ["read", "rec", "sub"], F.col("read_offset"), F.col("read_total"))
    made = quality.adjust(quality.with_bases(scored, nodes))
    beyond = F.when(F.expr(f"{quality.BOTH} and {quality.BEYOND}"), F.struct("read_pos", "ref_pos", "to_length"))
    with parted(spark, rows):
        made = saved(made.select("read", "rec", "node", "read_rev", "score", scoring.aligned_bases().alias("aligned"), beyond.alias("beyond")), scratch(spark, "adjusted"))
    checks.require(made.where("beyond is not null").select("read", "node", "beyond.*"), "an edit reaches beyond its read or node")
    return made.drop("beyond")


def interned(steps: DataFrame, t2g: DataFrame, folder: str) -> attribute.Interned:
    """The mapped paths of a graph by what they have in common, written to a folder of the shared store."""
    known = steps.join(t2g.select("path").distinct(), "path", "left_semi")
    return attribute.intern(known.select("node", "path", "path_rev"), folder)


def convert(spark: SparkSession, reads: DataFrame, nodes: DataFrame, steps: DataFrame, t2g: DataFrame, options: Options = Options(), body: DataFrame | None = None, graph: attribute.Interned | None = None) -> dict[str, DataFrame]:
    """reads as from readers.read_alignments, a graph's nodes and steps, and path maps -> records (ord, read, barcode, umi,
    original_name, hits), dictionary (target, target_id), tx2gene, targets, rejected (ord, read, status of groups whose
    name can't be read), summary (place, key, value), and with options.alignments also alignments (ord, name, sequence,
    quality_text, barcode, umi, genes, primary_gene, xt). Inputs that break a rule raise InputError before anything is
    returned; of several offenders of a kind the first in the input is told. Whoever converts several inputs over a graph may
    intern it once and hand it over."""
    options.check(body is not None)
    folder = scratch(spark, "convert")
    with split(spark):
        reads = saved(reads, f"{folder}/reads")
    identity = mol.molecule(F.col("name"), options.barcode_length, options.umi_length)
    aligned = F.size("subpath") > 0
    on = F.col("aligned")
    kept = [F.min_by(F.struct("sequence", "quality"), "ord").alias("any"), F.min_by(F.when(on, F.struct("sequence", "quality")), F.when(on, F.col("ord"))).alias("first")] if options.alignments != "off" else []
    given = reads.count()
    # dealt by name first, without their mappings: no scan sorts or hashes all the reads that it reads
    dealt = reads.select("name", "ord", aligned.alias("aligned"), F.length("sequence").alias("length"), *(["sequence", "quality"] if kept else [])).repartition(tasks_for(spark, given), "name")
    groups = dealt.groupBy("name").agg(
        F.min("ord").alias("ord"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("records"), F.bool_or(on).alias("aligned"), F.bool_or(~on).alias("unaligned"), F.max(F.when(on, F.col("length"))).alias("read_length"), *kept
    )
    with parted(spark, given):
        groups = saved(groups.withColumn("m", identity).withColumnRenamed("name", "read"), f"{folder}/groups")
    if groups.isEmpty():
        raise InputError("the alignment input is empty")
    checks.require(groups.where("last - ord + 1 <> records").select("ord", "read"), "grouping_recurrence_failures=1: records of a read are not contiguous", "ord")
    rejected = groups.where("m.status <> 'ok'").select("ord", "read", "m.status")
    if options.failures == "fail":
        checks.require(rejected, "a molecule name can't be read", "ord")
    ok = reads.where((identity["status"] == "ok") & aligned)
    score_mode = options.count_mode == "score"
    made = adjusted_mappings(ok, nodes) if score_mode and options.scores == "qualadj" else scored_mappings(ok)
    with parted(spark, given):
        m = saved(made if score_mode else made.where("aligned > 0"), f"{folder}/mappings")
    rows = m.count()
    n = tasks_for(spark, rows)
    by_read = lambda t: t.repartition(n, "read") if n > tasks_for(spark, 0) else t
    with parted(spark, rows):
        checks.require(m.select("node", "rec").groupBy("node").agg(F.min("rec").alias("rec")).join(nodes.select("node"), "node", "left_anti"), "a node is not in the graph", "rec")
    if score_mode:
        named = t2g.withColumn("target", attribute.transcript_of(F.col("path")))
        checks.require(checks.conflicting(named, "target", "gene"), "a transcript has two genes", "target")
        graph = graph or interned(steps, t2g, f"{folder}/graph")
        targets = attribute.targets(m.repartition(n, "read"), graph).select("read", "target", "forward")  # dealt once: all that follows goes by read
        dictionary = attribute.dictionary(named.select("target"))
        tx2gene = named.select("target", "gene").distinct()
    else:
        for t in (t2g, body):
            checks.require(checks.conflicting(t, "path", "gene"), "a path has two genes", "path")
        layers = led.path_layers(steps.select("path"), t2g, body)
        entries = led.ledger(m, led.node_genes(steps, layers))
        targets = led.count_mode(entries, groups.select("read", "read_length"), options.count_mode)
        dictionary = attribute.dictionary(t2g.select(F.col("gene").alias("target")).union(body.select("gene")))
        tx2gene = dictionary.select("target", F.col("target").alias("gene"))
    with parted(spark, rows):
        targets = saved(targets, f"{folder}/targets")
    stranded = attribute.strand(targets, options.strand)
    final = stranded if score_mode else attribute.unique_only(stranded)
    hits = attribute.encode(by_read(final), dictionary).groupBy("read").agg(F.expr("transform(array_sort(collect_list(struct(target, target_id, forward))), h -> struct(h.target_id, h.forward))").alias("hits"))
    records = by_read(groups).join(hits, "read").select("ord", "read", "m.barcode", "m.umi", "m.original_name", "hits")
    records = records.repartitionByRange(n, "ord").sortWithinPartitions("ord") if n > tasks_for(spark, 0) else records.orderBy("ord")

    keeps = F.lit(True) if options.strand == "both" else F.col("forward") == F.lit(options.strand == "forward")
    per = by_read(targets).groupBy("read").agg(F.count_if(keeps).alias("n"))
    state = by_read(groups).join(per, "read", "left").withColumn("ok", F.col("m.status") == "ok")
    dropped = F.coalesce(F.col("n") > 1, F.lit(False)) if not score_mode else F.lit(False)
    count = lambda on: F.count_if(on).cast("string")
    none = F.col("ok") & F.col("n").isNull()
    values = [
        F.sum("records").cast("string"),
        F.count(F.lit(1)).cast("string"),
        count((F.col("n") > 0) & ~dropped),
        count(none),
        count(F.col("n") == 0),
        count(dropped),
        count(none & F.col("unaligned") & ~F.col("aligned")),
        *[count(F.col("m.status") == s) for s in ("missing", "malformed", "unsupported")],
        count(~F.col("ok")),
        F.lit("0"),
    ]
    told = state.agg(*[v.alias(k) for k, v in zip(SUMMARY, values)]).join(attribute.histogram_text(attribute.histogram(by_read(final))).select(F.col("histogram").alias(SUMMARY[-1])))
    summary = told.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in SUMMARY])).alias("place", "kv")).select("place", "kv.key", "kv.value")
    out = {"records": records, "dictionary": dictionary, "tx2gene": tx2gene, "targets": final, "rejected": rejected, "summary": summary}
    if options.alignments != "off":
        sets = attribute.gene_sets(by_read(final), tx2gene, options.alignments)
        base = F.coalesce("first", "any")
        whole = F.octet_length(base["quality"]) == F.length(base["sequence"])
        phred = F.expr("array_join(transform(sequence(1, length(quality)), i -> char(int(conv(hex(substring(quality, i, 1)), 16, 10)) + 33)), '')")
        out["alignments"] = (
            by_read(groups).join(sets, "read")
            .select("ord", F.col("m.original_name").alias("name"), base["sequence"].alias("sequence"), F.when(whole & (F.length(base["sequence"]) > 0), base["quality"]).alias("quality"), "m.barcode", "m.umi", "genes", "primary_gene", "xt")
            .withColumn("quality_text", F.when(F.col("quality").isNotNull(), phred))
            .drop("quality")
        )
    return out
