"""From scored mappings to the targets of each read: attribution by classes of equal path sets, tally, winners, collapse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.session import parted, saved, tasks_for

STRANDS = ("both", "forward", "reverse")


def transcript_of(path: Column) -> Column:
    """A path's name without one trailing _H<digits> or _R<digits>."""
    return F.regexp_replace(path, "_[HR][0-9]+$", "")


@dataclass(frozen=True)
class Interned:
    """A graph's paths by what they have in common, so that reads meet sets of paths instead of paths.

    groups (path, grp): paths with the same steps are one group, named by the least of them; a read can't tell them apart.
    classes (node, cls): nodes with the same groups in the same directions are one class, named by the least node.
    members (cls, grp, path_rev, visits): the groups of a class."""

    groups: DataFrame
    classes: DataFrame
    members: DataFrame


def _least_equal(rows: DataFrame, of: str, parts: list[str]) -> DataFrame:
    """rows (of, *parts), each once -> of, least: the least of those that have the same set of parts. Sets meet by their size
    and two hashes; then every part is looked up in the least one's set, and who differs stands for itself."""
    h = [F.bit_xor(F.xxhash64(F.lit(k), *parts)).alias(f"h{k}") for k in (1, 2)]
    signs = rows.groupBy(of).agg(*h, F.count(F.lit(1)).alias("n"))
    least = signs.groupBy("h1", "h2", "n").agg(F.min(of).alias("least"), F.count(F.lit(1)).alias("equal")).where("equal > 1")
    named = signs.join(least, ["h1", "h2", "n"], "left").select(of, F.coalesce("least", of).alias("least"))
    others = rows.join(named.where(F.col(of) != F.col("least")), of)
    wrong = others.join(rows.withColumnRenamed(of, "least"), ["least", *parts], "left_anti").select(of).distinct().withColumn("wrong", F.lit(True))
    return named.join(wrong, of, "left").select(of, F.when(F.col("wrong"), F.col(of)).otherwise(F.col("least")).alias("least"))


def intern(node_paths: DataFrame, folder: str | None = None) -> Interned:
    """node_paths (node, path, path_rev; a path that visits a node twice has two rows) -> its groups and classes. Shuffled is
    the graph only; hashes are partial aggregates, so a node of very many paths or a path of very many nodes is no matter.
    With a folder of the shared store each table is written once, and every use reads it."""
    kept = lambda t, name: saved(t, f"{folder}/{name}") if folder else t
    spark, n = node_paths.sparkSession, node_paths.count() if folder else 0
    steps = node_paths.repartition(tasks_for(spark, n), "node", "path", "path_rev") if folder else node_paths  # no scan hashes all that it reads
    with parted(spark, n):
        rows = kept(steps.groupBy("node", "path", "path_rev").agg(F.count(F.lit(1)).alias("visits")), "rows")
        groups = kept(_least_equal(rows, "path", ["node", "path_rev", "visits"]).withColumnRenamed("least", "grp"), "groups")
        own = kept(rows.join(groups.where("path = grp").select("path"), "path", "left_semi").withColumnRenamed("path", "grp"), "own")
        classes = kept(_least_equal(own, "node", ["grp", "path_rev", "visits"]).withColumnRenamed("least", "cls"), "classes")
        members = kept(own.join(classes.where("node = cls").select("node"), "node", "left_semi").withColumnRenamed("node", "cls"), "members")
    return Interned(groups, classes, members)


def restricted(graph: Interned, paths: DataFrame) -> Interned:
    """A graph that was interned with all its paths, to those of paths (path): the same tallies as if only they had been
    interned, though a class may have been parted by paths that don't count now. Classes stay as they are stored."""
    groups = graph.groups.join(paths.select("path").distinct(), "path", "left_semi").select("path", "grp")
    members = graph.members.join(groups.select("grp").distinct(), "grp", "left_semi").select(*graph.members.columns)
    return Interned(groups, graph.classes, members)


def tally_groups(mappings: DataFrame, graph: Interned) -> DataFrame:
    """mappings (read, node, read_rev, score, aligned) -> (read, grp, score, fwd, rev) of every path of the group, pooled over
    all mappings of a read. A mapping meets its node's class, one row; sums of a read and class then meet the class' groups
    once. Both keys begin with the read, so that mappings partitioned by read stay where they are."""
    on = lambda rev: F.sum(F.when(F.col("read_rev") == rev, F.col("aligned")).otherwise(0)).alias("rev_bases" if rev else "fwd_bases")
    each = mappings.join(graph.classes, "node").groupBy("read", "cls").agg(F.sum("score").alias("score"), on(False), on(True))
    part = lambda same: F.sum(F.col("visits") * F.when(F.col("path_rev") == F.lit(same), F.col("rev_bases")).otherwise(F.col("fwd_bases"))).cast("long")
    return each.join(graph.members, "cls").groupBy("read", "grp").agg(F.sum(F.col("visits") * F.col("score")).cast("long").alias("score"), part(True).alias("fwd"), part(False).alias("rev"))


def tally(mappings: DataFrame, node_paths: DataFrame | Interned) -> DataFrame:
    """tally_groups for every path: (read, path, score, fwd, rev)."""
    graph = node_paths if isinstance(node_paths, Interned) else intern(node_paths)
    return tally_groups(mappings, graph).join(graph.groups, "grp").select("read", "path", "score", "fwd", "rev")


def targets(mappings: DataFrame, node_paths: DataFrame | Interned) -> DataFrame:
    """collapse(winners(tally())) -> (read, target, fwd, rev, forward), where copies of a path count but are never listed."""
    graph = node_paths if isinstance(node_paths, Interned) else intern(node_paths)
    copies = graph.groups.groupBy("grp", transcript_of(F.col("path")).alias("target")).agg(F.count(F.lit(1)).alias("copies"))
    won = winners(tally_groups(mappings, graph)).join(copies, "grp")
    total = lambda c: F.sum(F.col("copies") * F.col(c)).cast("long").alias(c)
    return won.groupBy("read", "target").agg(total("fwd"), total("rev")).withColumn("forward", F.col("fwd") >= F.col("rev"))


def winners(tallies: DataFrame) -> DataFrame:
    """All paths tied at the read's greatest score, negative ones too."""
    return tallies.withColumn("place", F.rank().over(Window.partitionBy("read").orderBy(F.desc("score")))).where("place = 1").drop("place")


def collapse(won: DataFrame) -> DataFrame:
    """Winning paths -> (read, target, fwd, rev, forward); a tie of evidence is forward."""
    return (
        won.groupBy("read", transcript_of(F.col("path")).alias("target"))
        .agg(F.sum("fwd").cast("long").alias("fwd"), F.sum("rev").cast("long").alias("rev"))
        .withColumn("forward", F.col("fwd") >= F.col("rev"))
    )


def strand(targets: DataFrame, keep: str) -> DataFrame:
    if keep not in STRANDS:
        raise ValueError(f"strand must be one of {STRANDS}, not {keep}")
    return targets if keep == "both" else targets.where(F.col("forward") == F.lit(keep == "forward"))


def unique_only(targets: DataFrame) -> DataFrame:
    """Reads with one target only."""
    return targets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("read"))).where("n = 1").drop("n")


def dictionary(names: DataFrame) -> DataFrame:
    """Distinct target names -> dense ids from 0 in byte order, fewer than 2^31 (the cast fails beyond). The dictionary is
    as small as the annotation."""
    return names.distinct().withColumn("target_id", (F.row_number().over(Window.orderBy("target")) - 1).cast("int"))


def encode(targets: DataFrame, known: DataFrame) -> DataFrame:
    """targets with target_id of the dictionary; a target that it lacks fails the query."""
    unknown = F.raise_error(F.concat(F.lit("a target is not in the dictionary: "), "target")).cast("int")
    return targets.join(known, "target", "left").withColumn("target_id", F.coalesce("target_id", unknown))


def unknown(targets: DataFrame, known: DataFrame) -> DataFrame:
    """Targets that the dictionary lacks, with the reads that have them."""
    return targets.join(known.select("target"), "target", "left_anti").groupBy("target").agg(F.count_distinct("read").alias("reads"))


def gene_sets(targets: DataFrame, genes: DataFrame, multi: str = "omit") -> DataFrame:
    """targets and genes (target, gene) -> read, genes (sorted, `;` between), primary_gene, xt: the primary gene where it
    is the only one, or in any case under the policy `first`."""
    if multi not in ("omit", "first"):
        raise ValueError(f"the multi-gene policy is omit or first, not {multi}")
    each = targets.join(genes, "target").groupBy("read").agg(F.array_sort(F.collect_set("gene")).alias("each"))
    first = F.element_at("each", 1)
    xt = first if multi == "first" else F.when(F.size("each") == 1, first)
    return each.select("read", F.array_join("each", ";").alias("genes"), first.alias("primary_gene"), xt.alias("xt"))


def histogram(targets: DataFrame) -> DataFrame:
    """targets of a read -> reads."""
    return targets.groupBy("read").agg(F.count(F.lit(1)).alias("targets")).groupBy("targets").agg(F.count(F.lit(1)).alias("reads"))


def histogram_text(hist: DataFrame) -> DataFrame:
    """One row: `1:2;2:1`, ascending."""
    return hist.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("targets", "reads"))), lambda x: F.concat(x["targets"].cast("string"), F.lit(":"), x["reads"].cast("string"))), ";").alias("histogram"))
