"""Molecules from UMIs with sequencing errors: a UMI that differs by one base from one read far more often is its copy.

Within a cell and gene, an edge leads from UMI a to UMI b if they have equal length and differ in one place, and a was
read at least 2n - 1 times where b was read n times. UMIs that edges connect are one molecule, named by its least UMI.

Neighbours meet by keys, a UMI with one place masked: at most as many share one as there are letters, so no pairs of a
whole group are made, however large it is. Components are found by rounds of least labels and pointer jumps, each
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.session import remove, saved, scratch

_GROUP = ["cell", "gene"]


def edges(umis: DataFrame) -> DataFrame:
    """umis (cell, gene, umi, n), each once -> cell, gene, a, b."""
    places = F.explode(F.sequence(F.lit(1), F.length("umi"))).alias("place")
    keys = umis.where("length(umi) > 0").select(*_GROUP, "umi", "n", places)
    rest = F.expr("concat(substring(umi, 1, place - 1), ' ', substring(umi, place + 1))")  # the blank stands for any letter
    keys = keys.select(*_GROUP, "place", rest.alias("rest"), "umi", "n")
    other = keys.select(*_GROUP, "place", "rest", F.col("umi").alias("b"), F.col("n").alias("m"))
    met = keys.withColumnRenamed("umi", "a").join(other, [*_GROUP, "place", "rest"])
    return met.where("a <> b and n >= 2 * m - 1").select(*_GROUP, "a", "b")


def molecules(umis: DataFrame) -> DataFrame:
    """umis (cell, gene, umi, n), each once and none null -> cell, gene, umi, n, molecule."""
    folder = scratch(umis.sparkSession, "network")
    umis = saved(umis, f"{folder}/umis")
    one = edges(umis)
    both = saved(one.union(one.select(*_GROUP, "b", "a")).distinct(), f"{folder}/edges")
    labels, k = saved(umis.withColumn("molecule", F.col("umi")), f"{folder}/0"), 0
    while True:
        near = both.join(labels.select(*_GROUP, F.col("umi").alias("b"), "molecule"), [*_GROUP, "b"]).groupBy(*_GROUP, "a").agg(F.min("molecule").alias("least"))
        lower = labels.join(near.withColumnRenamed("a", "umi"), [*_GROUP, "umi"], "left").withColumn("lower", F.least("molecule", "least"))  # least() skips nulls
        lower = saved(lower.select(*_GROUP, "umi", "n", "molecule", "lower"), f"{folder}/lower{k}")
        remove(umis.sparkSession, f"{folder}/{k}")
        if lower.where("lower <> molecule").isEmpty():
            return lower.select(*_GROUP, "umi", "n", "molecule")
        jump = lower.select(*_GROUP, F.col("umi").alias("lower"), F.col("lower").alias("further"))
        k += 1
        labels = saved(lower.join(jump, [*_GROUP, "lower"]).select(*_GROUP, "umi", "n", F.least("lower", "further").alias("molecule")), f"{folder}/{k}")
        remove(umis.sparkSession, f"{folder}/lower{k - 1}")


def network_counts(records: DataFrame) -> DataFrame:
    """records (cell, gene, umi) -> gene, cell, umis (distinct), count (molecules). Records without cell, gene or UMI don't
    count."""
    known = records.where("cell is not null and gene is not null and umi is not null")
    told = molecules(known.groupBy(*_GROUP, "umi").agg(F.count(F.lit(1)).alias("n")))
    return told.groupBy("gene", "cell").agg(F.count(F.lit(1)).alias("umis"), F.count_distinct("molecule").alias("count"))
