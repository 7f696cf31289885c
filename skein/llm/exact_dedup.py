"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Each round deals the documents of every still ambiguous group by their next bytes (the length counts as the first
digit). A document leaves when its group is a singleton or has ended; only the others, with the bytes not yet read,
go to the next round. Groups are compared byte for byte: no digest decides equality (text_sha256 is only reported).

Per round: one aggregation with map-side combining that gives the groups of two or more, and one join with it whose
skewed side adaptive execution can split, so a text held by a third of all rows meets in no single task. Nothing is
collected but whether rows are left.

Edge cases: null text counts as empty and equals empty text; ids may repeat (each row counts in group_size, and rows
of one id and text are answered alike); a null id loses to any other, and a group of null ids keeps null; an empty table
gives an empty result; only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import remove, saved, scratch, unused

#: Bytes read in each round; the last width repeats.
WIDTHS = (64, 1024, 16384, 262144, 1048576)


def duplicate_groups(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, text -> doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256; a row per row. The
    rows' numbers, if a second scan splits the input otherwise, only name groups and break ties that aren't told here."""
    return _split(docs.withColumn("row", F.monotonically_increasing_id()), widths).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _split(docs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """doc_id, text, row (unique) -> the columns of duplicate_groups, row, and stays: true for one row of each group."""
    folder = scratch(docs.sparkSession, "radix")
    text = F.coalesce("text", F.lit("")).cast("binary")
    state = docs.select(
        "doc_id", "row", F.sha2(text, 256).alias("text_sha256"), F.lit(0).cast("long").alias("part"), F.octet_length(text).cast("long").alias("left"), text.alias("rest")
    )
    rounds, k = [], 0
    while True:
        w = widths[min(k, len(widths) - 1)]
        keys = ["part", "left", "digit"]
        dealt = state.withColumn("digit", F.expr(f"substring(rest, 1, {w})"))
        groups = saved(
            dealt.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "row")).alias("top"), F.min("row").alias("next"))
            .where("size > 1"),
            f"{folder}/groups{k}",
        )
        alone = F.col("next").isNull()
        done = alone | (F.col("left") <= w)
        # always a merge join: its shuffle follows the input, and its skewed side can be split
        split = dealt.join(groups.hint("merge"), keys, "left").select(
            "doc_id",
            "row",
            "text_sha256",
            done.alias("done"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
            (alone | (F.col("row") == F.col("top.row"))).alias("stays"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.when(~done, F.col("next")).alias("part"),
            F.when(~done, F.col("left") - w).alias("left"),
            F.when(~done, F.expr(f"substring(rest, {w + 1})")).alias("rest"),
        )
        split = saved(split, f"{folder}/round{k}")
        remove(docs.sparkSession, f"{folder}/groups{k}")
        rounds.append(split.where("done"))
        state = split.where("not done").select(*state.columns)
        if state.isEmpty():
            break
        k += 1
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def drop_duplicates(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The rows of docs, with all their columns, whose text no row with a larger id has; of rows repeated with id and
    text, one stays."""
    own = unused(docs, "__row")
    named = saved(docs.withColumn(own, F.monotonically_increasing_id()), scratch(docs.sparkSession, "radix-in"))
    stays = _split(named.select("doc_id", "text", F.col(own).alias("row")), widths).where("stays").select(F.col("row").alias(own))
    return named.join(stays, own, "left_semi").select(*docs.columns)
