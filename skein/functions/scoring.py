"""Edit scores as window expressions over edits, and read offsets of subpaths as a row-local fold.

Edits are rows (part columns..., ord, from_length, to_length, mismatch) of one subpath each; the same window serves
the running read position and the affine-gap state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Params:
    match: int = 1
    mismatch: int = 4
    gap_open: int = 6
    gap_extend: int = 1
    end_bonus: int = 5
    read_ends: bool = True


def score_edits(edits: DataFrame, part: list[str], offset: Column | None = None, total: Column | None = None, p: Params = Params(), order: list[str] | None = None) -> DataFrame:
    """Adds read_pos and score to each edit. offset is where the subpath starts in the read (0), total the read's length
    (the subpath's own sum); order names the columns that order edits (ord). Empty edits score 0 and end no gap. One
    window serves all: one shuffle, one sort."""
    w = Window.partitionBy(*part).orderBy(*(order or ["ord"]))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    n, to = F.col("from_length"), F.col("to_length")
    empty = (n == 0) & (to == 0)
    deletion = (n > 0) & (to == 0)
    whole = F.sum("to_length").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = edits.select(
        "*",
        ((F.lit(0) if offset is None else offset) + F.coalesce(F.sum("to_length").over(ahead), F.lit(0))).cast("long").alias("read_pos"),
        F.coalesce(F.last(F.when(~empty, deletion), ignorenulls=True).over(ahead), F.lit(False)).alias("in_deletion"),
        (whole if total is None else total).cast("long").alias("__total"),
    )
    at_start = F.col("read_pos") == 0
    at_end = F.col("read_pos") + to == F.col("__total")
    bonus = (at_start.cast("int") + at_end.cast("int")) * (p.end_bonus if p.read_ends else 0)
    clip = (at_start | at_end) & F.lit(p.read_ends)
    score = (
        F.when(empty, F.lit(0))
        .when(deletion, F.when(F.col("in_deletion"), -p.gap_extend * n).otherwise(-(p.gap_open + (n - 1) * p.gap_extend)))
        .when(n == 0, F.when(clip, F.lit(0)).otherwise(-(p.gap_open + (to - 1) * p.gap_extend)))
        .otherwise(F.when(F.col("mismatch"), -p.mismatch * n).otherwise(p.match * n) + bonus)
    )
    return placed.withColumn("score", score.cast("long")).drop("in_deletion", "__total")


def fold_mappings(mapping: str, offset: str, total: str, p: Params = Params()) -> Column:
    """The scores of score_edits as a fold within the row: SQL names of a subpath's mappings (node, is_reverse, edit), its
    offset and the read's length -> array<struct<node, read_rev, score, aligned>>, without a shuffle."""
    ends = f"(int(a.pos = 0) + int(a.pos + e.to_length = {total}))" if p.read_ends else "0"
    score = (
        "case when e.from_length = 0 and e.to_length = 0 then 0 "
        f"when e.to_length = 0 then if(a.gap, -{p.gap_extend} * e.from_length, -({p.gap_open} + (e.from_length - 1) * {p.gap_extend})) "
        f"when e.from_length = 0 then if({ends} > 0, 0, -({p.gap_open} + (e.to_length - 1) * {p.gap_extend})) "
        f"else if(e.sequence <> '', -{p.mismatch}, {p.match}) * e.from_length + {ends} * {p.end_bonus} end"
    )
    state = "named_struct('pos', bigint({pos}), 'gap', {gap}, 'score', bigint({score}), 'aligned', bigint({aligned}), 'node', {node}, 'read_rev', {rev})"
    step = state.format(
        pos="a.pos + e.to_length",
        gap="if(e.from_length = 0 and e.to_length = 0, a.gap, e.from_length > 0 and e.to_length = 0)",
        score=f"a.score + {score}",
        aligned="a.aligned + if(e.from_length > 0 and e.to_length > 0, e.from_length, 0)",
        node="a.node",
        rev="a.read_rev",
    )
    begin = state.format(pos="element_at(done, -1).pos", gap="element_at(done, -1).gap", score="0", aligned="0", node="m.node", rev="m.is_reverse")
    first = state.format(pos=offset, gap="false", score="0", aligned="0", node="bigint(0)", rev="false")
    every = f"aggregate({mapping}, array({first}), (done, m) -> concat(done, array(aggregate(m.edit, {begin}, (a, e) -> {step}))))"
    return F.expr(f"transform(slice({every}, 2, size({mapping})), x -> named_struct('node', x.node, 'read_rev', x.read_rev, 'score', x.score, 'aligned', x.aligned))")


def aligned_bases() -> Column:
    """Bases of an edit that stand on both sides."""
    return F.when((F.col("from_length") > 0) & (F.col("to_length") > 0), F.col("from_length")).otherwise(F.lit(0)).cast("long")


def read_offsets(lengths: str, nexts: str, starts: str) -> Column:
    """SQL names of array<bigint> lengths, array<array<int>> successors and array<int> seeds of subpaths in stored
    order -> offsets. One forward pass: the first writer of a subpath wins, unreachable ones keep 0; without seeds the
    subpaths that none leads to are seeds. Seen from a subpath, its writer is its least predecessor that was known when
    the pass came by: one that stands ahead of it, else one behind. So a fold appends one offset a subpath (null: not
    known when the pass came by), and only subpaths without any are looked at again."""
    every = f"sequence(0, size({lengths}) - 1)"
    seeds = f"if(size(coalesce({starts}, array())) > 0, {starts}, array_except({every}, flatten({nexts})))"
    led = f"transform({every}, j -> filter({every}, i -> array_contains(get({nexts}, i), j)))"
    writer = "get(filter(get(x.led, j), i -> {place} and get({acc}, i) is not null), 0)"
    come = lambda place, acc: f"transform(array({writer.format(place=place, acc=acc)}), w -> get({acc}, w) + get({lengths}, w))[0]"
    step = f"concat(acc, array(if(array_contains(x.seeds, j), bigint(0), {come('i < j', 'acc')})))"
    known = f"aggregate({every}, cast(array() as array<bigint>), (acc, j) -> {step})"
    told = f"transform(array({known}), known -> transform(known, (found, j) -> coalesce(found, {come('i > j', 'known')}, bigint(0))))[0]"
    alone = f"transform({lengths}, x -> bigint(0))"  # one subpath starts at 0, whatever leads to it
    return F.expr(f"if(size({lengths}) <= 1, {alone}, transform(array(named_struct('led', {led}, 'seeds', {seeds})), x -> {told})[0])")
