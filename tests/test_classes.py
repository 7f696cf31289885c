"""Path groups and node classes, prefix sums by blocks, and read offsets, each against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.functions import scoring
from skein.operators import attribute, counting

GRAPH = "node long, path string, path_rev boolean"
READS = "read long, node long, read_rev boolean, score long, aligned long"


def graph(r, transcripts, copies, nodes):
    """Transcripts with copies, some of which leave out or turn a node; a node may be visited twice."""
    rows = []
    for t in range(transcripts):
        walk = [(r.randrange(nodes), r.random() < 0.3) for _ in range(r.randrange(1, 8))]
        for c in range(copies):
            mine = list(walk)
            if c % 3 == 2:
                mine.pop(r.randrange(len(mine)))
            rows += [(n, f"T{t}_H{c}", rev) for n, rev in mine]
    return rows


def mappings(r, reads, nodes):
    return [(i, r.randrange(nodes), r.random() < 0.4, r.randrange(-5, 30), r.randrange(0, 20)) for i in range(reads) for _ in range(r.randrange(1, 6))]


def plain(rows, maps):
    at = defaultdict(list)
    for n, p, rev in rows:
        at[n].append((p, rev))
    out = defaultdict(lambda: [0, 0, 0])
    for read, n, rev, score, aligned in maps:
        for p, path_rev in at[n]:
            t = out[read, p]
            t[0] += score
            t[1 if rev == path_rev else 2] += aligned
    return {(*k, *v) for k, v in out.items()}


def collapsed(tallies):
    best, out = {}, defaultdict(lambda: [0, 0])
    for read, _, score, _, _ in tallies:
        best[read] = max(best.get(read, score), score)
    for read, p, score, fwd, rev in tallies:
        if score == best[read]:
            t = out[read, p.rsplit("_H", 1)[0]]
            t[0] += fwd
            t[1] += rev
    return {(*k, f, b, f >= b) for k, (f, b) in out.items()}


def test_tally_and_targets(spark):
    r = random.Random(1)
    rows, maps = graph(r, 12, 6, 25), mappings(r, 150, 27)
    g, m = spark.createDataFrame(rows, GRAPH), spark.createDataFrame(maps, READS)
    want = plain(rows, maps)
    assert set(map(tuple, attribute.tally(m, g).collect())) == want
    got = attribute.targets(m, g)
    assert set(map(tuple, got.collect())) == collapsed(want)
    longer = attribute.collapse(attribute.winners(attribute.tally(m, g)))
    assert set(map(tuple, longer.select(*got.columns).collect())) == collapsed(want)
    empty = spark.createDataFrame([], GRAPH)
    assert attribute.targets(m, empty).collect() == [] and attribute.tally(m.limit(0), g).collect() == []


def test_copies_add_no_work(spark, tmp_path):
    """Sums of reads and what they are joined with are the same with one copy of every path and with a thousand."""
    r = random.Random(2)
    walks = [[(r.randrange(9), False) for _ in range(4)] for _ in range(5)]
    maps = spark.createDataFrame(mappings(r, 40, 9), READS)
    sizes, answers = [], []
    for copies in (1, 1000):
        rows = [(n, f"T{t}_H{c}", rev) for t, w in enumerate(walks) for c in range(copies) for n, rev in w]
        g = attribute.intern(spark.createDataFrame(rows, GRAPH), f"file://{tmp_path}/{copies}")
        sizes.append((g.classes.count(), g.members.count(), maps.join(g.classes, "node").count(), attribute.tally_groups(maps, g).count()))
        answers.append({(x.read, x.target, x.fwd // copies, x.rev // copies, x.forward) for x in attribute.targets(maps, g).collect()})
        assert g.groups.count() == 5 * copies
    assert sizes[0] == sizes[1] and answers[0] == answers[1]


def test_equal_hashes_are_looked_into(spark, monkeypatch):
    r = random.Random(3)
    rows, maps = graph(r, 8, 4, 12), mappings(r, 60, 12)
    monkeypatch.setattr(attribute.F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    got = attribute.tally(spark.createDataFrame(maps, READS), spark.createDataFrame(rows, GRAPH))
    assert set(map(tuple, got.collect())) == plain(rows, maps)


def test_reads_are_dealt_once(spark, tmp_path):
    """Mappings that are partitioned by read stay so up to the targets."""
    r = random.Random(4)
    g = attribute.intern(spark.createDataFrame(graph(r, 5, 3, 9), GRAPH), f"file://{tmp_path}/g")
    m = spark.createDataFrame(mappings(r, 50, 9), READS).repartition("read")
    plan = attribute.targets(m, g)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(read") == 1 and "hashpartitioning(cls" not in plan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_total(spark, block):
    r = random.Random(5)
    steps = [(p, i, r.randrange(30)) for p in "abc" for i in range(r.randrange(1, 60))] + [("far", 10**12, 3), ("far", -4, 2)]
    nodes = [(n, r.randrange(0, 9)) for n in range(30)]
    length, want, at = dict(nodes), [], Counter()
    for p, i, n in sorted(steps):
        want.append((p, i, n, at[p], at[p] + length[n]))
        at[p] += length[n]
    got = counting.node_spans(spark.createDataFrame(steps, "path string, step_ord long, node long"), spark.createDataFrame(nodes, "node long, length long"), block)
    assert sorted(map(tuple, got.collect())) == want


def offsets(lengths, nexts, starts):
    n = len(lengths)
    led = {j for x in nexts for j in x or [] if j is not None}
    known = {s: 0 for s in (starts or [i for i in range(n) if i not in led])}
    for i in range(n):
        for j in nexts[i] or []:
            if i in known and j is not None:
                known.setdefault(j, known[i] + lengths[i])
    return [known.get(i, 0) for i in range(n)]


def test_read_offsets(spark):
    r = random.Random(6)
    rows = [(0, [], [], []), (1, [4], [[]], None), (2, [4, 5], [[1, None], [0]], [0])]
    for k in range(3, 300):
        n = r.randrange(1, 9)
        nexts = [sorted({r.randrange(n) if r.random() < 0.3 else min(n - 1, i + r.randrange(1, 4)) for _ in range(r.randrange(3))}) for i in range(n)]
        rows.append((k, [r.randrange(1, 20) for _ in range(n)], nexts, r.choice([None, [], [0], [r.randrange(n)]])))
    df = spark.createDataFrame(rows, "k int, lengths array<bigint>, nexts array<array<int>>, starts array<int>")
    got = {x.k: x.o for x in df.select("k", scoring.read_offsets("lengths", "nexts", "starts").alias("o")).collect()}
    for k, lengths, nexts, starts in rows:
        assert got[k] == offsets(lengths, nexts, starts), (k, lengths, nexts, starts)


def test_fidelity_of_so_many_subpaths(spark):
    rows = [(i, i + (i % 4 == 0), float(i % 40)) for i in range(100)]
    df = spark.createDataFrame(rows, "node_score long, mapper_score long, base_quality double")
    (r,) = counting.fidelity(df).collect()
    assert (r.subpaths, r.matching, r.per_mille) == (100, 75, 750)
    same, other = ([q for a, b, q in rows if (a == b) == on] for on in (True, False))
    assert r.quality_matching == sum(same) / 75 and r.quality_deviating == sum(other) / 25
    assert counting.fidelity(df, most=30).first().subpaths == 30 and counting.fidelity(df, most=1000).first().subpaths == 100
    (r,) = counting.fidelity(df.limit(0)).collect()
    assert (r.subpaths, r.matching, r.per_mille) == (0, 0, None)
