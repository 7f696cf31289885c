"""The laid-out graph store: the same rows and answers as the graph it was made of, without shuffling the graph."""

import os
import random

import pytest
from pyspark.sql import functions as F

import made
from skein import cli
from skein.operators import attribute, checks
from skein.sources import graph_store
from test_classes import GRAPH, READS, collapsed, graph, mappings, plain

STEPS = "path string, step_ord long, node long, path_rev boolean"


def laid(r, nodes=25):
    rows = graph(r, 12, 4, nodes)
    return [(n, "ACGT" * (n % 5)) for n in range(nodes)], [(p, k, n, rev) for k, (n, p, rev) in enumerate(rows)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    nodes, steps = laid(random.Random(1))
    root = f"file://{tmp_path_factory.mktemp('g')}/store"
    graph_store.write_graph(spark.createDataFrame(nodes, "node long, seq string"), spark.createDataFrame(steps, STEPS), root, 8)
    return root, nodes, steps


@pytest.fixture
def unbroadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanged(df, column):
    """How often the plan shuffles, and what by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count(f"Exchange hashpartitioning({column}#")


def test_rows(spark, stored):
    root, nodes, steps = stored
    g = graph_store.open_graph(spark, root)
    assert sorted(map(tuple, g.nodes.collect())) == sorted(nodes)
    assert sorted(map(tuple, g.steps.select("path", "step_ord", "node", "path_rev").collect())) == sorted(steps)
    assert g.paths.count() == len({s[0] for s in steps})
    for name in ("nodes", "steps", "classes", "members", "groups"):  # a file a bucket at most
        files = [f.split("_")[-1].split(".")[0] for d, _, fs in os.walk(root[len("file://") :]) if d.endswith(f"/{name}") for f in fs if f.startswith("part-")]
        assert 0 < len(files) == len(set(files)) <= 8


def test_targets_of_some_paths(spark, stored):
    """All paths are interned; those that a map names are what counts."""
    root, _, steps = stored
    r = random.Random(2)
    maps = mappings(r, 120, 27)
    named = sorted({s[0] for s in steps})
    for some in (named, r.sample(named, 11), named[:1], []):
        g = attribute.restricted(graph_store.open_graph(spark, root).interned, spark.createDataFrame([(p,) for p in some], "path string"))
        m = spark.createDataFrame(maps, READS)
        want = plain([(n, p, rev) for p, _, n, rev in steps if p in some], maps)
        assert set(map(tuple, attribute.tally(m, g).collect())) == want
        assert set(map(tuple, attribute.targets(m, g).collect())) == collapsed(want)


def test_graph_stays_in_place(spark, stored, unbroadcast):
    """Each join with the graph by node shuffles the reads' side alone."""
    g = graph_store.open_graph(spark, stored[0])
    m = spark.createDataFrame(mappings(random.Random(3), 60, 27), READS)
    assert exchanged(m.join(g.walks, "node"), "node") == (1, 1)
    assert exchanged(m.join(g.interned.classes, "node"), "node") == (1, 1)
    assert exchanged(m.join(g.nodes, "node"), "node") == (1, 1)
    assert exchanged(m.join(g.nodes.select("node"), "node", "left_anti"), "node") == (1, 1)
    assert exchanged(g.walks.join(g.nodes, "node"), "node") == (0, 0)
    assert exchanged(g.walks.groupBy("node").count(), "node") == (0, 0)
    plain_side = spark.createDataFrame([(1, "A")], "node long, seq string")
    assert exchanged(m.join(plain_side, "node"), "node") == (2, 2)  # as it is without a store
    assert {x.node for x in checks.missing(m, g.nodes, "node").collect()} <= {25, 26}


def test_lookups_read_their_buckets(spark, tmp_path):
    """Broken files of other buckets don't matter to who asks for a node."""
    nodes, steps = laid(random.Random(6))
    root = f"file://{tmp_path}/store"
    graph_store.write_graph(spark.createDataFrame(nodes, "node long, seq string"), spark.createDataFrame(steps, STEPS), root, 8)
    bucket = spark.range(7, 8).select(F.pmod(F.hash("id"), F.lit(8))).first()[0]
    broken = [p for p in (tmp_path / "store").glob("*/steps/part-*") if f"_{bucket:05d}." not in p.name]
    for p in broken:
        p.write_bytes(b"no table")
    walks = graph_store.open_graph(spark, root).walks
    assert broken and walks.where("node = 7").count() == sum(s[2] == 7 for s in steps) > 0
    with pytest.raises(Exception, match="(?i)parquet|checksum"):
        walks.where("path_rev").collect()


def test_replaced_or_left(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    with pytest.raises(checks.InputError):
        graph_store.open_graph(spark, root)
    df = lambda nodes, steps: (spark.createDataFrame(nodes, "node long, seq string"), spark.createDataFrame(steps, STEPS))
    old, new = laid(random.Random(4), 9), laid(random.Random(5), 12)
    graph_store.write_graph(*df(*old), root, 3)
    for nodes, steps in (([(None, "A")], []), ([(1, "A"), (1, "C")], []), ([], [("p", 0, None, False)]), ([], [(None, 0, 1, False)])):
        with pytest.raises(checks.InputError):
            graph_store.write_graph(*df(nodes, steps), root, 3)
    with monkeypatch.context() as mp:  # fails when all tables are written
        mp.setattr(graph_store, "_name_version", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            graph_store.write_graph(*df(*new), root, 5)
    rows = lambda: (sorted(map(tuple, graph_store.open_graph(spark, root).nodes.collect())), sorted(map(tuple, graph_store.open_graph(spark, root).steps.collect())))
    assert rows() == (sorted(old[0]), sorted(old[1])) and len(os.listdir(tmp_path / "store")) <= 3
    graph_store.write_graph(*df(*new), root, 5)
    assert rows() == (sorted(new[0]), sorted(new[1]))
    assert len([n for n in os.listdir(tmp_path / "store") if not n.startswith(".")]) == 2  # one version and the manifest
    graph_store.write_graph(*df([], []), root)
    assert rows() == ([], []) and attribute.targets(spark.createDataFrame([(1, 2, False, 3, 4)], READS), graph_store.open_graph(spark, root).interned).collect() == []


def test_command_line(spark, tmp_path):
    """A run that saves the graph, one over the saved graph and one over the text write the same bytes; the map names some
    of the paths only."""
    d = made.write(tmp_path, *made.small(8))
    argv = ["--reads", f"{d}/reads.json", "--t2g", f"{d}/exon.tsv", "--raw-cb-length", "6", "--raw-umi-length", "4"]
    told = []
    for k, more in enumerate((["--graph", f"{d}/g.gfa"], ["--graph", f"{d}/g.gfa", "--save-graph", f"file://{d}/store"], ["--graph", f"file://{d}/store"])):
        out = tmp_path / f"o{k}"
        cli.run(spark, cli.parser().parse_args([*argv, *more, "--out-dir", str(out)]), "cmd")
        told.append([b"".join(p.read_bytes() for p in sorted((out / name).glob("part-*"))) for name in ("map.rad", "summary.tsv", "tx2gene.tsv")])
    assert told[0] == told[1] == told[2] and all(told[0])
