"""Tasks follow the input's rows, not the session's number of partitions, and results stay what they are."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from skein import session
from skein.functions import quality, scoring
from skein.operators import attribute
from skein.plans import driver, driver_files
from skein.sources import writers

SF = "/root/testdata/sf0.001"


def files(path):
    return len(glob.glob(path.removeprefix("file://") + "/part-*"))


def test_tasks_follow_rows(spark, monkeypatch):
    assert session.tasks_for(spark, 0) == 4 and session.tasks_for(spark, 9 * session.ROWS_A_TASK + 1) == 10
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    with session.parted(spark, 1000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


@pytest.fixture(autouse=True)
def as_dealt(spark):
    """Small partitions aren't merged: they stand for large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def stored(monkeypatch, module):
    """Where module writes its tables, by their last name."""
    seen, whole = {}, session.saved
    monkeypatch.setattr(module, "saved", lambda df, path: seen.setdefault(path.rsplit("/", 1)[-1].split("-")[0], path) and whole(df, path))
    return seen


@pytest.mark.parametrize("mode", ["score", "genefull_exonoverintron"])
def test_conversion(spark, monkeypatch, mode):
    """The tally and all that follows it."""
    from skein.plans import convert

    text = lambda out: (driver_files._hit_text(out).orderBy("read").collect(), sorted(out["summary"].collect()))
    want = text(driver_files.converted(spark, SF, count_mode=mode))
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    seen = stored(monkeypatch, convert)
    out = driver_files.converted(spark, SF, count_mode=mode)
    assert text(out) == want
    assert files(seen["targets"]) > 4 and out["records"].rdd.getNumPartitions() > 4
    ords = [r.ord for r in out["records"].collect()]
    assert ords == sorted(ords)


def test_alignments(spark, monkeypatch):
    """Lines are dealt by read before any list is made of them, to as many tasks as the lines ask for."""
    every = lambda: driver_files.alignments(spark, SF).agg(F.count(F.lit(1)), F.sum(F.xxhash64("name", "sequence", "subpath", "ord").cast("decimal(38,0)"))).first()
    want = every()
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    assert every() == want
    made = driver_files.alignments(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("ObjectHashAggregate")
    assert made.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300) > 4


def test_interned(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    seen = stored(monkeypatch, attribute)
    attribute.intern(driver.node_paths(spark, SF), session.scratch(spark, "graph"))
    assert files(seen["rows"]) > 4


def planned(monkeypatch, module):
    """The plans of the tables that module writes, by their last name."""
    seen, whole = {}, session.saved
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(module, "saved", lambda df, path: seen.setdefault(path.rsplit("/", 1)[-1].split("-")[0], plan(df)) and whole(df, path))
    return seen


@pytest.mark.parametrize("kept", ["off", "first"])
def test_groups_are_dealt_first(spark, monkeypatch, kept):
    """Reads are dealt by name, and steps by node and path, before anything is sorted or hashed, and without mappings."""
    from skein.plans import convert

    groups, graph = planned(monkeypatch, convert), planned(monkeypatch, attribute)
    driver_files.converted(spark, SF, alignments=kept)
    for plan, key in ((groups["groups"], "name"), (graph["rows"], "node")):
        behind, ahead = (len(re.findall(rf"Aggregate\(keys?=\[{key}", part)) for part in plan.split("Exchange", 1))
        assert (behind, ahead) == (2, 0)
    assert groups["groups"].count("Exchange") == 1 and "subpath" not in groups["groups"].split("Exchange")[0]


def test_scans_are_split(spark, monkeypatch):
    """Scans of the tables that a conversion writes, and of its input, read no more than 16 MB a task."""
    from skein.plans import convert

    key, seen, whole = "spark.sql.files.maxPartitionBytes", {}, session.saved
    before = spark.conf.get(key)
    monkeypatch.setattr(convert, "saved", lambda df, path: seen.setdefault(path.rsplit("/", 1)[-1], spark.conf.get(key)) and whole(df, path))
    driver_files.converted(spark, SF)
    assert spark.conf.get(key) == before != "16m"
    assert seen == dict.fromkeys(("reads", "groups", "mappings", "targets"), "16m")
    monkeypatch.setattr(session, "saved", lambda df, path: seen.setdefault("rows", spark.conf.get(key)) and whole(df, path))
    assert [r[0] for r in session.in_order(spark.range(9, -1, -1), "id").collect()] == list(range(10)) and seen["rows"] == "16m"


def test_rad_order(spark, monkeypatch):
    """Hits become records again in as many tasks as they ask for."""
    want = sorted(map(tuple, driver_files._rad_order(spark, SF).collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    got = driver_files._rad_order(spark, SF)
    assert got.rdd.getNumPartitions() > 4 and sorted(map(tuple, got.collect())) == want


def test_files_in_order(spark, tmp_path, monkeypatch):
    """Written rows go to as many tasks as they ask for, and a file's lines stay in order."""
    rows = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("ord"), F.concat(F.lit("r"), "id").alias("read"), F.lit("missing").alias("status"))
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    writers.write_rejected(rows, str(tmp_path / "warnings"))
    parts = sorted(glob.glob(f"{tmp_path}/warnings/part-*"))
    lines = [line for p in parts for line in open(p).read().splitlines()]
    assert len(parts) == 10 and lines == [f"warning: skipping r{k}: molecule missing" for k in range(999, -1, -1)]


def test_one_subpath(spark):
    """A lone subpath starts at 0 even if it leads to itself; more go the long way."""
    rows = [([5], [[]], []), ([5], [[0]], []), ([5], [[]], [0]), ([], [], []), ([5, 7], [[1], []], [])]
    df = spark.createDataFrame(rows, "l array<bigint>, n array<array<int>>, s array<int>")
    assert [r[0] for r in df.select(scoring.read_offsets("l", "n", "s")).collect()] == [[0], [0], [0], [], [0, 5]]


def test_driver_targets(spark, monkeypatch):
    every = lambda: driver.targets(spark, SF).agg(F.count(F.lit(1)), F.sum(F.xxhash64("read", "target", "fwd", "rev", "forward").cast("decimal(38,0)"))).first()
    want = every()
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    seen = stored(monkeypatch, driver)
    assert every() == want and files(seen["targets"]) > 4


def test_stream(spark, monkeypatch):
    """As many files as reads ask for, in two batches, in the order of their names; Spark keeps no state of names."""
    want = driver_files._hit_text(driver_files.converted(spark, SF)).orderBy("read").collect()
    made = {}
    monkeypatch.setattr(driver_files, "ROWS_A_TASK", 300)
    monkeypatch.setattr(driver_files, "scratch", lambda s, name: made.setdefault(name, session.scratch(s, name)))
    assert driver_files._hit_text(driver_files._streamed(spark, SF)).orderBy("read").collect() == want
    parts = sorted(glob.glob(made["stream-in"].removeprefix("file://") + "/part-*"))
    times = [os.path.getmtime(p) for p in parts]
    out = made["stream"].removeprefix("file://")
    assert len(parts) > 2 and times == sorted(times) and len(set(times)) == len(times)
    assert len(glob.glob(f"{out}/names/batch=*")) == 2 and not os.path.exists(f"{out}/checkpoint/state")


def test_edits_keep_their_rows(spark):
    """Batches of edits are scored at once: none is lost without its node, and a character of several bytes is one base."""
    rows = [("r", 1, False, 2, 2, 0, 1, 4, "Cg", b"\x28\x28", 2), ("r", 1, True, 2, 2, 2, 0, 4, "äC", b"\x28\x28", 2), ("r", 9, False, 1, 1, 1, 0, 4, "A", b"\x28", 1), ("r", 1, False, 1, 0, 1, 0, 4, "", b"", -6)]
    scored = spark.createDataFrame(rows, "read string, node long, read_rev boolean, from_length long, to_length long, read_pos long, ref_pos long, read_total long, bases string, quals binary, score long")
    nodes = spark.createDataFrame([(1, "ACGT")], "node long, seq string")
    hit, _, end = quality.tables()
    got = quality.adjust(quality.with_bases(scored, nodes)).select("node", "read_rev", "from_length", "score").collect()
    want = [(1, False, 2, 2 * hit[40] + end[40]), (1, True, 2, hit[40] + end[40]), (9, False, 1, 1), (1, False, 1, -6)]
    assert sorted(map(tuple, got)) == sorted(want)
