"""A graph laid out once for the joins with reads: tables in sorted buckets by node, so that mappings are shuffled to the
graph and the graph stays where it is.

A store is a folder of versions and a manifest that names the one that counts. A version is written under a name of its
own, and the manifest is put in its place by one rename that replaces: readers find the old graph or the new one, and a
failed write leaves the old one as it was. Any store with atomic renames of files will do (HDFS or a mounted folder).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators.attribute import Interned, intern
from skein.operators.checks import InputError
from skein.session import exists, remove, saved, scratch, scratch_dropped, shuffles_dropped

MANIFEST = "manifest"
#: Of each table its columns, what it is bucketed by, and the order within a bucket. Paths have no bucket of their own.
TABLES = {
    "nodes": ("node bigint, seq string", "node", "node"),
    "paths": ("path_id bigint, path string", None, None),
    "steps": ("path_id bigint, step_ord bigint, node bigint, path_rev boolean", "node", "node, path_id, step_ord"),
    "classes": ("node bigint, cls bigint", "node", "node"),
    "members": ("cls bigint, grp string, path_rev boolean, visits bigint", "cls", "cls"),
    "groups": ("path string, grp string", "grp", "grp"),
}


@dataclass(frozen=True)
class Graph:
    """nodes (node, seq) and walks (path_id, step_ord, node, path_rev) in buckets by node, paths (path_id, path), and all
    paths interned (classes in buckets by node)."""

    nodes: DataFrame
    walks: DataFrame
    paths: DataFrame
    interned: Interned

    @property
    def steps(self) -> DataFrame:
        """path, step_ord, node, path_rev: names come from the dictionary, which Spark broadcasts where its size allows."""
        return self.walks.join(self.paths, "path_id").select("path", "step_ord", "node", "path_rev")


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _table(spark: SparkSession, root: str, version: str, name: str, buckets: int) -> str:
    """Makes a table known to the session, by the definition that the folder's version fixes; its files stay the folder's."""
    columns, by, order = TABLES[name]
    laid = f"CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS" if by else ""
    table, at = f"skein_graph_{version}_{name}", f"{root}/{version}/{name}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {laid} LOCATION '{at}'")
    return table


def _manifest(spark: SparkSession, root: str) -> tuple[str, int] | None:
    if not exists(spark, f"{root}/{MANIFEST}"):
        return None
    version, buckets = spark.read.text(f"{root}/{MANIFEST}").first()[0].split()
    return version, int(buckets)


def _name_version(spark: SparkSession, root: str, version: str, buckets: int) -> None:
    """Puts a new manifest in the place of any older one."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, at = fs.Path(f"{root}/{version}/{MANIFEST}"), fs.Path(f"{root}/{MANIFEST}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(f"{version} {buckets}\n".encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    home = new.getFileSystem(conf)
    fs.FileContext.getFileContext(home.getUri(), conf).rename(home.makeQualified(new), home.makeQualified(at), how)


def is_graph(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root.rstrip('/')}/{MANIFEST}")


def write_graph(nodes: DataFrame, steps: DataFrame, root: str, buckets: int | None = None) -> Graph:
    """nodes (node, seq) and steps (path, step_ord, node, path_rev) -> a store at root, which takes the place of an older
    one there; whoever reads the older one then has to open it anew. Buckets, as many as the session's shuffle partitions
    unless told, are one file each; a join keeps the graph in place where the session shuffles to no more partitions than
    there are buckets. Shuffled are the steps by node and by path, here and never again. A null node or path is refused."""
    spark, root = nodes.sparkSession, root.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    old, version = _manifest(spark, root), uuid.uuid4().hex[:12]
    try:
        with scratch_dropped(spark):
            folder = scratch(spark, "graph")
            nodes = saved(nodes.select("node", "seq"), f"{folder}/nodes")
            steps = saved(steps.select("path", F.col("step_ord").cast("long").alias("step_ord"), "node", "path_rev"), f"{folder}/steps")
            for rows, on in ((nodes, "node is null"), (steps, "node is null or path is null")):
                if not rows.where(on).isEmpty():
                    raise InputError(f"a graph has a row where {on}")
            if not nodes.groupBy("node").count().where("count > 1").isEmpty():
                raise InputError("a graph has a node twice")
            # ids ascend within the range of names that a task has; stored, they are what they are
            named = steps.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path")
            paths = saved(named.select(F.monotonically_increasing_id().alias("path_id"), "path"), f"{folder}/paths")
            known = intern(steps.select("node", "path", "path_rev"), f"{folder}/interned")
            made = {"nodes": nodes, "paths": paths, "steps": steps.join(paths, "path"), "classes": known.classes, "members": known.members, "groups": known.groups}
            for name, rows in made.items():
                columns, by, _ = TABLES[name]
                rows = rows.select(*_names(columns))
                with shuffles_dropped(spark):  # dealt by the buckets' own hash, so that a task writes a bucket's only file
                    (rows.repartition(buckets, by) if by else rows).write.insertInto(_table(spark, root, version, name, buckets))
        _name_version(spark, root, version, buckets)
    except BaseException:
        _forget(spark, root, version)
        raise
    if old:
        _forget(spark, root, old[0])
    return open_graph(spark, root)


def _forget(spark: SparkSession, root: str, version: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS skein_graph_{version}_{name}")
    remove(spark, f"{root}/{version}")


def open_graph(spark: SparkSession, root: str) -> Graph:
    """A store's graph, in any session."""
    root = root.rstrip("/")
    told = _manifest(spark, root)
    if told is None:
        raise InputError(f"no graph is stored at {root}")
    t = {name: spark.table(_table(spark, root, told[0], name, told[1])) for name in TABLES}
    return Graph(t["nodes"], t["steps"], t["paths"], Interned(t["groups"], t["classes"], t["members"]))
