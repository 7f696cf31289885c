"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes), one task per text, no shuffle. Texts with the same set
   form a class (128-bit digest of the set); from here on only one text of each class goes on.
2. MinHash signatures are banded. Classes that share a band meet in that band's bucket, where signatures are compared
   batch by batch: after each batch a pair is dropped if the posterior probability that its similarity reaches the
   threshold (binomial likelihood, uniform prior) is below the chosen miss probability. What is left of a bucket is
   told as a spanning forest, never as all its pairs. The forest's components are provisional clusters.
3. Texts of a cluster are brought together once, in blocks of bounded size. In a block, pairs are pruned by the same
   bounds and then verified on their full sets, skipping pairs already connected. Clusters of several blocks are dealt
   anew once more, and then every class outside its cluster's largest component (a probe) is compared with the whole
   cluster, so that no pair across components stays untested: probes are dealt to blocks, too, their signatures are
   compared with those of GROUP x GROUP pairs of blocks a task, and only texts of pairs that aren't pruned go on to
   their pair of blocks, where they are verified. A task holds two blocks, however many probes a cluster has. Where
   probes times members are over RARE times the cluster's shingles (texts that share a passage, but are far from the
   threshold, would be compared all with all), probes and members meet by rare shingles instead: with the shingles of
   each ordered by how many classes of the cluster have them, two sets of similarity t share one of the first
   n - ceil(t n) + 1 of each (a prefix filter, exact), and a common passage stands behind the prefix. So comparisons of
   a cluster grow with its shingles, or with what its buckets of rare shingles hold, not with its square.
4. Components are made by star contraction (common.connected_components), and joined back to all documents.

What is known of a cluster or component reaches its rows by way of salted parts (common.with_group), so that one of a
third of all classes meets in no single task.

A bucket of more than BLOCK classes isn't compared as a whole: all of it becomes one provisional cluster, which step 3
examines exactly.

Edge cases: null and empty texts, and texts of blanks only, have an empty set and link with nothing; with fewer words
than a shingle has, the whole sequence is the only shingle; very long texts are read whole; repeated rows and ids are
answered alike, a row each; null ids lose to any other id (a component of null ids only has the null id); an empty table
gives an empty result; only doc_id and text are read. The chance that a pair right at the threshold shares no band is
(1 - t^ROWS)^BANDS, 7e-6 at t = 0.85 and 2e-4 at t = 0.8, and less the more similar it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skein.session import scratch

from .common import connected_components, map_texts, mix64, prepare, remove, saved, unused, with_group, with_told

HASHES, BANDS, ROWS, BATCH = 64, 16, 4, 16
MISS = 1e-6
BLOCK = 512
#: Pairs of signatures a shingle of a cluster from which on its probes meet its members by rare shingles: about as many as
#: are compared in the time that a shingle takes on its way through the prefix filter.
RARE = 128
#: A block holds about this many shingles at most, however long its texts are.
BLOCK_SHINGLES = 2_000_000
#: Blocks on either side whose signatures a task compares at once.
GROUP = 4
_A = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_P = np.uint64(0x9FB21C651E98DF25)
_MAX_WORDS = 400_000


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) >= _MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _WordHash()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word k-shingles. Words are runs of bytes other than space and \\x09-\\x0D, with
    A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    m = min(k, n)
    s = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        s *= _P
        s += h[j : n - m + 1 + j]
        s ^= s >> np.uint64(32)
    return np.unique(mix64(s))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for a in range(0, len(s), 4096):
        np.minimum(low, (s[a : a + 4096, None] * _A).min(0), out=low)
    return mix64(low)


def short(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint64(0xFFFF)).astype(np.uint16)


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix64(out * _P + sig.reshape(BANDS, ROWS)[:, j])
    return out.view(np.int64)


def bayes_cuts(threshold: float, miss: float = MISS) -> list[int]:
    """The least matches after each batch with P(similarity >= threshold | matches) >= miss under a uniform prior: the
    posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum."""
    cuts = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            tail = sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
            if tail >= miss:
                break
        cuts.append(m)
    return cuts


def _candidates(sigs: np.ndarray, i: int, others: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `others`, those not pruned against row i, and their matches."""
    seen = np.zeros(len(others), np.int64)
    for b, cut in enumerate(cuts):
        part = slice(b * BATCH, (b + 1) * BATCH)
        seen = seen + (sigs[others, part] == sigs[i, part]).sum(1)
        stay = seen >= cut
        if not stay.all():
            others, seen = others[stay], seen[stay]
        if not len(others):
            break
    return others, seen


def _forest(sigs: np.ndarray, cuts: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that aren't pruned."""
    n = len(sigs)
    label, edges = np.arange(n), []
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        near, _ = _candidates(sigs, i, others[label[others] != label[i]], cuts)
        for j in near:
            if label[j] != label[i]:
                edges.append((i, int(j)))
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return edges


def _verified(sets: list[np.ndarray], sigs: np.ndarray, label: np.ndarray, probe: np.ndarray | None, percent: int, cuts: list[int]) -> list[tuple[int, int]]:
    """Links between rows of different labels that join them, each verified on its full sets: percent * union <= 100 *
    shared. With probe, only pairs that hold one of those rows are looked at. label is changed in place."""
    n, edges = len(sets), []
    size = np.array([len(s) for s in sets])
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        keep = (label[others] != label[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))
        if probe is not None and not probe[i]:
            keep &= probe[others]
        near, seen = _candidates(sigs, i, others[keep], cuts)
        for j in near[np.argsort(-seen, kind="stable")]:
            if label[j] == label[i]:
                continue
            a, b = sets[i], sets[j]
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(b.searchsorted(a), len(b) - 1)
            shared = int((b[at] == a).sum())
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                edges.append((i, int(j)))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return edges


def _meetings(rows: list[tuple], percent: int, cuts: list[int]):
    """rows (component, bucket, part, node, size, label, probe, sig, blocks, c, q, side) of some probes (side) and some
    members of a cluster -> (pair of the cluster's blocks, row's place) for every pair of a probe and a member that isn't
    pruned, without those of equal labels; a pair of two probes is looked at once."""
    sigs = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, HASHES)
    size = np.array([r[4] for r in rows])
    _, label = np.unique(np.array([r[5].hex() for r in rows]), return_inverse=True)
    _, rank = np.unique(np.array([r[3].hex() for r in rows]), return_inverse=True)
    probe, side = np.array([r[6] for r in rows]), np.array([r[11] for r in rows])
    members, met = np.nonzero(~side)[0], set()
    for i in np.nonzero(side)[0]:
        o = size[members]
        keep = (label[members] != label[i]) & (100 * np.minimum(o, size[i]) >= percent * np.maximum(o, size[i]))
        keep &= ~probe[members] | (rank[members] > rank[i])
        for j in _candidates(sigs, i, members[keep], cuts)[0]:
            part = rows[i][10] * rows[i][8] + rows[j][9]
            met.add((part, int(i)))
            met.add((part, int(j)))
        if len(met) > 100_000:  # what is told again is dropped later
            yield from met
            met = set()
    yield from met


def _grouped(batches, keys: int):
    """Sorted Arrow batches -> lists of row dicts, one list for each run of equal first `keys` columns."""
    held, last = [], None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != last and held:
                yield held
                held = []
            last = row[:keys]
            held.append(row)
    if held:
        yield held


def _edge_batches(found):
    u, v = [], []
    for a, b in found:
        u.append(a)
        v.append(b)
        if len(u) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _classes(docs: DataFrame, k: int) -> DataFrame:
    def columns():
        def f(texts):
            n, node, sig, band = [], [], [], []
            for t in texts:
                s = shingles(t, k)
                n.append(len(s))
                if len(s):
                    full = signature(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(short(full).tobytes())
                    band.append(bands(full))
                else:
                    node.append(None)
                    sig.append(None)
                    band.append(None)
            return {
                "n_shingles": pa.array(n, pa.int64()),
                "node": pa.array(node, pa.binary()),
                "sig": pa.array(sig, pa.binary()),
                "bands": pa.array(band, pa.list_(pa.int64())),
            }

        return f

    return map_texts(docs, ["doc_id", "row"], columns, "n_shingles long, node binary, sig binary, bands array<long>")


def _rare(texts: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """component, node, probe, text -> node, bucket, members, probes: each of a node's prefix shingles that at least one
    probe and another node of its component have in their prefixes, and how many do. Shingles are ordered by how many
    nodes of the component have them, then by hash. What is counted of a shingle reaches its nodes by salted parts, since a
    common one may be that of all nodes."""

    def run(batches):
        for b in batches:
            sets = [shingles(t or "", k).view(np.int64) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["component", "node", "probe", "shingles"])

    sets = texts.select("component", "node", "probe", "text").mapInArrow(run, "component binary, node binary, probe boolean, shingles array<long>")
    each = saved(sets.select("component", "node", F.explode("shingles").alias("s")).select("node", F.xxhash64("component", "s").alias("bucket")), f"{folder}/sets")
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    told = with_told(each, shared, ["bucket"], "node").select("node", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "bucket").alias("s"))
    first = F.expr(f"slice(s, 1, size(s) - int(ceil(size(s) * {percent} / 100)) + 1)")
    prefix = told.groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("s")).select("node", F.explode(first).alias("s")).where("s.n > 1")
    prefix = saved(prefix.select("node", "s.bucket").distinct().join(texts.select("node", "probe"), "node"), f"{folder}/prefix")
    sizes = prefix.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.count_if("probe").alias("probes")).where("members > 1 and probes > 0")
    return with_told(prefix.select("node", "bucket"), sizes, ["bucket"], "node").where("members is not null")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept (doc_id = component_id), row per row, with links where
    100 * shared >= percent * union of the k-shingle sets."""
    named = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    named = saved(named, f"{scratch(docs.sparkSession, 'near-in')}/docs")  # a second scan may number rows otherwise
    return _components(named, k, percent, miss, block, rare).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component: of the smallest doc_id, and of
    rows repeated with that id, one. Rows without words stay, each."""
    spark = docs.sparkSession
    own = unused(docs, "__row")
    named = saved(docs.withColumn(own, F.monotonically_increasing_id()), f"{scratch(spark, 'near-in')}/docs")
    found = _components(named.select("doc_id", "text", F.col(own).alias("row")), k, percent, miss, block, rare)
    return named.join(found.where("stays").select(F.col("row").alias(own)), own, "left_semi").select(*docs.columns)


def _components(docs: DataFrame, k: int, percent: int, miss: float, block: int, rare: int) -> DataFrame:
    """doc_id, text, row (unique, stored with the data) -> doc_id, row, n_shingles, component_id, stays (one row of each component)."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "near")
    cuts = bayes_cuts(percent / 100, miss)

    rows = saved(_classes(docs, k), f"{folder}/rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    nodes = rows.where("node is not null").groupBy("node").agg(first, F.min("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = saved(nodes, f"{folder}/nodes")

    # buckets of two or more classes
    band = nodes.select("node", F.explode("bands").alias("bucket"))
    full = saved(band.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).where("size > 1"), f"{folder}/buckets")
    member = saved(band.join(full.hint("merge"), "bucket"), f"{folder}/members")  # plain shuffles: a hot bucket can be split
    met = member.where(F.col("size") <= block).select("bucket", "node")
    whole = member.where(F.col("size") > block).select(F.col("node").alias("u"), F.col("lead").alias("v"))  # one cluster
    shown = met.join(nodes.select("node", "sig"), "node").select("bucket", "node", "sig")

    def compare(batches):
        def found():
            for rows_ in _grouped(batches, 1):
                sigs = np.frombuffer(b"".join(r[2] for r in rows_), np.uint16).reshape(-1, HASHES)
                for i, j in _forest(sigs, cuts):
                    yield rows_[i][1], rows_[j][1]

        yield from _edge_batches(found())

    shown = shown.repartition("bucket").sortWithinPartitions("bucket")
    near = saved(shown.mapInArrow(compare, "u binary, v binary").union(whole), f"{folder}/near")
    clusters = saved(connected_components(near, f"{folder}/clusters"), f"{folder}/cluster")

    # texts of each cluster, in blocks
    known = clusters.join(nodes.select("node", "n", F.col("first.row").alias("row")), "node")
    placed = with_group(
        known, ["component"], "node",
        [F.count(F.lit(1)).alias("members"), F.sum("n").alias("load")],
        [F.sum("members").alias("members"), F.sum("load").alias("load")],
    ).withColumn("blocks", F.ceil(F.greatest(F.col("members") / block, F.col("load") / BLOCK_SHINGLES)).cast("int"))
    texts = saved(placed.join(docs.select("row", "text"), "row").select("component", "blocks", "node", "text", F.col("n").alias("size")), f"{folder}/texts")

    def verify(batches):
        def found():
            for rows_ in _grouped(batches, 2):
                sets = [shingles(r[3] or "", k) for r in rows_]
                sigs = np.stack([short(signature(s)) for s in sets])
                _, label = np.unique(np.array([r[4].hex() for r in rows_]), return_inverse=True)
                probe = np.array([r[5] for r in rows_])
                for i, j in _verified(sets, sigs, label.copy(), None if probe.all() else probe, percent, cuts):
                    yield rows_[i][2], rows_[j][2]

        yield from _edge_batches(found())

    def verified(dealt: DataFrame, name: str) -> DataFrame:
        """dealt: component, part, node, text, label, probe."""
        dealt = dealt.select("component", "part", "node", "text", "label", "probe").repartition("component", "part").sortWithinPartitions("component", "part")
        return saved(dealt.mapInArrow(verify, "u binary, v binary"), f"{folder}/{name}")

    def dealt_by(t: DataFrame, salt: str):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int").alias("part")

    def meet(batches):
        def cols(part):
            made = [pa.array([r[0] for _, r in part], pa.binary()), pa.array([p for p, _ in part], pa.int64())]
            made += [pa.array([r[k] for _, r in part], pa.binary()) for k in (3, 5)] + [pa.array([r[6] for _, r in part], pa.bool_())]
            return pa.RecordBatch.from_arrays(made, names=["component", "part", "node", "label", "probe"])

        for rows_ in _grouped(batches, 3):
            part = []
            for p, i in _meetings(rows_, percent, cuts):
                part.append((p, rows_[i]))
                if len(part) == 10_000:
                    yield cols(part)
                    part = []
            if part:
                yield cols(part)

    def met(told: DataFrame) -> DataFrame:
        """The classes that each pair of a block of probes and a block of the cluster has to verify. told: a row for each
        bucket of a class, 0 for the cluster as a whole; members and probes of a bucket are dealt to groups."""
        salt = lambda name, n: F.pmod(F.xxhash64("node", F.lit(name)), n)
        here = told.join(nodes.select("node", "sig"), "node").withColumn("c", salt("c", F.col("blocks")))
        here = here.withColumn("q", F.when(F.col("probe"), salt("q", F.col("probe_blocks"))))
        here = here.withColumn("own", F.when(F.col("bucket") == 0, F.floor(F.col("c") / GROUP)).otherwise(salt("own", F.col("groups"))))
        here = here.withColumn("out", F.when(F.col("bucket") == 0, F.floor(F.col("q") / GROUP)).otherwise(salt("out", F.col("probe_groups"))))
        every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        one = here.withColumn("at", every("probe_groups")).withColumn("part", F.col("at") * F.col("groups") + F.col("own")).withColumn("side", F.lit(False))
        two = here.where("probe").withColumn("at", every("groups")).withColumn("part", F.col("out") * F.col("groups") + F.col("at")).withColumn("side", F.lit(True))
        sides = [t.select("component", "bucket", F.col("part").cast("long"), "node", "size", "label", "probe", "sig", "blocks", "c", "q", "side") for t in (one, two)]
        dealt = sides[0].union(sides[1]).repartition("component", "bucket", "part").sortWithinPartitions("component", "bucket", "part")
        return dealt.mapInArrow(meet, "component binary, part long, node binary, label binary, probe boolean").distinct()

    edges = verified(texts.select("component", dealt_by(texts, "a"), "node", "text", F.col("node").alias("label"), F.lit(True).alias("probe")), "edges0")
    linked = saved(connected_components(edges, f"{folder}/linked0"), f"{folder}/labels0")
    for step in (1, 2):
        large = texts.where("blocks > 1")
        if large.isEmpty():
            break
        now = large.select("component", "blocks", "node", "size").join(linked.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = with_group(now, ["component", "label"], "node", [F.count(F.lit(1)).alias("n"), F.sum("size").alias("load")], [F.sum("n").alias("n"), F.sum("load").alias("load")])
        now = with_group(
            now, ["component"], "node",
            [F.max(F.struct("n", "label", "load")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("all")],
            [F.max("top").alias("top"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("members"), F.sum("all").alias("all")],
        )
        probes = F.greatest((F.col("members") - F.col("top.n")) / block, (F.col("all") - F.col("top.load")) / BLOCK_SHINGLES)
        dear = (F.col("members") - F.col("top.n")) * F.col("members") > rare * F.col("all")
        told = now.where("low <> high").select("blocks", "node", "size", "component", "label", (F.col("label") != F.col("top.label")).alias("probe"), F.ceil(probes).cast("int").alias("probe_blocks"), dear.alias("dear"))
        told = saved(told, f"{folder}/told{step}")
        if step == 1:
            work = large.join(told.select("node", "label", "probe"), "node")
            work = work.select("component", dealt_by(work, "b"), "node", "text", "label", F.lit(True).alias("probe"))
        else:
            at_once = lambda n: F.ceil(F.col(n) / (GROUP * block)).cast("long")
            groups = [F.ceil(F.col(n) / GROUP).cast("long").alias(g) for n, g in (("blocks", "groups"), ("probe_blocks", "probe_groups"))]
            meeting = told.where("not dear").withColumn("bucket", F.lit(0).cast("long")).select("*", *groups)
            many = told.where("dear")
            if not many.isEmpty():
                few = _rare(many.join(large.select("node", "text"), "node"), k, percent, folder)
                few = saved(few.select("node", "bucket", at_once("members").alias("groups"), at_once("probes").alias("probe_groups")), f"{folder}/rare")
                meeting = meeting.unionByName(many.join(few, "node"))
            work = met(meeting).join(large.select("node", "text"), "node")
        edges = edges.union(verified(work, f"edges{step}"))
        linked = saved(connected_components(edges, f"{folder}/linked{step}"), f"{folder}/labels{step}")

    named = nodes.select("node", "first").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = saved(named, f"{folder}/named")
    answer = with_group(named, ["component"], "node", [F.min("first").alias("best")], [F.min("best").alias("best")])
    answer = saved(answer.select("node", "best"), f"{folder}/answer")
    for name in "nodes buckets members sets prefix rare near clusters cluster texts edges0 linked0 labels0 told1 edges1 linked1 labels1 told2 edges2 linked2 labels2 named".split():
        remove(spark, f"{folder}/{name}")
    return with_told(rows.select("doc_id", "row", "n_shingles", "node"), answer, ["node"], "row").select(
        "doc_id",
        "row",
        "n_shingles",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("row") == F.col("best.row"))).alias("stays"),
    )
