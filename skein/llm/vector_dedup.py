"""Embedding near-duplicates with one navigable small-world graph per shard.

Equal vectors form a class (one aggregation); classes are dealt to shards by hash. Each shard's task builds a hierarchical
navigable small-world graph, which is stored once in the shared folder. Every class then queries every shard by beam
search for all vectors with cosine >= the threshold. A task of the search holds one shard's graph and lets its queries
stream past in blocks of BLOCK. Where a beam's worst member still passes the threshold, the beam may not hold all that do,
and exact blocked products of the query with the shard tell them: they cost less than a beam of hundreds. A block's beams
are widened together until an audit passes: exact products show which of SAMPLE queries of the block and
SAMPLE of the shard's own vectors have true neighbours other than themselves; of these pairs AUDIT_RECALL or more must be
found, and, since a block may hold few pairs or none, TURNED_RECALL of AUDIT of the shard's vectors when asked for by copies
that are turned away from them to just above the threshold. Where beams would cover a good part
of the shard (1 / WIDE of it) or be wider than WIDEST, exact products answer instead: the way for whatever no audit passes. Found pairs
are verified by cosine in double precision. A task tells how many vectors each query links with, and a spanning forest
of its links, never the pairs; the forest's components are the answer's. Each block's recall (of true pairs; of turned
vectors where it held none) and beam are told, too; the least recall and the number of true pairs are in the result.

A shard holds at most about SHARD_BYTES of numbers, so that one fits a task's memory whatever the vectors' width. Each
query is sent to each shard, and each graph to TASKS / shards tasks (one where there are that many shards). Shards, and
their chunks of queries, are dealt to tasks by number: hashes of so few keys would leave some tasks two or three of them.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths never link; equal vectors are linked with each other (repeated rows count as
links, too); rows of one vec_id keep a row each and answer by their own vector; a null vec_id loses to any other id; an
empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.session import scratch

from .common import connected_components, mix64, prepare, remove, saved, with_group, with_told

SHARDS = 4
SHARD_BYTES = 128 << 20
#: Fewer vectors make one shard, whose graph a beam doesn't cover.
SHARD_LEAST = 4096
TASKS = 24
M, EF_BUILD, EF = 12, 40, 40
AUDIT, AUDIT_RECALL = 24, 0.995
#: Vectors of a block, and of a shard, among which an audit looks for true pairs; the share of turned vectors to be found.
SAMPLE, TURNED_RECALL = 256, 0.95
BATCH = 128
#: Vectors of a shard that a product takes at once; layers of so many vectors are compared whole.
TILE, ENTRY = 8192, 2048
#: Numbers of the vectors whose cosines are made at once, so that they stay in a core's cache.
NEAR = 65536
#: Members of a beam whose neighbours are looked at in one step.
AHEAD = 8
BLOCK = 2048
#: Beams of 1 / WIDE of a shard or wider than WIDEST cost more than exact products.
WIDE, WIDEST = 8, 320


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors in step."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD):
        self.x, self.m = np.ascontiguousarray(x, dtype=np.float32), m
        n = len(x)
        u = (mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int), 6) if n else np.zeros(0, int)
        self.top = int(self.level.max()) if n else 0
        self.near = [np.full((n, 2 * m if lv == 0 else m), -1, np.int32) for lv in range(self.top + 1)]
        # the highest first: upper layers stand before the mass of vectors enters
        order = np.argsort(-self.level, kind="stable")
        self.order, self.marks, self.memo = order, None, {}
        self.many = [int((self.level >= lv).sum()) for lv in range(self.top + 1)]
        done = 0
        while done < n:
            step = order[done : done + max(1, min(BATCH, max(done, 16)))]
            self._insert(step, done, ef)
            done += len(step)
        self.marks = None

    def _descent(self, q: np.ndarray, done: int) -> tuple[int, np.ndarray]:
        """The highest layer that holds over ENTRY of the first `done` vectors, or the lowest, and where to enter it: the best
        of the layer above, all of which are compared, or its first vectors."""
        lv = max([lv for lv, many in enumerate(self.many) if min(done, many) > ENTRY], default=0)
        if lv == self.top:
            return lv, np.broadcast_to(self.order[: min(8, done)], (len(q), min(8, done)))
        above = self.order[: min(done, self.many[lv + 1])]
        if len(above) <= 8:
            return lv, np.broadcast_to(above, (len(q), len(above)))
        return lv, above[np.argpartition(q @ self.x[above].T, len(above) - 8, axis=1)[:, -8:]]

    def _insert(self, new: np.ndarray, done: int, ef: int) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        first, start = self._descent(q, done) if done else (0, None)
        for lv in range(self.top, -1, -1):
            here = np.nonzero(self.level[new] >= lv)[0]
            if not len(here) and lv > first:
                continue
            if done and min(done, self.many[lv]):
                if lv > first:  # all of a small layer are compared
                    present = self.order[: min(done, self.many[lv])]
                    k = min(ef, len(present))
                    sims = q @ self.x[present].T
                    pick = np.argpartition(sims, len(present) - k, axis=1)[:, -k:]
                    ids, sims = present[pick], np.take_along_axis(sims, pick, 1)
                else:
                    ids, sims = self.beam(q, start, ef if len(here) else 8, lv)
                    start = ids[:, :16]
                    start = np.where(start < 0, self.order[0], start)
            else:
                ids, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            if len(here):
                # the others of this step that stand on this layer are candidates too
                side = np.where(self.level[new][None, :] >= lv, among[here], -np.inf)
                k = min(self.m, len(new))
                pick = np.argpartition(-side, k - 1, axis=1)[:, :k]
                c = np.hstack([ids[here], new[pick]])
                s = np.hstack([sims[here], np.take_along_axis(side, pick, 1)])
                c = np.where(np.isneginf(s), -1, c)
                self._link(new[here], c, s, lv)

    def _choose(self, c: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours of each row's candidates: one is kept if it is nearer to the row than to any kept one; the
        places left are filled with the nearest of the others."""
        order = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        v = self.x[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        ok = c >= 0
        kept = np.zeros(c.shape, bool)
        for i in range(c.shape[1]):
            clash = (kept & (between[:, i, :] > s[:, i, None])).any(1)
            kept[:, i] = ok[:, i] & ~clash & (kept.sum(1) < most)
        rank = np.argsort(~kept * 2 + ~ok, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(c, rank, 1)
        return np.where(np.take_along_axis(ok, rank, 1), out, -1)

    def _link(self, rows: np.ndarray, c: np.ndarray, s: np.ndarray, lv: int) -> None:
        near = self.near[lv]
        width = near.shape[1]
        chosen = self._choose(c, s, self.m)
        near[rows, : chosen.shape[1]] = chosen
        a = np.repeat(rows, chosen.shape[1])
        b = chosen.ravel()
        keep = b >= 0
        a, b = a[keep], b[keep]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, first, count = np.unique(b, return_index=True, return_counts=True)
        if not len(targets):
            return
        most = int(count.max())
        add = np.full((len(targets), most), -1, np.int64)
        add[np.repeat(np.arange(len(targets)), count), np.arange(len(b)) - np.repeat(first, count)] = a
        c = np.hstack([near[targets].astype(np.int64), add])
        # twice the same neighbour (linked from both sides in one step) counts once
        c.sort(axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c = -np.sort(-c, axis=1)  # empty places last
        count = (c >= 0).sum(1)
        order = np.argsort(count, kind="stable")  # those of few candidates aren't as wide as a hub
        for at in range(0, len(targets), 256):
            rows = order[at : at + 256]
            t, cc, full = targets[rows], c[rows, : count[rows[-1]]], count[rows] > width
            s = np.einsum("ad,akd->ak", self.x[t], self.x[np.maximum(cc, 0)], optimize=True)
            s[cc < 0] = -np.inf
            out = np.full((len(t), width), -1, np.int64)
            if (~full).any():
                r = np.argsort(-s[~full], axis=1, kind="stable")[:, :width]
                got = np.take_along_axis(cc[~full], r, 1)
                out[np.nonzero(~full)[0][:, None], np.arange(got.shape[1])[None, :]] = got
            if full.any():
                got = self._choose(cc[full], s[full], width)
                out[np.nonzero(full)[0][:, None], np.arange(got.shape[1])[None, :]] = got
            near[t] = out

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best vectors found for each query on a layer, best first (-1: none), and their cosines."""
        x, near, n, ef, step = self.x, self.near[lv], len(self.x), max(ef, 1), max(64, NEAR // self.x.shape[1])
        if self.marks is None or len(self.marks) < len(q):
            kind = np.uint8 if 2 * AHEAD * self.m < 255 else np.uint16
            self.marks = np.zeros((max(len(q), BATCH), n + 1), kind)  # of vectors that a query has met; the last isn't one
            self.marks[:, n] = 255
        marks, touched = self.marks.reshape(-1), []
        base = np.arange(len(q))[:, None] * (n + 1)

        def fresh(live, c):
            """Which of the candidates of each query it hasn't met; of equal ones one."""
            at = base[live] + np.where(c < 0, n, c)
            stamp = np.broadcast_to(np.arange(1, c.shape[1] + 1, dtype=marks.dtype), c.shape)
            unmet = marks[at] == 0
            marks[at[unmet]] = stamp[unmet]
            unmet &= marks[at] == stamp
            touched.append(at[unmet])
            return unmet

        def cosines(live, c, unmet):
            r, k = np.nonzero(unmet)
            ids, asks, s = c[r, k].astype(np.int64), live[r], np.empty(len(r), np.float32)
            for a in range(0, len(r), step):
                s[a : a + step] = np.einsum("ad,ad->a", x.take(ids[a : a + step], 0), q.take(asks[a : a + step], 0))
            return r, ids, s

        ids, sims = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
        open_ = np.zeros((len(q), ef), bool)
        live, c = np.arange(len(q)), start
        while True:
            r, new, s = cosines(live, c, fresh(live, c))
            better = s > sims[live].min(1)[r]
            r, new, s = r[better], new[better], s[better]
            if len(r):  # candidates better than a beam's worst enter it
                count = np.bincount(r, minlength=len(live))
                k = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                met = np.nonzero(count)[0]
                place = np.cumsum(count > 0)[r] - 1
                rows, wide = live[met], ef + int(count.max())
                i, v, o = np.full((len(met), wide), -1, np.int64), np.full((len(met), wide), -np.inf, np.float32), np.zeros((len(met), wide), bool)
                i[:, :ef], v[:, :ef], o[:, :ef] = ids[rows], sims[rows], open_[rows]
                i[place, ef + k], v[place, ef + k], o[place, ef + k] = new, s, True
                best = np.argpartition(-v, ef - 1, axis=1)[:, :ef]
                ids[rows], sims[rows], open_[rows] = np.take_along_axis(i, best, 1), np.take_along_axis(v, best, 1), np.take_along_axis(o, best, 1)
            live = np.nonzero(open_.any(1))[0]
            if not len(live):
                break
            w = min(AHEAD, ef)
            o = open_[live]
            pick = np.argpartition(np.where(o, -sims[live], np.inf), w - 1, axis=1)[:, :w]
            chosen = np.take_along_axis(o, pick, 1)
            at = np.take_along_axis(ids[live], pick, 1)
            np.put_along_axis(o, pick, False, 1)
            open_[live] = o
            c = near[np.where(chosen, at, 0)]
            c[~chosen] = -1
            c = c.reshape(len(live), -1)
        for at in touched:
            marks[at] = 0
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        first, start = self._descent(q, len(self.x))
        for lv in range(first, 0, -1):
            ids, _ = self.beam(q, start, 8, lv)
            start = np.where(ids < 0, self.order[0], ids)
        return self.beam(q, start, ef, 0)

    def exact(self, q: np.ndarray, floor: float) -> list[np.ndarray]:
        """For each query the vectors with cosine >= floor, by blocked products."""
        out = []
        for a in range(0, len(q), BATCH):
            block = q[a : a + BATCH]
            parts = [[np.zeros(0, np.int32)] for _ in block]
            for b in range(0, len(self.x), TILE):
                r, c = np.nonzero(block @ self.x[b : b + TILE].T >= floor)
                if len(r):
                    for p, hits in zip(parts, np.split((c + b).astype(np.int32), r.searchsorted(np.arange(1, len(block))))):
                        if len(hits):
                            p.append(hits)
            out += [np.concatenate(p) for p in parts]
        return out

    def within(self, q: np.ndarray, floor: float, ef: int = EF) -> list[np.ndarray]:
        """For each query the vectors found with cosine >= floor. Where the worst member of a beam passes, too, there may be
        more than it holds: products tell, which cost no more than a beam of some hundreds. They also answer where a beam
        would be as wide as 1 / WIDE of the vectors."""
        if ef * WIDE >= len(self.x):
            return self.exact(q, floor)
        out: list[np.ndarray] = []
        for a in range(0, len(q), BATCH):
            ids, sims = self.search(q[a : a + BATCH], ef)
            out += [i[(i >= 0) & (s >= floor)] for i, s in zip(ids, sims)]
            full = np.nonzero(sims[:, -1] >= floor)[0]
            for r, found in zip(full, self.exact(q[a + full], floor)):
                out[a + r] = found
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that no square overflows or vanishes."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _unit_single(v: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, np.float32)
    for a in range(0, len(v), 4096):
        out[a : a + 4096] = _unit(v[a : a + 4096])
    return out


def _turned(v: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors turned any way by as much as leaves this cosine."""
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(1, keepdims=True) * v
    length = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 0)  # of one component: as they are
    return (cosine * v + np.sqrt(1 - cosine**2) * side).astype(np.float32)


def audited(g: Graph, q: np.ndarray, floor: float, place: np.ndarray | None = None, seed: int = 0) -> tuple[list[np.ndarray], float, int, int]:
    """within() with beams widened until the audit passes, that audit's recall, the beam (0: exact products), and the true
    pairs that it held. place tells where in the graph a query itself stands (-1: it doesn't); nobody is a hit of itself."""
    rng = np.random.default_rng(seed)
    place = np.full(len(q), -1) if place is None else place
    if (floor, seed) not in g.memo:  # what a shard's own vectors have is the same for all blocks
        own = np.random.default_rng([seed, 1])
        theirs = own.choice(len(g.x), min(SAMPLE, len(g.x)), replace=False)
        g.memo[floor, seed] = theirs, g.exact(g.x[theirs], floor), _turned(g.x[theirs[:AUDIT]], (9 * floor + 1) / 10, own)
    theirs, known, turned = g.memo[floor, seed]
    mine = rng.choice(len(q), min(SAMPLE, len(q)), replace=False)
    probes, own = np.vstack([q[mine], g.x[theirs]]), np.concatenate([place[mine], theirs])
    truth = g.exact(q[mine], floor) + known
    truth = [t[t != i] for t, i in zip(truth, own)]
    linked = np.array([i for i, t in enumerate(truth) if len(t)][: 4 * AUDIT], int)
    pairs, ef = sum(len(truth[i]) for i in linked), EF
    told = [truth[i] for i in linked]

    def share(found, true) -> float:
        """Of the true neighbours of probes, those found."""
        return sum(len(np.intersect1d(t, f)) for t, f in zip(true, found)) / max(1, sum(map(len, true)))

    while ef * WIDE < len(g.x) and ef <= WIDEST:
        recall = share(g.within(probes[linked], floor, ef), told) if pairs else 1.0
        if recall >= AUDIT_RECALL:
            seen = share(g.within(turned, floor, ef), [np.array([i]) for i in theirs[:AUDIT]])
            if seen >= TURNED_RECALL:
                return g.within(q, floor, ef), recall if pairs else seen, ef, pairs
        ef *= 2
    return g.exact(q, floor), 1.0, 0, pairs


class _Forest:
    """Trees of a shard's vectors, by where these stand; what isn't in the shard joins them, but is met only once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.parent[at]
        while ((up := self.parent[top]) != top).any():
            top = up
        self.parent[at] = top
        return top

    def joins(self, at: np.ndarray, place: int) -> np.ndarray:
        """Of the links of a vector (at place; -1: not in the shard) with those at `at`, the ones that join."""
        tops, first = np.unique(self.roots(at), return_index=True)
        if place >= 0:
            mine = self.roots(np.array([place]))
            first = first[tops != mine]
            tops = np.union1d(tops, mine)
        self.parent[tops] = tops[0]
        return at[first]


_FOUND = "node long, links long, u long, v long, recall double, ef int, pairs long"


def _links(graph: Graph, raw: np.ndarray, node: np.ndarray, copies: np.ndarray, own: np.ndarray, asked: np.ndarray, forest: _Forest, threshold: float) -> pa.RecordBatch:
    """A block of queries against a shard: each query's links, the links that join, and the audit."""
    x = _unit(asked)
    at = np.minimum(node.searchsorted(own), len(node) - 1)  # a shard's nodes are in order
    place = np.where(node[at] == own, at, -1)
    found, recall, ef, pairs = audited(graph, x.astype(np.float32), threshold - 1e-5, place)
    links, u, w = np.zeros(len(own), np.int64), [], []
    for i, f in enumerate(found):
        f = f[f != place[i]]
        if not len(f):
            continue
        f = f[_unit(raw[f]) @ x[i] >= threshold]
        links[i] = copies[f].sum()
        if len(f):
            f = forest.joins(f, place[i])
            u += [int(own[i])] * len(f)
            w += node[f].tolist()
    n, m = len(own), len(u)
    gap = lambda k: [None] * k
    cols = [own.tolist() + gap(m + 1), links.tolist() + gap(m + 1), gap(n) + u + [None], gap(n) + w + [None]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in cols] + [pa.array(gap(n + m) + [recall], pa.float64()), pa.array(gap(n + m) + [ef], pa.int32()), pa.array(gap(n + m) + [pairs], pa.int64())],
        names=["node", "links", "u", "v", "recall", "ef", "pairs"],
    )


def _build(batches):
    """Sorted rows (shard, width, node, copies, embedding) -> a graph a shard and width."""
    key, parts = None, []

    def built():
        node, copies, raw = (np.concatenate(p) for p in zip(*parts))
        parts.clear()
        graph = Graph(_unit_single(raw))
        graph.x = None  # made again from the vectors, which go along as they came
        held = pickle.dumps((graph, raw, node, copies), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held], pa.binary())], names=["shard", "width", "graph"])

    for b in batches:
        shard, width = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.nonzero((np.diff(shard) != 0) | (np.diff(width) != 0))[0] + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if i == j:
                continue
            now = (int(shard[i]), int(width[i]))
            if parts and now != key:
                yield built()
            key, c = now, b.slice(i, j - i)
            raw = c.column(4).flatten().to_numpy(zero_copy_only=False).reshape(j - i, now[1])
            parts.append((c.column(2).to_numpy(zero_copy_only=False), c.column(3).to_numpy(zero_copy_only=False), raw))
    if parts:
        yield built()


def _search(threshold: float):
    """Sorted rows (shard, width, chunk, kind, graph, node, embedding): a graph (kind 0), then its queries."""

    def run(batches):
        held, own, asked, forest = None, [], [], None

        def ask():
            out = _links(*held, np.array(own, np.int64), np.vstack(asked), forest, threshold) if own and held else None
            own.clear()
            asked.clear()
            return out

        for b in batches:
            graphs, kinds = b.column(4), b.column(3).to_pylist()
            nodes, vectors = b.column(5).to_pylist(), b.column(6)
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if (out := ask()) is not None:
                        yield out
                    graph, raw, node, copies = pickle.loads(graphs[i].as_buffer())
                    graph.x = _unit_single(raw)
                    held, forest = (graph, raw, node, copies), _Forest(len(node))
                    continue
                own.append(nodes[i])
                asked.append(vectors[i].values.to_numpy(zero_copy_only=False))
                if len(own) == BLOCK and (out := ask()) is not None:
                    yield out
        if (out := ask()) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, shards: int | None = None) -> DataFrame:
    """vec_id, embedding -> vec_id, n_links, component_id, kept, audited_recall (the least of all audits) and audited_pairs (true
    pairs that they held); a row per row."""
    spark = vectors.sparkSession
    prepare(spark)
    folder = scratch(spark, "vectors")
    fine = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")).alias("first")
    nodes = rows.where(fine).groupBy("embedding").agg(first, F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = saved(nodes, f"{folder}/nodes")
    numbers, many = nodes.agg(F.sum(F.size("embedding").cast("long") + 8 * M), F.count(F.lit(1))).first()
    s = shards or max(SHARDS if many >= SHARD_LEAST else 1, -(-4 * (numbers or 0) // SHARD_BYTES))  # of four bytes; a vector's neighbours count too
    chunks = max(1, -(-TASKS // s))
    placed = nodes.select("node", "copies", "embedding", F.size("embedding").alias("width"), F.pmod(F.xxhash64("node"), F.lit(s)).cast("int").alias("shard"))

    # a shard a task, and a task of the search a shard's chunk: by number, since so few keys' hashes would share tasks
    dealt = placed.select("shard", "width", "node", "copies", "embedding").repartitionById(s, "shard").sortWithinPartitions("width", "node")
    graphs = saved(dealt.mapInArrow(_build, "shard int, width int, graph binary"), f"{folder}/graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    sides = graphs.select("shard", "width", every(chunks).alias("chunk"), F.lit(0).alias("kind"), "graph", none("long").alias("node"), none(kind).alias("embedding"))
    asked = placed.select("node", "embedding", "width", F.pmod(F.xxhash64("node", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk"))
    asked = asked.select(every(s).alias("shard"), "width", "chunk", F.lit(1).alias("kind"), none("binary").alias("graph"), "node", "embedding")
    met = sides.union(asked.join(F.broadcast(graphs.select("shard", "width").distinct()), ["shard", "width"], "left_semi").select(*sides.columns))  # as few as shards
    met = met.repartitionById(s * chunks, F.col("shard") * chunks + F.col("chunk")).sortWithinPartitions("shard", "width", "chunk", "kind")
    found = saved(met.mapInArrow(_search(threshold), _FOUND), f"{folder}/found")
    least, pairs = found.agg(F.min("recall"), F.sum("pairs")).first()
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("u is not null").select("u", "v"), f"{folder}/cc")
    named = saved(nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), f"{folder}/named")
    best = with_group(named, ["component"], "node", [F.min("first").alias("best")], [F.min("best").alias("best")]).select("node", "best")
    answer = nodes.select("node", "embedding", "copies").join(best, "node").join(links, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("best.vec_id").alias("best"))
    answer = saved(answer, f"{folder}/answer")
    for name in ("nodes", "graphs", "found", "cc", "named"):
        remove(spark, f"{folder}/{name}")
    known = with_told(rows, answer, ["embedding"], "vec_id")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("best"))
    return known.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
        F.lit(least).cast("double").alias("audited_recall"), F.lit(pairs or 0).cast("long").alias("audited_pairs"),
    )
