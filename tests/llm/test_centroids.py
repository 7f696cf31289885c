"""Exponion clustering against plain rounds over all pairs, with ties, copies and edges."""

import hashlib

import numpy as np
import pytest

from skein.llm import centroids as X


def plain(vectors, k, rounds, seed="1:"):
    """[(id, list of whole numbers)] -> (id, cluster, distance) and the centroids."""
    by = sorted(vectors, key=lambda x: (hashlib.sha256(f"{seed}{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    c = [list(v) for _, v in by[:k]]
    told = []
    for i in range(rounds + 1):
        told = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in vectors]
        if i < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, n) in zip(vectors, told) if n == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(name, n, d) for (name, _), (d, n) in zip(vectors, told)], c


@pytest.mark.parametrize("spread", [1, 3, 60])
def test_rounds_with_ties(spread):
    r = np.random.default_rng(spread)
    v = r.integers(-spread, spread + 1, (3000, 5))
    k, now, before, scanned = 40, v[:40].copy(), None, 0
    now[7] = now[3]  # equal centroids
    for i in range(6):
        search = X.Exponion(now, before)
        a, u, low, done = search.first(v) if i == 0 else search.again(v, a, u, low)
        d = ((v[:, None] - now[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(len(v)), a])
        d = d.astype(float)
        d[np.arange(len(v)), a] = np.inf
        assert (u * (1 + 1e-8) >= own).all() and (low <= np.sqrt(d.min(1)) * (1 + 1e-8)).all()
        scanned += done.sum()
        before, now = now, np.array([v[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else now[j] for j in range(k)])
    assert scanned <= 6 * len(v) * (k + 1)  # never more than all, and the one that makes a bound exact


def test_balls_are_small_where_clusters_are_apart():
    r = np.random.default_rng(0)
    places = r.integers(-2000, 2000, (50, 2))
    v = (places[:, None] + r.integers(-20, 21, (50, 100, 2))).reshape(-1, 2)
    now = places + r.integers(-15, 16, places.shape)
    a, u, low, _ = X.Exponion(now).first(v)
    moved = places + r.integers(-15, 16, places.shape)
    a, u, low, done = X.Exponion(moved, now).again(v, a, u, low)
    assert (a == ((v[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all() and done.mean() < 5


def test_cluster_against_plain_rounds(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 64)]) for i in range(80)]
    rows += [(i, rows[3][1]) for i in range(80, 110)] + [rows[5], rows[5], (None, rows[9][1])]
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    odd = [(200, None), (201, []), (202, rows[0][1][:63]), (203, [None] + rows[0][1][1:]), (204, [float("nan")] + rows[0][1][1:])]
    odd += [(205, [float("-inf")] + rows[0][1][1:]), (206, [1e30] + rows[0][1][1:]), (207, rows[0][1] + [0.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, V string")
    for k in (16, 3):
        got = X.cluster(frame, k=k).collect()
        want, c = plain(usable, k, 3)
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted([(x.vec_id, x.cluster, x.distance) for x in got], key=key) == sorted(want, key=key)
        sums = [sum(d for _, n, d in want if n == j) for j in range(k)]
        for x in got:
            assert (x.cluster_inertia, x.inertia) == (sums[x.cluster], sum(sums))
            assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, c[x.cluster])).encode()).hexdigest()


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert X.cluster(spark.createDataFrame([], kind)).collect() == []
    (x,) = X.cluster(spark.createDataFrame([(1, [0.5] * 64, 0)], kind)).collect()
    assert (x.cluster, x.distance, x.cluster_inertia, x.inertia) == (0, 0, 0, 0)
    big = [(i, [float((-1) ** i) * 2e6] * 64, 0) for i in range(3)]
    got = X.cluster(spark.createDataFrame(big, kind), k=1, rounds=1).collect()
    assert all(x.inertia >= x.distance for x in got)


def test_query_against_sql(spark):
    import duckdb

    from skein.llm import queries

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_centroids"])
    got = queries.queries()["op13_centroids"](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
