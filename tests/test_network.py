"""Molecules by UMI networks against a walk over all pairs."""

import random
from collections import defaultdict

from skein.operators import network


def plain(records):
    counts = defaultdict(lambda: defaultdict(int))
    for cell, gene, umi in records:
        if None not in (cell, gene, umi):
            counts[gene, cell][umi] += 1
    out = set()
    for key, n in counts.items():
        parent = {u: u for u in n}

        def root(u):
            while parent[u] != u:
                u = parent[u]
            return u

        for a in n:
            for b in n:
                if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 and n[a] >= 2 * n[b] - 1:
                    parent[root(a)] = root(b)
        out.add((*key, len(n), len({root(u) for u in n})))
    return out


def test_against_all_pairs(spark):
    r = random.Random(9)
    records = []
    for _ in range(1500):
        umi = "".join(r.choice("ACGT") for _ in range(r.choice([4, 4, 4, 5])))
        times = r.choice([1, 1, 1, 2, 9])
        records += [(r.choice(["c1", "c2", None]), r.choice(["g1", "g2", "g3", None]), umi)] * times
    records += [("long", "g", "A" * i + "C" + "A" * (30 - i)) for i in range(31)] + [("long", "g", ""), ("long", "g", ""), ("long", "g", None)]
    chain = ["AAAAAAAA", "CAAAAAAA", "CCAAAAAA", "CCCAAAAA", "CCCCAAAA", "CCCCCAAA", "CCCCCCAA", "CCCCCCCA", "CCCCCCCC"]
    records += [("chain", "g", u) for u in chain]
    df = spark.createDataFrame(records, "cell string, gene string, umi string")
    got = set(map(tuple, network.network_counts(df).select("gene", "cell", "umis", "count").collect()))
    assert got == plain(records) and ("g", "chain", 9, 1) in got
    assert network.network_counts(df.limit(0)).collect() == []
