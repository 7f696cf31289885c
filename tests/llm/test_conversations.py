"""Conversation repair against an exhaustive search, the trie against single signatures, and the edge cases."""

import hashlib
import itertools
import random
import zlib

import pyarrow as pa
import pytest

from skein.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
NOTHING = hashlib.sha256().hexdigest()


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """rows (role, text, fault) -> (cost, audit, digest), by trying all edits with up to two inserted turns at a place."""
    best = None
    choices = []
    for role, text, fault in rows:
        ways = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            ways += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        choices.append(ways)
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for ways in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, left = 0, "", []
            for k in range(len(rows) + 1):
                for role in inserted[k]:
                    cost, audit, left = cost + 2, audit + "I", left + [(role, "")]
                if k < len(rows):
                    edit, price, row = ways[k]
                    cost, audit = cost + price, audit + edit
                    left += [row] if row else []
            if legal("".join(r[0][:1] or "-" for r in left)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(C.BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows, search=True):
    """(role, text) in order -> the answer of a conversation but for its gaps."""
    f = faults(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    counts = [f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs)]
    return counts, cheapest([(r, t, x) for (r, t), x in zip(rows, f)]) if search else None


def signature(rows):
    kinds = {"": C._CLEAN, "truncated": C._CUT, "blank": C._BLANK, "duplicate": C._COPY}
    return "".join(C.letter(r[:1], kinds[x]) for (r, _), x in zip(rows, faults(rows)))


def made(r, n):
    return [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["x.", "y", "z!", " \n", "x.", "w?"])) for _ in range(n)]


def test_edits_are_the_cheapest_and_least():
    r = random.Random(5)
    every = [made(r, r.randrange(4)) for _ in range(120)]
    every += [[("user", "a."), ("user", "b."), ("user", "c.")], [("assistant", "a"), ("user", "b.")], [("system", "s."), ("system", "t.")]]
    branch = C.Branch()
    for rows in sorted(every, key=signature):
        counts, (cost, audit, digest) = plain(rows)
        branch.go(signature(rows))
        assert branch.answer() == (cost, audit, *counts), rows
        work = C.Repair(audit)
        for role, text in rows:
            work.turn(role, text)
        assert work.end() == digest, rows


def test_shared_prefixes_are_computed_once():
    r = random.Random(6)
    signs = sorted({signature(made(r, r.randrange(30))) for _ in range(300)})
    trie = {s[:n] for s in signs for n in range(1, len(s) + 1)}
    (got,) = C._answers(iter([pa.RecordBatch.from_arrays([pa.array(signs)], names=["signature"])]))
    branch = C.Branch()
    for s, row in zip(signs, got.to_pylist()):
        branch.go(s)
        alone = C.Branch()
        alone.go(s)
        assert alone.answer() == branch.answer() == tuple(row[c] for c in ("cost", "audit", "blank", "duplicate", "truncated", "illegal"))
    assert branch.layers == len(trie)


def test_long_conversation():
    branch = C.Branch()
    branch.go("BC" * 50_000)  # user, assistant
    assert branch.answer()[:2] == (0, "K" * 100_000)
    branch.go("BC" * 50_000 + "B")
    assert branch.answer()[:2] == (2, "K" * 100_001 + "I")


def test_damage(spark):
    rows = [(i, t, "assistant", "Yes. No!\n") for i in range(30) for t in range(4)] + [(None, None, None, None)] * 2
    got = {}
    for x in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((x.conv_id, x.turn), []).append((x.role, x.text))
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" ", " ") if role is None else (role, text)
        want = {0: [], 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((conv, turn), []) == want * (2 if conv is None else 1)


def test_frames_with_edges(spark):
    r = random.Random(8)
    rows = []
    for conv in [None, 0, 1, -5, 2**62]:
        rows += [(conv, r.choice([None, 0, 0, 1, 2, 7]), *x) for x in made(r, 4)]
    rows += [(7, t, "user", "same.") for t in [None, 5, 5, -(2**63), 2**63 - 1]]
    rows += [(8, 0, None, None), (9, 0, "user", "q " * 100_000 + "."), (9, 1, "assistant", "a" * 500_000)]
    rows += [(10, t, "user", "again") for t in range(400)]
    frame = spark.createDataFrame([(*x, "t", 1) for x in rows], SCHEMA + ", TEXT_ string, key int").withColumnRenamed("TEXT_", "digest")
    got = {x.conv_id: x for x in C.repair(frame, damage=False).collect()}
    assert len(got) == len({x[0] for x in rows})
    for conv, answer in got.items():
        mine = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
        counts, best = plain([x[1:] for x in mine], search=len(mine) < 6)
        assert [answer.gaps, answer.blank, answer.duplicate, answer.truncated, answer.illegal] == [gaps, *counts], conv
        if best:
            assert (answer.cost, answer.audit, answer.repaired_sha256) == best, conv
    assert got[10].audit == "D" * 400 and got[10].cost == 3 * 400  # as cheap as KI and 399 D, and less in ASCII order
    assert C.repair(frame.limit(0)).collect() == []


def test_everything_dropped(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (x,) = C.repair(spark.createDataFrame([(lost, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(x) == (lost, 0, 0, 0, 0, 0, 0, "", NOTHING)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    import duckdb

    from skein.llm import queries

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '/root/testdata/{sf}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op12_conversation_repair"])
    got = queries.queries()["op12_conversation_repair"](spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
