"""BAM files read by ranges of bytes: whatever the cuts, the rows are those of one task."""

import random

import pytest

from skein.sources import bam, parts


def made(r, n):
    """Records of very different lengths, some of many blocks."""
    out = []
    for i in range(n):
        seq = "".join(r.choices("ACGTN", k=r.choice([0, 1, 30, 90, 90, 90, 700])))
        quality = bytes(r.randrange(60) for _ in seq) if r.random() < 0.5 else None
        out.append((f"read{i}", r.randrange(3), seq, quality, {"CB": "ACGT" * r.randrange(5), "XT": r.choice([None, "G1"])}))
    return out


def read(path, size):
    rows = []
    reader = bam._Reader(str(path), size)
    for p in reader.partitions():
        for b in reader.read(p):
            rows += map(tuple, zip(*b.to_pydict().values()))
    return rows


@pytest.mark.parametrize("block,guess", [(200, 500), (3000, 4000), (65280, 1 << 18)])
def test_any_cut(tmp_path, monkeypatch, block, guess):
    monkeypatch.setattr(bam, "BLOCK", block)
    monkeypatch.setattr(bam, "GUESS", guess)
    r = random.Random(block)
    rows = made(r, 400)
    body = bam.blocks(b"".join(bam.record(*x) for x in rows))
    (tmp_path / "a.bam").write_bytes(bam.header(["G1", "G2", "G3"], "c", "1") + body + bam.block(b""))
    whole = read(tmp_path / "a.bam", 1 << 30)
    assert [w[0] for w in whole] == [x[0] for x in rows] and [w[6] for w in whole] == [x[2] for x in rows]
    size = (tmp_path / "a.bam").stat().st_size
    for cut in (7, 100, 311, 5000, size // 8 + 1):
        if size // cut < 1500:
            assert read(tmp_path / "a.bam", cut) == whole, cut
    # a folder's parts are cut, too
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / parts.HEADER).write_bytes(bam.header(["G1", "G2", "G3"], "c", "1"))
    (tmp_path / "f" / "part-00000000").write_bytes(body)
    assert read(tmp_path / "f", size // 5) == whole


def test_marks_inside_blocks(tmp_path, monkeypatch):
    """What looks like a block's head within compressed bytes is none."""
    monkeypatch.setattr(bam, "GUESS", 300)
    fake = bam.block(b"x")[:18].decode("latin-1")
    rows = [(f"r{i}", 0, "ACGT", None, {"CB": "A"}) for i in range(50)]
    stored = bam.zlib.compressobj
    monkeypatch.setattr(bam.zlib, "compressobj", lambda *a: stored(0, *a[1:]))  # as they are
    data = b"".join(bam.record(*x) for x in rows[:25]) + bam.record("m", 0, "", None, {"XT": fake.replace("\0", "")}) + b"".join(bam.record(*x) for x in rows[25:])
    monkeypatch.setattr(bam, "BLOCK", 400)
    (tmp_path / "a.bam").write_bytes(bam.header(["G"], "c", "1") + bam.blocks(data) + bam.block(b""))
    whole = read(tmp_path / "a.bam", 1 << 30)
    assert len(whole) == 51 and all(read(tmp_path / "a.bam", cut) == whole for cut in (13, 61, 397))


def test_no_blocks(tmp_path):
    (tmp_path / "x").write_bytes(b"plain text, no blocks")
    with pytest.raises(ValueError):
        read(tmp_path / "x", 10)


def test_read_by_tasks(spark, tmp_path):
    r = random.Random(1)
    (tmp_path / "a.bam").write_bytes(bam.header(["G1", "G2", "G3"], "c", "1") + bam.blocks(b"".join(bam.record(*x) for x in made(r, 3000))) + bam.block(b""))
    size = (tmp_path / "a.bam").stat().st_size
    one, many = (bam.read_bam(spark, str(tmp_path / "a.bam"), n) for n in (size, size // 8 + 1))
    assert many.rdd.getNumPartitions() == 8 and sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr) and many.count() == 3000
