"""The conversion against a plain Python one on random graphs and reads, its failures, files, stream and command line."""

import base64
import gzip
import io
import json
import random

import made
import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.functions import molecule as mol, quality, scoring
from skein.operators import attribute, checks, ledger
from skein.operators.checks import InputError
from skein.plans.annotate import annotate
from skein.plans.convert import SUMMARY, Options, convert, edit_rows, scored_mappings
from skein.sources import bam, parts, rad, readers, writers
from skein.streaming import convert as stream

O = dict(barcode_length=6, umi_length=4)  # noqa: E741


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    nodes, paths, exon, body, records = made.small(5)
    d = made.write(tmp_path_factory.mktemp("world"), nodes, paths, exon, body, records)
    return d, nodes, paths, exon, body, records


def loaded(spark, d):
    return readers.read_alignments(spark, f"{d}/reads.json"), *readers.read_gfa(spark, f"{d}/g.gfa"), readers.read_path_map(spark, f"{d}/exon.tsv")


def told(out):
    hits = {r.target_id: r.target for r in out["dictionary"].collect()}
    rows = [(r.read, sorted((hits[h.target_id], h.forward) for h in r.hits)) for r in sorted(out["records"].collect(), key=lambda r: r.ord)]
    return rows, {r.key: r.value for r in out["summary"].collect()}


@pytest.mark.parametrize("mode,strand", [("score", "both"), ("score", "reverse"), ("gene", "both"), ("genefull", "forward"), ("genefull_exonoverintron", "both"), ("genefull_ex50pas", "both")])
def test_conversion(spark, world, mode, strand):
    d, nodes, paths, exon, body, records = world
    own = body if mode != "score" else None
    want, counters = made.converted(records, paths, exon, own, mode, strand)
    out = convert(spark, *loaded(spark, d), Options(**O, count_mode=mode, strand=strand), readers.read_path_map(spark, f"{d}/body.tsv") if own else None)
    rows, summary = told(out)
    assert rows == want and len(want) > 3
    assert summary == {k: str(counters[k]) for k in SUMMARY}
    if mode == "score":
        assert [r.status for r in out["rejected"].orderBy("ord").collect()] == [s for n in dict.fromkeys(r["name"] for r in records) if (s := made.status_of(n, 6, 4)) != "ok"]


def test_fold_equals_window(spark, world):
    """Scores within the row and as window expressions over edits."""
    reads = loaded(spark, world[0])[0].where("size(subpath) > 0")
    key = ["read", "rec", "node", "read_rev"]
    total = lambda m: sorted(map(tuple, m.groupBy(*key).agg(F.sum("score"), F.sum("aligned")).collect()))
    edits = scoring.score_edits(edit_rows(reads), ["read", "rec", "sub"], F.col("read_offset"), F.col("read_total"))
    windows = edits.withColumn("aligned", scoring.aligned_bases())
    assert total(scored_mappings(reads)) == total(windows)
    want = sorted((r["name"], m) for r in world[5] if r.get("subpath") for m in made.mapping_scores(r))
    assert sorted((r.read, (r.node, r.read_rev, r.score, r.aligned)) for r in scored_mappings(reads).collect()) == want


def record(name, nodes, edits=({"from_length": 3, "to_length": 3},), **more):
    return {"name": name, "sequence": "ACG" * len(nodes), "subpath": [{"path": {"mapping": [{"position": {"node_id": str(n)}, "edit": list(edits)} for n in nodes]}}]} | more


def one(spark, tmp_path, d, records, options=Options(**O), **kw):
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, records)) + "\n")
    return convert(spark, readers.read_alignments(spark, str(tmp_path / "r.json")), *loaded(spark, d)[1:], options, **kw)


def test_empty_edits_count(spark, world, tmp_path):
    """Mappings without edits score 0, but give their node's paths a tally."""
    d, nodes, paths, exon = world[:4]
    n = next(n for p in exon for n, _ in paths[p])
    want, _ = made.converted(r := [record("a_ACGTAC_AAAA", [n], ()), record("b_ACGTAC_AAAA", [n], [{}])], paths, exon)
    assert told(one(spark, tmp_path, d, r))[0] == want and [x[0] for x in want] == ["a_ACGTAC_AAAA", "b_ACGTAC_AAAA"]


def test_refusals(spark, world, tmp_path):
    d, n = world[0], next(iter(world[1]))
    good, bad = record("a_ACGTAC_AAAA", [n]), record("broken", [n])
    cases = [
        ([good, record("b_ACGTAC_AAAA", [n]), good], Options(**O), "grouping_recurrence_failures=1.*a_ACGTAC"),
        ([good, bad], Options(**O, failures="fail"), "broken"),
        ([record("a_ACGTAC_AAAA", [7])], Options(**O), "not in the graph"),
        ([record("a_ACGTAC_AAAA", [7], ())], Options(**O), "not in the graph"),
        ([], Options(**O), "empty"),
    ]
    for rows, options, message in cases:
        with pytest.raises(InputError, match=message):
            one(spark, tmp_path, d, rows, options)
    for wrong in (Options(count_mode="gene"), Options(strand="up"), Options(barcode_length=33), Options(umi_length=0), Options(failures="x"), Options(scores="x"), Options(alignments="x"), Options(count_mode="x")):
        with pytest.raises(ValueError):
            wrong.check(False)
    with pytest.raises(ValueError):
        Options().check(True)
    for text, message in (("p\n", "two non-empty"), ("# only\n\n", "no rows"), ("p\t\n", "two non-empty")):
        (tmp_path / "m.tsv").write_text(text)
        with pytest.raises(InputError, match=message):
            readers.read_path_map(spark, str(tmp_path / "m.tsv"))
    (tmp_path / "m.tsv").write_text("TX1_H1\tG1\nTX1_H2\tG2\n")
    with pytest.raises(InputError, match="two genes"):
        convert(spark, *loaded(spark, d)[:3], readers.read_path_map(spark, str(tmp_path / "m.tsv")), Options(**O))
    few = spark.createDataFrame([("TX0", 0)], "target string, target_id int")
    hit = spark.createDataFrame([("r", "TX1", True)], "read string, target string, forward boolean")
    with pytest.raises(Exception, match="not in the dictionary"):
        attribute.encode(hit, few).collect()


def test_rad(spark, world, tmp_path):
    """Written and read back, with one record a chunk, several parts, and without records; as one file, too."""
    d, _, paths, exon, _, records = world
    out = convert(spark, *loaded(spark, d), Options(**O))
    want, _ = made.converted(records, paths, exon)
    code = lambda s: str(sum("ACGT".index(b.upper().replace("N", "A")) << 2 * i for i, b in enumerate(reversed(s))))
    rows = [(*map(code, n.split("_")[-2:]), t, f) for n, hits in want for t, f in hits]
    for budget in (1, 1 << 30):
        path = str(tmp_path / f"{budget}.rad")
        rad.write_rad(out["records"], out["dictionary"], path, 6, 4, budget)
        rad.write_rad(out["records"], out["dictionary"], path, 6, 4, budget)  # takes the older one's place
        got = rad.read_rad(spark, path).orderBy("record", "target").collect()
        assert [tuple(r)[1:] for r in got] == rows and got[-1].record == len(want) - 1
        rad.as_one_file(path, path + ".one")
        assert rad.read_rad(spark, path + ".one").count() == len(rows)
        with open(path + ".one", "rb") as f:
            names, chunks, _ = rad.parse_header(f)
        assert names == sorted({made.bare(p) for p in exon}) and (chunks == len(want) if budget == 1 else chunks <= 8)
    none = str(tmp_path / "none.rad")
    rad.write_rad(out["records"].where("false"), out["dictionary"], none, 6, 4)
    assert rad.read_rad(spark, none).count() == 0
    with open(f"{none}/{rad.HEADER}", "rb") as f:
        assert rad.parse_header(f)[1] == 0
    bad = out["records"].limit(1).withColumn("hits", F.expr("filter(hits, h -> false)"))
    with pytest.raises(Exception, match="needs a hit"):
        rad.write_rad(bad, out["dictionary"], str(tmp_path / "bad.rad"), 6, 4)
    assert not [p.name for p in tmp_path.iterdir() if "bad" in p.name]


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_command_line(spark, world, tmp_path, capsys):
    d, _, paths, exon, body, records = world
    argv = ["--reads", f"{d}/reads.json", "--graph", f"{d}/g.gfa", "--t2g", f"{d}/exon.tsv", "--out-dir", str(tmp_path / "o"), "--raw-cb-length", "6", "--raw-umi-length", "4", "--sam-out", str(tmp_path / "sam"), "--bam-out", str(tmp_path / "bam"), "--bam-multigene", "first"]
    cli.run(spark, cli.parser().parse_args(argv), "cmd")
    want, counters = made.converted(records, paths, exon)
    assert lines(tmp_path / "o" / "summary.tsv") == [f"{k}\t{counters[k]}" for k in SUMMARY]
    assert lines(tmp_path / "o" / "tx2gene.tsv") == sorted({f"{made.bare(p)}\t{g}" for p, g in exon.items()})
    assert len(lines(tmp_path / "o" / "warnings.txt")) == counters["raw_molecule_skipped_groups"]
    sam, gene = lines(tmp_path / "sam"), {made.bare(p): g for p, g in exon.items()}
    assert sam[:5] == ["@HD\tVN:1.6\tSO:unsorted"] + [f"@SQ\tSN:GENE{g}\tLN:{1 << 28}" for g in range(3)] + ["@PG\tID:skein\tPN:skein\tVN:1.0\tCL:cmd"]
    first = {n: next(r["sequence"] for r in records if r["name"] == n and r.get("subpath")) for n, _ in want}
    for line, (name, hits) in zip(sam[5:], want, strict=True):
        f, genes = line.split("\t"), sorted({gene[t] for t, _ in hits})
        *rest, cb, umi = name.split("_")
        seq = first[name]
        assert f[:11] == ["_".join(rest), "0", genes[0], "1", "255", f"{len(seq)}M" if seq else "*", "*", "0", "0", seq or "*", "*"]
        assert f[11:] == [f"{t}:Z:{v}" for t, v in (("CB", cb), ("CR", cb), ("UB", umi), ("UR", umi), ("GX", ";".join(genes)), ("GN", ";".join(genes)), ("XT", genes[0]))]
    tags = readers.read_sam_tags(spark, str(tmp_path / "sam")).collect()
    assert len(tags) == len(want) and all(t.pos == 1 and len(t.cell) == 6 and t.gene for t in tags)
    moved = writers.by_place(readers.read_sam_tags(spark, str(tmp_path / "sam")).withColumn("ord", F.monotonically_increasing_id()), "gene").collect()
    assert [r.gene for r in moved] == sorted(r.gene for r in tags)
    got = [tuple(r) for r in bam.read_bam(spark, str(tmp_path / "bam")).collect()]
    text = [(f[0], 0, f[2], 1, 255, f[5].replace("*", ""), f[9].replace("*", ""), *(f[k][5:] for k in (11, 13, 15, 17))) for f in (x.split("\t") for x in sam[5:])]
    assert sorted(got) == sorted(text)
    parts.as_one_file(str(tmp_path / "bam"), str(tmp_path / "one.bam"))
    assert sorted(map(tuple, bam.read_bam(spark, str(tmp_path / "one.bam")).collect())) == sorted(text)
    raw = (tmp_path / "one.bam").read_bytes()  # blocks are gzip members, too
    assert gzip.decompress(raw)[:4] == b"BAM\1" and raw.endswith(bam.block(b"")) and len(bam.block(b"")) == 28
    for bad in ("-1", "+1", "1x", "", str(1 << 64), "٣"):
        with pytest.raises(Exception, match="not a size"):
            cli.size(bad)
    assert cli.size("07") == 7 and cli.main([]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])


@pytest.mark.parametrize("files,per_batch", [(1, 1), (7, 2)])
def test_stream(spark, world, tmp_path, files, per_batch):
    """A stream cut anywhere, within reads, gives the batch's records; files may be split into many tasks."""
    d, nodes, paths, exon, _, records = world
    (tmp_path / "in").mkdir()
    cut = [len(records) * k // files for k in range(files + 1)]
    for k in range(files):
        (tmp_path / "in" / f"f{k}.json").write_text("\n".join(map(json.dumps, records[cut[k] : cut[k + 1]])) + "\n")
    graph, out, key = loaded(spark, d)[1:], f"file://{tmp_path}/out", "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "2000")
    try:
        stream.stream_convert(spark, str(tmp_path / "in"), *graph, out, f"file://{tmp_path}/cp", Options(**O), files_per_batch=per_batch).awaitTermination()
        stream.finish(spark, *graph, out, Options(**O))
    finally:
        spark.conf.set(key, "128m")
    got = spark.read.parquet(f"{out}/records").orderBy("batch", "ord").collect()
    want, _ = made.converted(records, paths, exon)
    assert [r.read for r in got] == [n for n, _ in want] and [len(r.hits) for r in got] == [len(h) for _, h in want]
    # a read that was closed comes again
    (tmp_path / "in" / "z.json").write_text(json.dumps(records[0]) + "\n")
    with pytest.raises(Exception, match="grouping_recurrence_failures"):
        stream.stream_convert(spark, str(tmp_path / "in"), *graph, out, f"file://{tmp_path}/cp", Options(**O)).awaitTermination()


def rad_bytes(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_pipe_and_restart(spark, world, tmp_path, monkeypatch):
    """Lines from a pipe, and a stream that fails in a batch and goes on, write the files of the batch, byte for byte."""
    d, _, paths, exon, body, records = world
    argv = ["--graph", f"{d}/g.gfa", "--t2g", f"{d}/exon.tsv", "--raw-cb-length", "6", "--raw-umi-length", "4", "--max-chunk-bytes", "300"]
    text = "".join(json.dumps(r) + ("\n\n" if i % 7 == 0 else "\n") for i, r in enumerate(records)).rstrip("\n").encode()  # no newline at the end
    run = lambda out, reads, *more: cli.run(spark, cli.parser().parse_args([*argv, "--reads", reads, "--out-dir", str(out), *more]), "cmd")
    (tmp_path / "all.json").write_bytes(text)
    run(tmp_path / "batch", str(tmp_path / "all.json"), "--sam-out", str(tmp_path / "batch-sam"))

    class Piped:
        buffer = io.BytesIO(text)

    held = stream.pipe.FILE_BYTES, stream.pipe._READ
    monkeypatch.setattr(cli.sys, "stdin", Piped)
    monkeypatch.setattr(stream.pipe, "_READ", 1000)
    whole = stream.convert_pipe
    monkeypatch.setattr(cli, "convert_pipe", lambda *a: whole(*a, size=len(text) // 3))
    run(tmp_path / "pipe", "-", "--sam-out", str(tmp_path / "pipe-sam"))
    assert held[0] > len(text)
    assert rad_bytes(tmp_path / "pipe" / "map.rad") == rad_bytes(tmp_path / "batch" / "map.rad")
    for name in ("tx2gene.tsv", "summary.tsv", "warnings.txt"):
        assert lines(tmp_path / "pipe" / name) == lines(tmp_path / "batch" / name)
    assert lines(tmp_path / "pipe-sam") == lines(tmp_path / "batch-sam")
    Piped.buffer = io.BytesIO(b"")
    with pytest.raises(InputError, match="empty"):
        run(tmp_path / "none", "-")

    # the second batch fails after it wrote its records, and is run again
    (tmp_path / "in").mkdir()
    cut = [len(records) * k // 3 for k in range(4)]
    for k in range(3):
        (tmp_path / "in" / f"f{k}.json").write_text("".join(json.dumps(r) + "\n" for r in records[cut[k] : cut[k + 1]]))
    graph, out, write = loaded(spark, d)[1:], f"file://{tmp_path}/out", stream._write

    def failing(told, to, k):
        write({"records": told["records"]} if k == 1 else told, to, k)
        if k == 1:
            raise RuntimeError("lost")

    go = lambda: stream.stream_convert(spark, str(tmp_path / "in"), *graph, out, f"file://{tmp_path}/cp", Options(**O), files_per_batch=1).awaitTermination()
    monkeypatch.setattr(stream, "_write", failing)
    with pytest.raises(Exception, match="lost"):
        go()
    monkeypatch.setattr(stream, "_write", write)
    go()
    told = stream.finish(spark, *graph, out, Options(**O))
    rad.write_rad(told["records"], told["dictionary"], str(tmp_path / "again.rad"), 6, 4, 300)
    assert rad_bytes(tmp_path / "again.rad") == rad_bytes(tmp_path / "batch" / "map.rad")
    assert [f"{r.key}\t{r.value}" for r in told["summary"].orderBy("place").collect()] == lines(tmp_path / "batch" / "summary.tsv")
    assert sorted(p.name for p in (tmp_path / "out" / "lines").iterdir()) == [] and len(list((tmp_path / "out" / "open").iterdir())) == 2


def test_spooled_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream.pipe, "_READ", 700)
    text = b"".join(b"%d" % i * (i % 50) + b"\n" for i in range(3000)) + b"end"
    got = list(stream.pipe.spooled(spark, io.BytesIO(text), f"file://{tmp_path}/s", 5000))
    files = sorted((tmp_path / "s").glob("lines-*"))
    assert len(got) == len(files) > 3 and b"".join(f.read_bytes() for f in files) == text
    assert all(f.read_bytes().endswith(b"\n") for f in files[:-1])
    assert list(stream.pipe.spooled(spark, io.BytesIO(b""), f"file://{tmp_path}/t")) == []


def test_gene_bodies(spark, tmp_path):
    """From a GTF to the steps of gene bodies and their map."""
    rng = random.Random(11)
    length = {i: rng.randint(1, 9) for i in range(1, 60)}
    (tmp_path / "g.gfa").write_text("".join(f"S\t{n}\t{'A' * k}\n" for n, k in length.items()) + "P\tchr1\t" + ",".join(f"{n}{'-' if n % 5 == 0 else '+'}" for n in length) + "\t*\n")
    ends = [(g, a, a + rng.randint(1, 60), rng.random() < 0.5) for g, a in ((g, rng.randint(1, 200)) for g in range(9))]
    (tmp_path / "a.gtf").write_text("#x\n" + "".join(f'chr1\tt\t{k}\t{a}\t{b}\t.\t{"-" if r else "+"}\t.\tgene_id "G{g}"; x "y";\n' for g, a, b, r in ends for k in ("gene", "exon")))
    nodes, steps = readers.read_gfa(spark, str(tmp_path / "g.gfa"))
    after, named = annotate(readers.read_gtf(spark, str(tmp_path / "a.gtf")), nodes, steps)
    got = {}
    for r in after.where("path <> 'chr1'").orderBy("step_ord").collect():
        got.setdefault(r.path, []).append((r.node, r.path_rev))
    want, at = {}, 0
    for n, k in length.items():
        for g, a, b, r in ends:
            if a - 1 < at + k and b > at:
                want.setdefault(f"G{g}_R1", []).append((n, (n % 5 == 0) != r))
        at += k
    for g, _, _, r in ends:
        if r and f"G{g}_R1" in want:
            want[f"G{g}_R1"].reverse()
    assert got == want and after.where("path = 'chr1'").count() == len(length)
    assert {(r.path, r.gene) for r in named.collect()} == {(p, p[:-3]) for p in want}


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} more/1\nACGT\n+\nIIII\n" for i in range(30)))
    got = readers.tag_fastq(spark, str(tmp_path / "a.fq"), "AAAC").orderBy("ord").collect()
    assert [r.name for r in got[:5]] == [f"r{i}_AAAC_" + "A" * 10 + u for i, u in enumerate(("AA", "AC", "AG", "AT", "CA"))] and len(got) == 30 and got[7].quality == "IIII"
    (tmp_path / "c.tsv").write_text("#note\ngene\tcell\tcount\nG1\tACGT\t3\nG2\tAAAA\t1\n")
    assert [tuple(r) for r in readers.read_counts(spark, str(tmp_path / "c.tsv")).orderBy("gene").collect()] == [("G1", "ACGT", 3), ("G2", "AAAA", 1)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% x\n2 3 3\n1 1 2\n2 3 1.5\n1 2 4\n")
    (tmp_path / "r.txt").write_text("c1\nc2\n")
    (tmp_path / "k.txt").write_text("g1\ng2\ng3\n")
    m = readers.read_matrix(spark, *(str(tmp_path / n) for n in ("m.mtx", "r.txt", "k.txt")))
    assert {tuple(r) for r in m.collect()} == {("c1", "g1", 2.0), ("c2", "g3", 1.5), ("c1", "g2", 4.0)}


def test_molecule_names(spark):
    rng = random.Random(1)
    names = {"_".join(rng.choice(["", "x", "ACGT", "acgn", "AC", "AX", "ACGTA"]) for _ in range(rng.randint(1, 5))) for _ in range(300)}
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", mol.molecule(F.col("n"), 4, 2)["status"].alias("s"))
    assert {r.n: r.s for r in df.collect()} == {n: made.status_of(n, 4, 2) for n in names}


@pytest.mark.parametrize("mode", ledger.MODES)
def test_count_modes(spark, mode):
    """Random ledgers, with ties and empty entries, against the rules told one by one."""
    rng = random.Random(mode)
    rows, lengths, want = [], [], set()
    for r in range(150):
        n, own = rng.choice([0, 10, 20, 30]), {}
        for g in rng.sample("ABCD", rng.randint(0, 3)):
            ex, intron = rng.choice([0, 0, 5, 10, 15]), rng.choice([0, 0, 5, 10])
            fwd = rng.randint(0, ex + intron) if ex + intron else 0
            fwd = (ex + intron) // 2 if rng.random() < 0.2 else fwd
            own[g] = {"ex": ex, "in": intron, True: fwd, False: ex + intron - fwd}
            rows.append((r, g, ex, intron, fwd, ex + intron - fwd))
        lengths.append((r, n))
        want |= {(r, g, f) for g, f in made.chosen(mode, own, n).items()}
    e = spark.createDataFrame(rows, "read int, gene string, exonic long, intronic long, fwd long, rev long")
    n = spark.createDataFrame(lengths, "read int, read_length long")
    assert set(map(tuple, ledger.count_mode(e, n, mode).collect())) == want and want
    assert ledger.count_mode(e.where("false"), n, mode).count() == 0


def test_read_ends_can_be_off(spark):
    df = spark.createDataFrame([(1, 0, 0, 2, False), (1, 1, 5, 5, False)], "read int, ord int, from_length long, to_length long, mismatch boolean")
    scores = lambda p: [r.score for r in scoring.score_edits(df, ["read"], p=p).orderBy("ord").collect()]
    assert scores(scoring.Params()) == [0, 10] and scores(scoring.Params(read_ends=False)) == [-7, 5]


def test_quality_tables():
    hit, miss, end = quality.tables()
    q = (0, 1, 2, 3, 5, 8, 10, 11, 15, 20, 25, 30, 40, 60)
    assert [miss[x] for x in q] == [0, 0, 0, 0, -1, -1, -1, -2, -2, -3, -3, -4, -4, -4]
    assert [end[x] for x in q] == [0, 0, 0, 4] + [5] * 10 and [hit[x] for x in q] == [0] * 4 + [1] * 10


def brute_adjusted(r, nodes):
    """(node, score) of each mapping of a read with one subpath, base by base."""
    hit, miss, end = quality.tables()
    pos, out, gap = 0, [], False
    for m in r["subpath"][0]["path"]["mapping"]:
        seq, at, score = nodes[int(m["position"]["node_id"])], int(m["position"].get("offset", 0)), 0
        if m["position"].get("is_reverse"):
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for e in m["edit"]:
            n, to = e.get("from_length", 0), e.get("to_length", 0)
            ends = (pos == 0) + (pos + to == len(r["sequence"]))
            if n and to:
                for k in range(to):
                    a, b, q = seq[at + k].upper(), r["sequence"][pos + k].upper(), r["raw"][pos + k]
                    score += 0 if a not in "ACGT" or b not in "ACGT" else hit[q] if a == b else miss[q]
                score += end[r["raw"][pos]] * (pos == 0) + end[r["raw"][pos + to - 1]] * (pos + to == len(r["sequence"]))
                gap = False
            elif n:
                score -= n if gap else 6 + n - 1
                gap = True
            elif to:
                score -= 0 if ends else 6 + to - 1
                gap = False
            pos, at = pos + to, at + n
        out.append((int(m["position"]["node_id"]), score))
    return out


def test_quality_adjusted(spark, tmp_path):
    rng = random.Random(3)
    nodes = {n: "".join(rng.choices(made.BASES, k=12)) for n in (21, 22, 23, 24)}
    rows = []
    for i in range(40):
        maps, seq = [], ""
        for n in rng.sample(list(nodes), 2):
            skip, cut, more = rng.randrange(3), rng.randrange(1, 3), rng.randrange(1, 3)
            edit = [{"from_length": 2, "to_length": 2}, {"from_length": cut}, {"to_length": more, "sequence": "A" * more}, {"from_length": 1, "to_length": 1, "sequence": "C"}, {"from_length": 2, "to_length": 2}]
            maps.append({"position": {"node_id": str(n), "offset": str(skip)} | ({"is_reverse": True} if rng.random() < 0.5 else {}), "edit": edit})
            seq += "".join(rng.choice("ACGTNacgt") for _ in range(5 + more))
        raw = bytes(rng.choice((0, 1, 2, 3, 11, 25, 40, 200)) for _ in seq)
        rows.append({"name": f"r{i}_ACGTAC_AAAA", "sequence": seq, "quality": base64.b64encode(raw).decode(), "raw": raw, "subpath": [{"path": {"mapping": maps}}]})
    (tmp_path / "q.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "raw"}) for r in rows))
    reads = readers.read_alignments(spark, str(tmp_path / "q.json"))
    graph = spark.createDataFrame(list(nodes.items()), "node long, seq string")
    scored = scoring.score_edits(edit_rows(reads, bases=True), ["read", "rec", "sub"], F.col("read_offset"), F.col("read_total"))
    placed = quality.placed_bases(scored, graph)
    assert quality.outside(placed).count() == 0
    rest = scored.where("not (quals is not null and from_length > 0 and to_length > 0)")
    both = quality.adjust(placed).select(*scored.columns).union(rest).groupBy("read", "map", "node").agg(F.sum("score").alias("score"))
    got = {(r.read, r.map): (r.node, r.score) for r in both.collect()}
    assert got == {(r["name"], i): x for r in rows for i, x in enumerate(brute_adjusted(r, nodes))}


def test_quality_decides_and_falls_back(spark, world, tmp_path):
    """Without a quality for each base the scores are flat ones; an edit beyond its node or before it is refused."""
    d, nodes, paths, exon, _, records = world
    want, _ = made.converted(records, paths, exon)
    assert told(convert(spark, *loaded(spark, d), Options(**O, scores="qualadj")))[0] == want
    n = next(iter(nodes))
    for offset in ("7", "-1"):
        far = record("x_ACGTAC_AAAA", [n], quality=base64.b64encode(b"\x28" * 3).decode())
        far["subpath"][0]["path"]["mapping"][0]["position"]["offset"] = offset
        with pytest.raises(InputError, match="beyond"):
            one(spark, tmp_path, d, [far], Options(**O, scores="qualadj"))


def test_bam_records():
    """Odd lengths, qualities and every field of one record, told by hand."""
    raw = bam.record("r1", 2, "ACGTN", bytes([1, 2, 3, 4, 5]), {"CB": "AC", "XT": None})
    assert raw[4:40] == b"".join(x.to_bytes(4, "little") for x in (2, 0)) + bytes([3, 255]) + (4681).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(2) + (5).to_bytes(4, "little") + b"\xff" * 8 + bytes(4) + b"r1\0" + bytes([0x50])
    assert raw[40:43] == bytes(3) and raw[43:] == bytes([0x12, 0x48, 0xF0, 1, 2, 3, 4, 5]) + b"CBZAC\0" and int.from_bytes(raw[:4], "little") == len(raw) - 4
    assert bam._parsed(raw[4:], ["a", "b", "c"]) == ("r1", 0, "c", 1, 255, "5M", "ACGTN", "AC", None, None, None)
    empty = bam.record("e", 0, "", None, {})
    assert bam._parsed(empty[4:], ["a"])[5:7] == ("", "")
    assert gzip.decompress(bam.blocks(bytes(range(256)) * 600)) == bytes(range(256)) * 600
    with pytest.raises(ValueError):
        bam.record("x" * 255, 0, "", None, {})


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "v string, k int")
    assert {tuple(r) for r in checks.difference(a, b).collect()} == {(1, "x", "left"), (2, "y", "left"), (3, "z", "right")}
