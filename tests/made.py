"""Random graphs and alignments, and a plain Python conversion to compare with."""

import random
import re
from collections import Counter, defaultdict

BASES = "ACGT"


def graph(rng, n=14):
    """nodes {id: seq}, paths {name: [(node, reverse)]}, exon and body maps."""
    nodes = {100 + i: "".join(rng.choices(BASES, k=rng.randint(3, 9))) for i in range(n)}
    walk = lambda: [(rng.choice(list(nodes)), rng.random() < 0.3) for _ in range(rng.randint(2, 7))]
    paths = {f"TX{t}_{kind}{c}": walk() for t in range(5) for c in range(1, 3) for kind in ("H",)}
    paths |= {f"GENE{g}_R1": walk() for g in range(3)} | {"ref": list((n, False) for n in nodes)}
    exon = {p: f"GENE{int(p[2]) % 3}" for p in paths if p.startswith("TX")}
    body = {f"GENE{g}": f"GENE{g}" for g in range(3)}  # by the bare name
    return nodes, paths, exon, body


def reads(rng, nodes, n=60, cb=6, umi=4):
    """Alignment records in groups of a name, with branches, empty edits, missing fields and bad names."""
    out = []
    for i in range(n):
        tag = "".join(rng.choices(BASES + "N", k=cb)) + "_" + "".join(rng.choices(BASES, k=umi))
        name = rng.choice([f"q{i}_{tag}"] * 12 + [f"q{i}", f"q{i}_{tag}A", f"q{i}_{tag[:-1]}X", f"q_{i}_{tag}"])
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            k = rng.choice([0, 1, 1, 2, 3, 4])
            subs = []
            for s in range(k):
                maps = []
                for _ in range(rng.randint(1, 3)):
                    edits = []
                    for _ in range(rng.choice([0, 1, 1, 2, 3])):
                        f = rng.choice([1, 2, 4])
                        e = rng.choice([{"from_length": f, "to_length": f}] * 3 + [{"from_length": f, "to_length": f, "sequence": "A" * f}, {"from_length": f}, {"to_length": f, "sequence": "C" * f}, {}])
                        edits.append(e)
                    pos = {"node_id": str(rng.choice(list(nodes)))} | ({"is_reverse": True} if rng.random() < 0.4 else {})
                    maps.append({"position": pos} | ({"edit": edits} if edits else {}))
                later = [j for j in range(s + 1, k) if rng.random() < 0.6]
                sub = {"path": {"mapping": maps}}
                if later:
                    sub |= {"next": later[:1]} | ({"connection": [{"next": j, "score": -1} for j in later[1:]]} if later[1:] else {})
                subs.append(sub)
            total = max([sum(e.get("to_length", 0) for m in s["path"]["mapping"] for e in m.get("edit", [])) for s in subs], default=0)
            out.append({"name": name, "sequence": "".join(rng.choices(BASES, k=total + rng.choice([0, 0, 3])))} | ({"subpath": subs} if subs else {}) | ({"start": [0]} if subs and rng.random() < 0.3 else {}))
    return out


def status_of(name, cb, umi):
    *rest, b, u = ["", ""] + name.split("_")
    original = "_".join(rest[2:])
    if name.count("_") < 2 or not b or not u:
        return "missing"
    if not original or len(b) != cb or len(u) != umi:
        return "malformed"
    return "ok" if re.fullmatch("[ACGTNacgtn]+", b + u) else "unsupported"


def offsets(rec):
    subs = rec["subpath"]
    into = [{*s.get("next", []), *(c["next"] for c in s.get("connection", []))} for s in subs]
    at = {s: 0 for s in rec.get("start", []) or [i for i in range(len(subs)) if not any(i in x for x in into)]}
    for i, s in enumerate(subs):
        if i in at:
            for j in into[i]:
                at.setdefault(j, at[i] + sum(e.get("to_length", 0) for m in s["path"]["mapping"] for e in m.get("edit", [])))
    return [at.get(i, 0) for i in range(len(subs))]


def mapping_scores(rec):
    """(node, reverse, score, aligned) of every mapping."""
    total = len(rec["sequence"])
    for sub, pos in zip(rec["subpath"], offsets(rec)):
        gap = False
        for m in sub["path"]["mapping"]:
            score = aligned = 0
            for e in m.get("edit", []):
                f, t = e.get("from_length", 0), e.get("to_length", 0)
                ends = (pos == 0) + (pos + t == total)
                if f and t:
                    score += (-4 * f if e.get("sequence") else f) + 5 * ends
                    aligned += f
                elif f:
                    score -= f if gap else 5 + f
                elif t and not ends:
                    score -= 5 + t
                if f or t:
                    gap = bool(f and not t)
                pos += t
            yield int(m["position"]["node_id"]), m["position"].get("is_reverse", False), score, aligned


def bare(name):
    return re.sub("_[HR][0-9]+$", "", name)


def layers(paths, exon, body):
    for p in sorted(paths):
        for table, is_exon in ((exon, True), (body, False)):
            gene = table.get(p) or table.get(bare(p))
            if gene:
                yield p, gene, is_exon
                break


def chosen(mode, ledger, length):
    """The genes that a count mode keeps, with their strand."""
    rows = {g: (x["ex"], x["in"], x[True] >= x[False]) for g, x in ledger.items() if x["ex"] + x["in"] > 0}
    if mode == "gene":
        rows = {g: r for g, r in rows.items() if r[0] > 0 and r[0] >= length / 2}
    if mode == "genefull_exonoverintron" and any(r[1] == 0 for r in rows.values()):
        rows = {g: r for g, r in rows.items() if r[1] == 0}
    if mode == "genefull_ex50pas":
        rows = {g: r for g, r in rows.items() if r[1] or r[2]}
        if any(r[0] > r[1] for r in rows.values()):
            rows = {g: r for g, r in rows.items() if r[0] > r[1]}
    return {g: r[2] for g, r in rows.items()}


def converted(records, paths, exon, body=None, mode="score", strand="both", cb=6, umi=4):
    """[(name, [(target, forward)])] of emitted groups in order, and the counters."""
    on_node = defaultdict(list)
    for p, steps in paths.items():
        for n, rev in steps:
            on_node[n].append((p, rev))
    genes = defaultdict(dict)
    if body is not None:
        for p, gene, is_exon in layers(paths, exon, body):
            for n, rev in paths[p]:
                old = genes[n].get(gene, (False, False))
                genes[n][gene] = (old[0] or is_exon, rev)
    groups, order = defaultdict(list), []
    for r in records:
        if r["name"] not in groups:
            order.append(r["name"])
        groups[r["name"]].append(r)
    out, c, sizes = [], Counter(), Counter()
    for name in order:
        c["input_read_groups"] += 1
        c["input_records"] += len(groups[name])
        status = status_of(name, cb, umi)
        if status != "ok":
            c[f"raw_molecule_{status}_groups"] += 1
            c["raw_molecule_skipped_groups"] += 1
            continue
        held = [r for r in groups[name] if r.get("subpath")]
        if mode == "score":
            tally = defaultdict(Counter)
            for r in held:
                for node, rev, score, aligned in mapping_scores(r):
                    for p, prev in on_node[node]:
                        if p in exon:
                            tally[p]["score"] += score
                            tally[p][rev == prev] += aligned
            best = max((t["score"] for t in tally.values()), default=0)
            each = defaultdict(Counter)
            for p, t in tally.items():
                if t["score"] == best:
                    each[bare(p)].update({k: t[k] for k in (True, False)})
            hits = {t: x[True] >= x[False] for t, x in each.items()}
        else:
            ledger = defaultdict(Counter)
            for r in held:
                for node, rev, _, aligned in mapping_scores(r):
                    for g, (is_exon, grev) in genes[node].items() if aligned else ():
                        ledger[g]["ex" if is_exon else "in"] += aligned
                        ledger[g][rev == grev] += aligned
            hits = chosen(mode, ledger, max((len(r["sequence"]) for r in held), default=0))
        if not hits:
            c["no_compatible_transcript_groups"] += 1
            c["unaligned_reads"] += not held
            continue
        kept = {t: f for t, f in hits.items() if strand == "both" or f == (strand == "forward")}
        if not kept:
            c["strand_filtered_groups"] += 1
        elif mode != "score" and len(kept) > 1:
            c["multigene_dropped_groups"] += 1
        else:
            c["emitted_groups"] += 1
            sizes[len(kept)] += 1
            out.append((name, sorted(kept.items())))
    c["emitted_target_count_histogram"] = ";".join(f"{k}:{v}" for k, v in sorted(sizes.items()))
    return out, c


def write(folder, nodes, paths, exon, body, records):
    import json

    (folder / "g.gfa").write_text("H\tVN:Z:1.0\n" + "".join(f"S\t{n}\t{s}\n" for n, s in nodes.items()) + "".join(f"P\t{p}\t{','.join(f'{n}{"-" if r else "+"}' for n, r in w)}\t*\n" for p, w in paths.items()))
    (folder / "exon.tsv").write_text("# path, gene\n\n" + "".join(f"{p}\t{g}\tmore\n" for p, g in exon.items()))
    (folder / "body.tsv").write_text("".join(f"{p}\t{g}\n" for p, g in body.items()))
    (folder / "reads.json").write_text("\n" + "\n\n".join(map(json.dumps, records)) + "\n")
    return str(folder)


def small(seed):
    rng = random.Random(seed)
    g = graph(rng)
    return *g, reads(rng, g[0])
