"""The conversion from the command line: python -m skein.cli --reads ... --graph ... --t2g ... --out-dir ..."""

from __future__ import annotations

import argparse
import sys

from skein.operators import attribute
from skein.operators.attribute import STRANDS
from skein.operators.checks import InputError
from skein.operators.ledger import MODES
from skein.plans.convert import Options, convert
from skein.session import scratch_dropped
from skein.sources import bam, graph_store, rad, readers, writers
from skein.streaming.convert import convert_pipe

VERSION = "1.0"


def size(text: str) -> int:
    """A length as digits only, of the range of an unsigned 64-bit integer."""
    if not (text.isascii() and text.isdigit()) or int(text) >= 1 << 64:
        raise argparse.ArgumentTypeError(f"not a size: {text!r}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Convert graph alignments of single-cell reads to compatibility records.")
    p.add_argument("--version", "-V", action="version", version=VERSION)
    p.add_argument("--reads", "--gamp", dest="reads", required=True, help="alignments as JSON lines: a file, folder or pattern, or - for the standard input")
    p.add_argument("--graph", "--xg", dest="graph", required=True, help="the graph as GFA, or a folder that --save-graph wrote")
    p.add_argument("--save-graph", help="lay the graph out in this folder, for this run and later ones")
    p.add_argument("--t2g", required=True, help="path to gene")
    p.add_argument("--body-t2g", help="gene body path to gene; the gene count modes need it")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--raw-cb-length", type=size, default=16)
    p.add_argument("--raw-umi-length", type=size, default=12)
    p.add_argument("--score", choices=("flat", "qualadj"), default="flat")
    p.add_argument("--molecule-identity-failures", choices=("skip", "fail"), default="skip")
    p.add_argument("--strand", choices=STRANDS, default="both")
    p.add_argument("--count-mode", choices=("score", *MODES), default="score")
    p.add_argument("--bam-out", help="tagged alignments go to this folder")
    p.add_argument("--sam-out", help="and as text to this one")
    p.add_argument("--bam-multigene", choices=("omit", "first"), default="omit")
    p.add_argument("--max-chunk-bytes", type=size, default=rad.MAX_CHUNK)
    return p


def run(spark, args: argparse.Namespace, command: str = "") -> None:
    """Writes map.rad, tx2gene.tsv, summary.tsv and warnings.txt under the output folder, and tagged alignments if asked."""
    options = Options(args.raw_cb_length, args.raw_umi_length, args.molecule_identity_failures, args.strand, args.count_mode, args.score, args.bam_multigene if args.bam_out or args.sam_out else "off")
    options.check(args.body_t2g is not None)
    if args.save_graph or graph_store.is_graph(spark, args.graph):
        laid = graph_store.write_graph(*readers.read_gfa(spark, args.graph), args.save_graph) if args.save_graph else graph_store.open_graph(spark, args.graph)
        nodes, steps = laid.nodes, laid.steps
    else:
        laid, (nodes, steps) = None, readers.read_gfa(spark, args.graph)
    body = readers.read_path_map(spark, args.body_t2g) if args.body_t2g else None
    t2g = readers.read_path_map(spark, args.t2g)
    known = attribute.restricted(laid.interned, t2g) if laid else None
    if args.reads == "-":
        out = convert_pipe(spark, sys.stdin.buffer, nodes, steps, t2g, options, body, **({"graph": known} if known else {}))
    else:
        out = convert(spark, readers.read_alignments(spark, args.reads), nodes, steps, t2g, options, body, known)
    to = args.out_dir.rstrip("/")
    rad.write_rad(out["records"], out["dictionary"], f"{to}/map.rad", args.raw_cb_length, args.raw_umi_length, args.max_chunk_bytes)
    writers.write_map(out["tx2gene"], f"{to}/tx2gene.tsv")
    writers.write_summary(out["summary"], f"{to}/summary.tsv")
    writers.write_rejected(out["rejected"], f"{to}/warnings.txt")
    if args.bam_out:
        bam.write_bam(out["alignments"], out["tx2gene"], args.bam_out, command, VERSION)
    if args.sam_out:
        writers.write_sam(out["alignments"], out["tx2gene"], args.sam_out, command, VERSION)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        parser().print_usage()
        return 0
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("skein").getOrCreate()
    try:
        with scratch_dropped(spark):
            run(spark, args, " ".join(["skein", *argv]))
    except (InputError, ValueError) as e:
        print(f"skein: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
