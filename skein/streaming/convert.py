"""The conversion over a stream of alignment files or of a pipe.

Each batch writes all that the batch conversion writes: records, warnings, counters, and tagged alignments if asked for, as
folders batch=<k>, which a batch that is run again writes again. `finish` converts the read still open at the end of the
input and tells the whole run's outputs as convert() does: in the input's order, counters summed up. Whoever is killed
goes on from the checkpoint; what is written in the end is the same, byte for byte.

Each batch writes the names it has, once each, and looks up which of them earlier batches wrote: a join of the batch's
names with one narrow column, for which Spark keeps no state between batches. Within a batch lines get their dense order;
the last read of a batch stays open: its records are carried over to the next batch, where more may follow, since a read
may go on in the next file. A name that comes again after its read was closed is refused
(`grouping_recurrence_failures`), never dropped. `finish` converts the read still open at the end of the input.

Names stay beside the outputs, as many as there are reads; a batch scans them all, so a long stream should take many files
a batch. Files must come in the order of the input: by time of change, then name.
"""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators import attribute
from skein.operators.checks import InputError, require
from skein.plans.convert import SUMMARY, Options, convert, interned
from skein.session import exists, parted, remove, saved, scratch, scratch_dropped
from skein.sources import pipe
from skein.sources.readers import numbered, parse_alignments

#: What every batch writes.
PER_BATCH = ("records", "rejected", "summary", "alignments")
#: More lines than a batch has: places of lines in the run are made of the batch and the place in it.
BATCH_LINES = 1 << 40


def _open_path(out: str, k: int) -> str:
    return f"{out}/open/batch={k}"


def _write(told: dict[str, DataFrame], out: str, k: int) -> None:
    for name in PER_BATCH:
        if name in told:
            told[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={k}")


def _graph(spark: SparkSession, steps: DataFrame, t2g: DataFrame, options: Options) -> attribute.Interned | None:
    return interned(steps, t2g, scratch(spark, "graph")) if options.count_mode == "score" else None


def stream_convert(spark: SparkSession, folder: str, nodes: DataFrame, steps: DataFrame, t2g: DataFrame, out: str, checkpoint: str, options: Options = Options(), body: DataFrame | None = None, files_per_batch: int = 1000, graph: attribute.Interned | None = None):
    """Starts a query (available-now trigger) that writes out/<output>/batch=<k>; returns it. Started again with the same
    checkpoint, it goes on with the files that have come since. The graph is interned once for all batches, or given."""
    graph = graph or _graph(spark, steps, t2g, options)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where("trim(value) <> ''")
    lines = lines.select(F.coalesce(F.get_json_object("value", "$.name"), F.lit("")).alias("name"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def batch(df: DataFrame, k: int) -> None:
        s = df.sparkSession
        # a task reads a block from end to end, so ids ascend in it without a gap
        lines = saved(df.withColumn("id", F.monotonically_increasing_id()), f"{out}/lines/batch={k}")
        before = s.read.parquet(_open_path(out, k - 1)) if k and exists(s, _open_path(out, k - 1)) else None
        if lines.isEmpty():
            if before is not None:
                saved(before, _open_path(out, k))
            return
        here = numbered(lines, ["name", "value"])
        with parted(s, lines.count()):
            names = saved(lines.select("name").distinct(), f"{out}/names/batch={k}")
        # a batch that is run again meets earlier batches' names only
        closed = s.read.schema("name string, batch long").parquet(f"{out}/names").where(F.col("batch") < k)
        if before is not None:
            carried = before.count()  # of one read
            here = here.withColumn("ord", F.col("ord") + carried).union(before.select("name", "value", "ord"))
            closed = closed.join(before.select("name").distinct(), "name", "left_anti")
        again = names.join(closed, "name", "left_semi")
        require(here.join(again, "name", "left_semi").select("ord", "name"), "grouping_recurrence_failures=1: a closed read comes again", "ord")
        last = here.agg(F.max_by("name", "ord")).first()[0]
        left = here.where(F.col("name") == last)
        # the open read must be the last one wholly: other names between its records are recurrence, too
        gap = left.agg((F.max("ord") - F.min("ord") + 1 - F.count(F.lit(1))).alias("others")).where("others <> 0")
        require(gap, "grouping_recurrence_failures=1: records of a read are not contiguous")
        saved(left.select("name", "value", (F.col("ord") - left.agg(F.min("ord")).first()[0]).alias("ord")), _open_path(out, k))
        done = here.where(F.col("name") != last)
        if not done.isEmpty():
            with scratch_dropped(s):
                _write(convert(s, parse_alignments(done.select("value", "ord")), nodes, steps, t2g, options, body, graph), out, k)
        for name, old in (("lines", k), ("open", k - 2)):
            remove(s, f"{out}/{name}/batch={old}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, nodes: DataFrame, steps: DataFrame, t2g: DataFrame, out: str, options: Options = Options(), body: DataFrame | None = None, graph: attribute.Interned | None = None) -> dict[str, DataFrame]:
    """The input has ended: converts the read that the last batch left open; returns the whole run's outputs, as convert()
    does but for targets."""
    if not exists(spark, f"{out}/open"):
        raise InputError("the alignment input is empty")
    k = spark.read.parquet(f"{out}/open").agg(F.max("batch")).first()[0]
    left = spark.read.parquet(_open_path(out, k))
    told = convert(spark, parse_alignments(left.select("value", "ord")), nodes, steps, t2g, options, body, graph)
    _write(told, out, k + 1)
    made = {name: spark.read.schema(told[name].schema.add("batch", "long")).parquet(f"{out}/{name}") for name in PER_BATCH if name in told}
    whole = {n: t.withColumn("ord", F.col("batch") * BATCH_LINES + F.col("ord")).drop("batch") for n, t in made.items() if n != "summary"}
    return whole | {"summary": summed(made["summary"]), "dictionary": told["dictionary"], "tx2gene": told["tx2gene"]}


def summed(counters: DataFrame) -> DataFrame:
    """Summaries (place, key, value) of parts of a run -> the run's: numbers add up, and so do histograms by their keys."""
    last = F.lit(SUMMARY[-1])
    numbers = counters.where(F.col("key") != last).groupBy("place", "key").agg(F.sum(F.col("value").cast("long")).cast("string").alias("value"))
    bars = counters.where((F.col("key") == last) & (F.col("value") != "")).select(F.explode(F.split("value", ";")).alias("bar"))
    bars = bars.select(F.split("bar", ":")[0].cast("long").alias("targets"), F.split("bar", ":")[1].cast("long").alias("reads")).groupBy("targets").agg(F.sum("reads").alias("reads"))
    told = attribute.histogram_text(bars).select(F.lit(len(SUMMARY) - 1).alias("place"), last.alias("key"), F.col("histogram").alias("value"))
    return numbers.union(told)


def convert_pipe(spark: SparkSession, source: BinaryIO, nodes: DataFrame, steps: DataFrame, t2g: DataFrame, options: Options = Options(), body: DataFrame | None = None, size: int = pipe.FILE_BYTES, graph: attribute.Interned | None = None) -> dict[str, DataFrame]:
    """The conversion of JSON lines that come through a pipe: a file of lines at a time goes through the stream as it comes,
    and is deleted then. Returns what finish() does."""
    options.check(body is not None)
    folder = scratch(spark, "pipe")
    graph = graph or _graph(spark, steps, t2g, options)
    for name in pipe.spooled(spark, source, f"{folder}/in", size):
        stream_convert(spark, f"{folder}/in", nodes, steps, t2g, f"{folder}/out", f"{folder}/checkpoint", options, body, graph=graph).awaitTermination()
        remove(spark, name)
    return finish(spark, nodes, steps, t2g, f"{folder}/out", options, body, graph)
