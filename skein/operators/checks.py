"""Validations as anti joins and aggregates; each gives the rows that break a rule, and `require` fails on any."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class InputError(ValueError):
    """An input that the conversion refuses."""


def require(violations: DataFrame, message: str, order: str | None = None) -> None:
    """Fail on any row; with order, tell of the first by that column."""
    row = (violations.orderBy(order) if order else violations).limit(1).collect()
    if row:
        raise InputError(f"{message}: {row[0].asDict()}")


def scattered(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names whose rows are not contiguous in a dense order, with their first row."""
    return rows.groupBy(name).agg(F.min(order).alias("first"), (F.max(order) - F.min(order) + 1).cast("long").alias("span"), F.count(F.lit(1)).alias("n")).where("span <> n")


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that known lacks."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def conflicting(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted: side, and the columns."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).union(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))
