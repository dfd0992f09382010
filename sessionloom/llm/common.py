"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.session import materialise

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python stages that run inside get batches of so many rows: what a worker holds is a batch and what it makes of it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; a column of the input that has one of these names (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, order: Sequence[Column], number: str, purpose: str) -> tuple[DataFrame, int]:
    """Rows with their rank from 0 in a global order, and how many there are.

    A range exchange deals the rows into ordered partitions, whose table is written once: the ranges are
    drawn from a sample, so computing them again could cut elsewhere. Only one count per partition is summed up
    in a single place. Rows that tie in ``order`` are ranked in the order they were read.
    """
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    tie = F.monotonically_increasing_id()
    ranged = (
        df.select("*", *[c.alias(k) for k, c in keys.items()], tie.alias("__tie"))
        .repartitionByRange(*keys, "__tie")
        .sortWithinPartitions(*keys, "__tie")
        .drop(*keys, "__tie")
    )
    place = F.monotonically_increasing_id()
    written = materialise(
        ranged.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__place")), purpose
    )
    counts = materialise(written.groupBy("__part").agg(F.count("*").alias("__n")), purpose + "-counts")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # one row per partition of the exchange: small whatever the number of rows
    out = written.join(F.broadcast(starts), "__part")
    return with_columns(out, **{number: F.col("__start") + F.col("__place")}).drop("__part", "__start", "__place"), int(total)


def unit_draw(*key: Column, salt: str) -> Column:
    """A reproducible draw strictly between 0 and 1 from a row's key: the first 48 bits of a SHA-256."""
    text = F.concat_ws("|", *key, F.lit(salt))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
