"""Sharding by a Feistel permutation over global row numbers.

The rows get numbers 0..n-1 in a content order; a keyed permutation of 0..n-1 shuffles them, and a row's shard and slot
follow from its permuted number by arithmetic alone, so ``locate`` tells where row r lies without any table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import documents, numbered, with_columns

ROUNDS = 6
#: Steps of a cycle walk. The domain is at most sqrt(n) larger than n: below n = 4096 no walk can be longer, above it a
#: walk of this length has probability under 64**-64; a row that needed more would raise an error, never a wrong slot.
WALKS = 64


def domain(n: int) -> tuple[int, int]:
    """Two radices whose product is n or a little more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int) -> Column:
    """Position of a row number under the keyed permutation of 0..n-1, as an expression."""
    a, b = domain(n)

    def once(x: Column) -> Column:
        halves = [x % F.lit(a), F.floor((x - x % F.lit(a)) / F.lit(a)).cast("long")]
        for i in range(ROUNDS):
            size = (a, b)[i % 2]
            drawn = F.xxhash64(F.lit(seed).cast("long"), F.lit(i).cast("long"), halves[1 - i % 2])
            halves[i % 2] = F.pmod(halves[i % 2] + F.pmod(drawn, F.lit(size).cast("long")), F.lit(size).cast("long"))
        return halves[0] + halves[1] * F.lit(a).cast("long")

    first = once(number.cast("long"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), first, lambda y, _: F.when(y < n, y).otherwise(once(y))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def locate(number: Column, n: int, shards: int, seed: int = 17) -> tuple[Column, Column]:
    """Shard and slot of a global row number: rows take turns, so shard sizes differ by one at most."""
    y = permuted(number, n, seed)
    return (y % F.lit(shards)).cast("int"), F.floor(y / F.lit(shards)).cast("long")


def shard_rows(df: DataFrame, order: list[str], shards: int = 8, seed: int = 17) -> DataFrame:
    """Every row with its ``row_number``, ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    Row numbers follow ``order``; name columns that tell rows apart, then the placement depends on the content alone.
    Nulls come first; rows equal in all of ``order`` get neighbouring numbers in the order they are read. An
    empty table stays empty. Columns of the input that have a name of the output are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows, n = numbered(df, [F.col(f"`{c}`") for c in order], "row_number", "shard-rows")
    shard, slot = locate(F.col("row_number"), max(n, 1), shards, seed)
    placed = with_columns(rows, __place=F.struct(shard.alias("shard"), slot.alias("slot")))
    return with_columns(placed, shard=F.col("__place.shard"), slot=F.col("__place.slot")).drop("__place")


def op6_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dealt into 8 shards under the law ``rows``. A null text has size 1 and checksum 0."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, folder).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    return shard_rows(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
