"""Row ranks and equal-frequency strata that never sort a whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.chunks import order_chunks, ranked, running_total
from sessionloom.plans.cuts import rank_slots

__all__ = ["average_rank", "decile_strata", "frequency_strata", "ranked"]


def average_rank(df: DataFrame, value: str, name: str, pct: bool = False) -> DataFrame:
    """Rank with ties averaged (NULL for NULL and NaN).

    Ranks are found on distinct values with counts and joined back on the value.
    """
    usable = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).isNotNull()
    counts = df.filter(usable).groupBy(value).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    totals = running_total(order_chunks(counts, value), ["_all"], [value], {"_upto": "_n"})
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    table = totals.select(value, (rank / F.col("_upto_total") if pct else rank).alias(name))
    return df.join(table, value, "left")


def decile_strata(df: DataFrame, values: dict[str, str], key: str, by: str | None = None) -> DataFrame:
    """Percentile rank (ties by key hash) rounded half-even to one decimal, as an int 0..10."""

    def ranks(n: int) -> list[int]:
        out = []
        for d in range(10):
            # largest r whose 10 r / n rounds half-even to at most d
            r, rest = divmod(n * (2 * d + 1), 20)
            out.append(r - 1 if rest == 0 and d % 2 else r)
        return out

    return rank_slots(df, values, key, ranks, by)


def frequency_strata(df: DataFrame, values: dict[str, str], key: str, bins: int = 5) -> DataFrame:
    """Equal-frequency bins 1..q of the first-come rank, q = min(bins, distinct values).

    Bin b ends at rank 1 + floor(b (n-1) / q), the interpolated quantile edge.
    """
    by_q: dict[int, dict[str, str]] = {}
    for value, name in values.items():
        q = df.filter(F.col(value).isNotNull()).select(value).distinct().limit(bins).count()
        by_q.setdefault(max(q, 1), {})[value] = name
    for q, part in by_q.items():
        edges = lambda n, q=q: [1 + (b * (n - 1)) // q for b in range(1, q)] if n > 1 else []
        df = rank_slots(df, part, key, edges)
        df = df.withColumns({name: F.col(name) + 1 for name in part.values()})
    return df
