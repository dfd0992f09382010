"""Schema alignment, defaults, filters, joins, set operations and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sessionloom.functions import columns as C
from sessionloom.functions.score import bot_score
from sessionloom.schema import BINARY_COLUMNS, LABEL_NAMES, SESSION_SCHEMA


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def align_schema(df: DataFrame, schema: T.StructType = SESSION_SCHEMA, defaults: bool = True) -> DataFrame:
    """Canonical columns first (absent ones NULL), extra columns after, then the default chain."""
    present = set(df.columns)
    kinds = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        kind = kinds[field.name]
        # a text channel stays text; numbers are brought to the canonical width
        if kind == field.dataType or (isinstance(kind, T.StringType) and not isinstance(field.dataType, T.StringType)):
            return F.col(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    names = set(schema.fieldNames())
    extras = [c for c in df.columns if c not in names]
    out = df.select(*[column(f) for f in schema], *extras)
    return fill_session_defaults(out) if defaults else out


def fill_session_defaults(df: DataFrame) -> DataFrame:
    """Chain of fallbacks between the count columns; the order of the steps matters."""
    zero = F.lit(0)
    clicks = F.coalesce("click_count", "total_requests", zero)
    first = df.withColumns(
        {
            "label": F.coalesce(F.col("label"), F.lit(-1)),
            "data_source": F.coalesce("data_source", F.lit("unknown")),
            "candidate_human": F.coalesce("candidate_human", F.lit(False)),
            "click_count": clicks,
        }
    )
    second = first.withColumns(
        {
            "bot_type": F.coalesce(F.col("bot_type"), C.recode(F.col("label"), LABEL_NAMES)),
            "total_requests": F.coalesce("total_requests", "click_count"),
            "total_movements": F.coalesce("total_movements", "click_count"),
            "successful_requests": F.coalesce("successful_requests", "install_count", zero),
            "logs_count": F.coalesce("logs_count", "click_count"),
            "install_count": F.coalesce("install_count", zero),
            "is_proxy": F.coalesce("is_proxy", zero),
        }
    )
    third = second.withColumn(
        "success_rate",
        F.coalesce("success_rate", C.success_rate(F.col("successful_requests"), F.col("total_requests"))),
    )
    return third.withColumn("bot_likelihood_score", bot_score(third))


def with_defaults(df: DataFrame, rules: dict[str, Column | float | str]) -> DataFrame:
    """Add each column only when it is absent; NULLs in a present column are kept."""
    for name, rule in rules.items():
        if name not in df.columns:
            df = df.withColumn(name, rule if isinstance(rule, Column) else F.lit(rule))
    return df


def align_and_union(a: DataFrame, b: DataFrame, columns: list[str] = BINARY_COLUMNS) -> DataFrame:
    """Union by name over a fixed list; a column missing on both sides is NULL."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*[F.col(c) if c in both.columns else F.lit(None).cast("double").alias(c) for c in columns])


def numeric_or_original_median(df: DataFrame, columns: list[str], medians: dict[str, float]) -> DataFrame:
    """Cast to double, unreadable values take the median of the original table."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(medians[c])) for c in columns})


def keep_listed(df: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def keep_unlisted(df: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def min_group_size(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows of groups with at least ``least`` rows (counts combine map-side, then a semi join)."""
    big = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(big, key, "left_semi")


def join_replacing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where the right side's columns win over same-named left ones."""
    overlap = [c for c in right.columns if c in left.columns and c != key]
    return left.drop(*overlap).join(right, key, "left")


def group_totals(df: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """Group aggregates on every row: aggregate map-side, then join back (AQE splits a hot key)."""
    agg = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(agg, key)


def cycle_rows(base: DataFrame, needed: int, index: str) -> DataFrame:
    """``needed`` rows, the i-th cloned from the base row with index ``i % n`` (index from 0)."""
    n = base.count()
    if n == 0:
        raise ValueError("cannot cycle over an empty table")
    targets = base.sparkSession.range(needed).select(F.col("id").alias("clone"), (F.col("id") % n).alias(index))
    return targets.join(base, index)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in an explicit order.

    ``min_by`` over the row struct combines map-side, so many copies of one key never
    gather in one task (a row_number window would shuffle them all first).
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])


def replace_class(df: DataFrame, replacement: DataFrame, label: int) -> DataFrame:
    """Swap all rows of one class for another set; ids already present win in that order."""
    rest = df.filter(~F.col("label").eqNullSafe(F.lit(label)))
    both = replacement.withColumn("_src", F.lit(0)).unionByName(rest.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, "session_id", ["_src"]).drop("_src")


def merge_sources(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Align both sides, union, keep the first row per session id (primary before secondary)."""
    a = align_schema(primary).withColumn("_src", F.lit(0))
    b = align_schema(secondary).withColumn("_src", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return first_per_key(both, "session_id", ["_src", "session_start"]).drop("_src")


def head_per_class(df: DataFrame, label: str = "label", n: int = 3, order: str = "session_id") -> DataFrame:
    """First n rows per class; the row_number filter is trimmed map-side by WindowGroupLimit."""
    w = W.partitionBy(label).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values, ties by value (TakeOrderedAndProject, no full sort)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
