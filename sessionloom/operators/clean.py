"""Imputation, capping, redundancy filters, scaling, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import columns as C
from sessionloom.operators.profile import correlation_pairs
from sessionloom.operators.structure import align_and_union, numeric_columns
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import PREFERRED_OF_PAIR, PROTECTED_COLUMNS, UPPER_CAPS


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def impute(df: DataFrame, exact: bool = True, fill: str = "unknown", skip: tuple[str, ...] = ()) -> DataFrame:
    """Numeric NULLs take the column median, text NULLs take ``fill``; all in one projection.

    Medians are computed only for columns that have a NULL.
    """
    numeric = numeric_columns(df, skip)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first() if numeric else {}
    gaps = [c for c in numeric if nulls[c]]
    medians = {c: q[0] for c, q in quantiles(df, gaps, [0.5], exact=exact).items()} if gaps else {}
    kinds = dict(df.dtypes)
    changes: dict[str, Column] = {}
    for c, m in medians.items():
        if m is not None:
            # an integer column widens to double when its median is fractional
            whole = kinds[c] in ("tinyint", "smallint", "int", "bigint") and float(m).is_integer()
            changes[c] = F.coalesce(F.col(c), F.lit(int(m)).cast(kinds[c])) if whole else F.coalesce(F.col(c).cast("double"), F.lit(m))
    changes.update({c: F.coalesce(F.col(c), F.lit(fill)) for c in string_columns(df) if c not in skip})
    return df.withColumns(changes) if changes else df


def combine_and_impute(a: DataFrame, b: DataFrame, exact: bool = True) -> DataFrame:
    """Fixed-column union, infinities to NULL, medians and 'unknown' for what is missing."""
    both = align_and_union(a, b)
    floats = [f.name for f in both.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    both = both.withColumns({c: C.null_if_infinite(C.null_if_nan(F.col(c))) for c in floats})
    return impute(both, exact=exact)


def cap_extremes(df: DataFrame, caps: dict[str, float] = UPPER_CAPS) -> DataFrame:
    return df.withColumns({c: C.clip(F.col(c), high=v) for c, v in caps.items() if c in df.columns})


def column_to_drop(a: str, b: str) -> str:
    keep = PREFERRED_OF_PAIR.get(frozenset({a, b}))
    if keep:
        return b if keep == a else a
    if (a in PROTECTED_COLUMNS) != (b in PROTECTED_COLUMNS):
        return b if a in PROTECTED_COLUMNS else a
    return max(a, b)


def correlated_drops(df: DataFrame, threshold: float = 0.98, columns: list[str] | None = None) -> tuple[list[str], list[tuple]]:
    """(columns to drop, protected pairs kept). Every pair is judged on the original columns."""
    columns = columns or numeric_columns(df, ("label",))
    pairs = correlation_pairs(df, columns).filter(F.abs("correlation") > threshold).collect()
    drops, kept = set(), []
    for r in pairs:
        a, b = r["feature_a"], r["feature_b"]
        if a in PROTECTED_COLUMNS and b in PROTECTED_COLUMNS:
            kept.append((a, b, abs(r["correlation"])))
        else:
            drops.add(column_to_drop(a, b))
    return sorted(drops), kept


def duplicate_column_pairs(df: DataFrame, key: str, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """Pairs of same-typed columns equal in every row.

    One pass folds (row key, value) hashes per column; only pairs with equal folds are
    compared value by value.
    """
    columns = columns or [c for c in df.columns if c != key]
    folds = df.agg(*[F.bit_xor(F.xxhash64(F.col(key), F.col(c).cast("string"))).alias(c) for c in columns]).first()
    kinds = dict(df.dtypes)
    suspects = [
        (a, b)
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
        if folds[a] == folds[b] and kinds[a] == kinds[b]
    ]
    if not suspects:
        return []
    sure = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"s{i}") for i, (a, b) in enumerate(suspects)]).first()
    return [p for i, p in enumerate(suspects) if sure[f"s{i}"]]


def drop_correlated(df: DataFrame, threshold: float = 0.98) -> tuple[DataFrame, dict]:
    drops, kept = correlated_drops(df, threshold)
    return df.drop(*drops), {"threshold": threshold, "removed": drops, "retained_protected_pairs": kept}


def drop_duplicate_columns(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    gone: list[str] = []
    for a, b in duplicate_column_pairs(df, key):
        if a not in gone and b not in gone:
            gone.append(column_to_drop(a, b))
    return df.drop(*gone), gone


def robust_scale(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(x - median) / (q75 - q25); a zero range scales by 1."""
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    changes = {}
    for c in columns:
        q1, q2, q3 = cuts[c]
        if q2 is not None:
            changes[c] = (F.col(c).cast("double") - F.lit(q2)) / F.lit((q3 - q1) or 1.0)
    return df.withColumns(changes)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std; a zero deviation scales by 1."""
    fit = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    ).first()
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c in columns}
    )


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes 0..k-1 of the sorted distinct texts; NULL counts as a text of its own.

    The code table is joined back, so a column with many values stays distributed.
    """
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        keyed = df.withColumn("_t", text)
        codes = codes_of(keyed.select("_t").distinct())
        df = keyed.join(codes, "_t").withColumn(c, F.col("_code")).drop("_t", "_code").select(*df.columns)
    return df


def codes_of(distinct: DataFrame) -> DataFrame:
    from sessionloom.operators.motion import id_ordinals

    return id_ordinals(distinct, "_t", "_code")
