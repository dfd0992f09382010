"""Aggregates, correlations and data-quality profiles as metric tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions import columns as C
from sessionloom.operators.structure import head_per_class, numeric_columns, top_counts
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import LABEL_NAMES

PAIRS_PER_AGGREGATE = 100


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def local_rows(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


# --- counts ------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str, normalise: bool = False) -> DataFrame:
    """Counts per non-null value, with shares rounded to 6 when asked."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if not normalise:
        return counts
    total = df.filter(F.col(column).isNotNull()).agg(F.count("*")).first()[0]
    return counts.withColumn("share", F.bround(F.col("n") / F.lit(max(total, 1)), 6))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    f = F.countDistinct if exact else F.approx_count_distinct
    return unpivot_row(df.agg(*[f(c).alias(c) for c in columns]), columns, "column", "n_distinct")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per column in one pass."""
    columns = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return unpivot_row(one, columns, "column", "n_null")


def unpivot_row(one: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """One-row aggregate to (name, value) rows."""
    cells = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def duplicate_counts(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows beyond the first per key (or per whole row): groups combine map-side."""
    cols = [key] if key else df.columns
    groups = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def grouped_means(df: DataFrame, by: str, columns: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(by).agg(*[F.bround(F.avg(c), digits).alias(c) for c in columns])


def grouped_describe(df: DataFrame, by: str, columns: list[str], exact: bool = True) -> DataFrame:
    """count/mean/std/min/25/50/75/max per class and column, one row each."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    basic = (
        df.filter(F.col(by).isNotNull())
        .select(F.col(by), cells)
        .groupBy(by, "feature")
        .agg(
            F.count("v").alias("count"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
    )
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], by=by, exact=exact)
    rows = [(g, c, *map(_float, q)) for g, per in cuts.items() for c, q in per.items()]
    table = local_rows(df, rows, "g string, feature string, p25 double, p50 double, p75 double")
    joined = basic.join(F.broadcast(table), (basic[by].cast("string") == table["g"]) & (basic["feature"] == table["feature"]), "left")
    return joined.select(
        basic[by], basic["feature"], "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def _float(x):
    return None if x is None else float(x)


def crosstab(df: DataFrame, rows: str, cols: str, values: list, normalise: bool = False, prefix: str = "") -> DataFrame:
    """Counts of (rows x cols); the column values are given so no extra pass looks for them."""
    table = df.filter(F.col(rows).isNotNull()).groupBy(rows).pivot(cols, values).count().na.fill(0)
    names = [f"{prefix}{v}" for v in values]
    out = table.select(rows, *[F.col(str(v)).alias(n) for v, n in zip(values, names)])
    if not normalise:
        return out
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.select(rows, *[(F.col(n) / total).alias(n) for n in names])


def feature_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean / population std / min / max of every numeric column."""
    columns = columns or numeric_columns(df)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(cells).groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def top_variances(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    one = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    return unpivot_row(one, columns, "feature", "variance").orderBy(F.desc_nulls_last("variance"), "feature").limit(k)


def global_quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True) -> DataFrame:
    cuts = quantiles(df, columns, probs, exact=exact)
    rows = [(c, p, _float(v)) for c in columns for p, v in zip(probs, cuts[c])]
    return local_rows(df, rows, "feature string, prob double, value double")


# --- correlation -------------------------------------------------------------------------


def pair_aggregate(df: DataFrame, pairs: list[tuple[str, str]], f, name: str) -> DataFrame:
    """One aggregate expression per column pair, in slices small enough for code generation."""
    frames = []
    for at in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        part = pairs[at : at + PAIRS_PER_AGGREGATE]
        one = df.agg(*[f(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(part)])
        cells = [
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias(name))
            for i, (a, b) in enumerate(part)
        ]
        frames.append(one.select(F.inline(F.array(*cells))))
    return union_all(frames)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, pairs=None) -> DataFrame:
    """Pearson r of column pairs over rows where both are present; undefined ones dropped."""
    columns = columns or numeric_columns(df)
    pairs = pairs or list(combinations(columns, 2))
    return pair_aggregate(df, pairs, C.correlation, "correlation").filter("correlation is not null")


def top_correlations(df: DataFrame, columns: list[str] | None = None, k: int = 10, absolute: bool = True) -> DataFrame:
    out = correlation_pairs(df, columns)
    size = F.abs("correlation")
    # strength is compared at 9 decimals so that equal pairs tie by name, not by rounding noise
    ranked = out.orderBy(F.desc(F.round(size, 9)), "feature_a", "feature_b").limit(k)
    return ranked.withColumn("correlation", size) if absolute else ranked


def covariance_pairs(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Sample covariances (a <= b in column order) after filling NULLs with the median."""
    medians = {c: q[0] for c, q in quantiles(df, columns, [0.5], exact=exact).items()}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return pair_aggregate(filled, pairs, F.covar_samp, "covariance")


# --- outliers ----------------------------------------------------------------------------


def iqr_outliers(df: DataFrame, columns: list[str], skip_flat: bool = True, exact: bool = True) -> DataFrame:
    """Values strictly outside q1 - 1.5 iqr, q3 + 1.5 iqr per column.

    ``skip_flat`` reports 0 for a zero range (validation form); without it the range test
    still runs and only columns with hits are kept (integration form).
    """
    cuts = quantiles(df, columns, [0.25, 0.75], exact=exact)
    aggs = []
    for c in columns:
        q1, q3 = cuts[c]
        if q1 is None or (skip_flat and q3 == q1):
            aggs.append(F.lit(0).cast("long").alias(c))
            continue
        reach = 1.5 * (q3 - q1)
        x = F.col(c).cast("double")
        aggs.append(F.count_if((x < q1 - reach) | (x > q3 + reach)).alias(c))
    out = unpivot_row(df.agg(F.count("*").alias("_n"), *aggs), columns, "feature", "n_outliers")
    return out if skip_flat else out.filter("n_outliers > 0")


def threshold_count(df: DataFrame, column: str, prob: float = 0.97, exact: bool = True) -> DataFrame:
    """The quantile and how many values reach it."""
    cut = quantiles(df, [column], [prob], exact=exact)[column][0]
    hit = F.col(column) >= F.lit(cut)
    return df.agg(F.lit(float(cut)).alias("threshold"), F.count_if(hit).alias("outlier_count"))


# --- reports -----------------------------------------------------------------------------

METRIC = "section string, item string, value string"


def _metrics(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))


def label_counts(df: DataFrame, section: str = "label_counts") -> DataFrame:
    return _metrics(value_counts(df, "label"), section, F.col("label"), F.col("n"))


def inspect_table(df: DataFrame, key_words: tuple[str, ...] = (
    "user_id", "session_id", "timestamp", "category", "label", "user", "session", "time", "type", "class",
)) -> DataFrame:
    """Shape, types, candidate keys with distinct and null counts, label columns."""
    names = df.columns
    keys = [c for c in names if any(w in c.lower() for w in key_words)]
    labels = [c for c in names if "label" in c.lower() or "category" in c.lower()]
    static = [("shape", "columns", str(len(names)))]
    static += [("dtype", c, t) for c, t in df.dtypes]
    static += [("label_column", c, "true") for c in labels]
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.countDistinct(c).alias(f"d_{c}") for c in keys],
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in keys],
    )
    cells = [F.struct(F.lit("shape").alias("section"), F.lit("rows").alias("item"), F.col("rows").cast("string").alias("value"))]
    for c in keys:
        cells.append(F.struct(F.lit("key_distinct").alias("section"), F.lit(c).alias("item"), F.col(f"d_{c}").cast("string").alias("value")))
        cells.append(F.struct(F.lit("key_null").alias("section"), F.lit(c).alias("item"), F.col(f"n_{c}").cast("string").alias("value")))
    return local_rows(df, static, METRIC).unionByName(counted.select(F.inline(F.array(*cells))))


def inspect_clicks(clicks: DataFrame) -> DataFrame:
    """Rows, nulls, time range, top-10 shares and counts, distinct counts."""
    total = clicks.agg(F.count("*")).first()[0]
    span = clicks.agg(
        F.min("click_time").cast("string").alias("click_time_min"), F.max("click_time").cast("string").alias("click_time_max")
    )
    frames = [
        local_rows(clicks, [("rows", "rows", str(total))], METRIC),
        _metrics(null_counts(clicks), "nulls", F.col("column"), F.col("n_null")),
        _metrics(unpivot_row(span, span.columns, "k", "v"), "range", F.col("k"), F.col("v")),
    ]
    for c in ("app", "device", "os", "channel", "is_attributed"):
        present = clicks.agg(F.count(c)).first()[0]
        share = F.format_string("%.6f", F.bround(F.col("n") / F.lit(max(present, 1)), 6))
        frames.append(_metrics(top_counts(clicks, c), f"share:{c}", F.col(c), share))
    distinct = distinct_counts(clicks, ["ip", "device", "app", "channel"])
    frames.append(_metrics(distinct, "distinct", F.col("column"), F.col("n_distinct")))
    for c in ("ip", "device", "app"):
        frames.append(_metrics(top_counts(clicks, c), f"top:{c}", F.col(c), F.col("n")))
    return union_all(frames)


def validation_report(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Label counts, feature summary, top |r| pairs and outlier counts as one metric table."""
    summary = feature_summary(df, columns)
    six = lambda c: F.format_string("%.6f", F.col(c) + F.lit(3e-8))
    frames = [label_counts(df)]
    frames += [_metrics(summary, f"summary:{c}", F.col("feature"), six(c)) for c in ("mean", "std", "min", "max")]
    pairs = top_correlations(df, columns)
    frames.append(_metrics(pairs, "correlation", F.concat_ws("|", "feature_a", "feature_b"), six("correlation")))
    frames.append(_metrics(iqr_outliers(df, columns, exact=exact), "outliers", F.col("feature"), F.col("n_outliers")))
    return union_all(frames)


def integration_report(df: DataFrame, source: str = "talkingdata") -> DataFrame:
    """Label counts, three sample rows per known class, sessions of one source."""
    samples = head_per_class(df.filter(F.col("label").isin(*LABEL_NAMES)))
    origin = df.filter(F.col("data_source") == source).agg(F.count("*").alias("n"))
    return union_all(
        [
            label_counts(df),
            _metrics(samples, "sample", F.col("session_id"), F.concat_ws("|", "label", "data_source", "bot_type")),
            _metrics(origin, "source_sessions", F.lit(source), F.col("n")),
        ]
    )


def integration_report_long(df: DataFrame, clicks: DataFrame, events: DataFrame, pairs: list[tuple[str, str]], means: list[str], exact: bool = True) -> DataFrame:
    """Click inspection plus balance, nulls, outliers, correlations, class means and integrity flags."""
    numeric = numeric_columns(df)
    usable = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    r = correlation_pairs(df, pairs=usable)
    dup = duplicate_counts(df, "session_id")
    six = lambda c: F.format_string("%.6f", F.col(c) + F.lit(3e-8))
    outliers = iqr_outliers(df, numeric, skip_flat=False, exact=exact).orderBy(F.desc("n_outliers"), "feature").limit(20)
    by_label = grouped_means(df, "label", means)
    frames = [
        inspect_clicks(clicks),
        label_counts(events, "event_labels"),
        label_counts(df, "class_balance"),
        _metrics(value_counts(df, "data_source"), "source_balance", F.col("data_source"), F.col("n")),
        _metrics(null_counts(df).filter("n_null > 0"), "missing", F.col("column"), F.col("n_null")),
        _metrics(outliers, "outliers", F.col("feature"), F.col("n_outliers")),
        _metrics(r, "correlation", F.concat_ws("__", "feature_a", "feature_b"), six("correlation")),
        _metrics(dup, "integrity", F.lit("duplicate_session_ids"), F.col("n_duplicates")),
        _metrics(df.agg(F.count_if(F.col("label").isNull()).alias("n")), "integrity", F.lit("missing_labels"), F.col("n")),
    ]
    frames += [_metrics(by_label, f"mean:{c}", F.col("label"), F.format_string("%.4f", F.col(c))) for c in means]
    return union_all(frames)


def verify_cleanup(before: DataFrame, after: DataFrame, expected: dict[int, int] | None = None, key: str = "session_id") -> DataFrame:
    """Row and label counts unchanged (and as expected), labels identical per id, no NULL left."""
    a = before.groupBy("label").agg(F.count("*").alias("n_before"))
    b = after.groupBy("label").agg(F.count("*").alias("n_after"))
    rows = a.join(b, a["label"].eqNullSafe(b["label"]), "full_outer").select(a["label"].alias("la"), "n_before", "n_after").collect()
    counts_before = {r["la"]: r["n_before"] for r in rows if r["n_before"]}
    same_counts = all(r["n_before"] == r["n_after"] for r in rows)
    total_same = sum(r["n_before"] or 0 for r in rows) == sum(r["n_after"] or 0 for r in rows)
    if expected is not None:
        same_counts = same_counts and counts_before == expected
        total_same = total_same and sum(counts_before.values()) == sum(expected.values())
    la, lb = before.select(key, "label"), after.select(key, "label")
    same_labels = la.exceptAll(lb).isEmpty() and lb.exceptAll(la).isEmpty()
    no_nulls = not after.filter(" or ".join(f"`{c}` is null" for c in after.columns)).limit(1).count()
    checks = {
        "row_count_unchanged": total_same,
        "label_counts_unchanged": same_counts,
        "label_column_unchanged": same_labels,
        "missing_values_zero": no_nulls,
    }
    checks["verification_passed"] = all(checks.values())
    return local_rows(before, [(k, bool(v)) for k, v in checks.items()], "check string, passed boolean")


def validate_dataset(df: DataFrame) -> DataFrame:
    """Rows, columns, class distribution, total NULLs."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    one = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), nulls.alias("missing_values"))
    shape = unpivot_row(one.select(*[F.col(c).cast("long") for c in one.columns]), one.columns, "k", "v")
    return _metrics(shape, "dataset", F.col("k"), F.col("v")).unionByName(label_counts(df, "class_distribution"))


def balance_report(before: DataFrame, after: DataFrame) -> DataFrame:
    return label_counts(before, "before").unionByName(label_counts(after, "after"))


# --- data behind plots -------------------------------------------------------------------


def histogram_density(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width density bins per class: n / (rows * width). Bounds join back one row per class."""
    rows = df.filter(F.col(column).isNotNull()).withColumn("_g", F.col(by) if by else F.lit("all"))
    rows = rows.filter(F.col("_g").isNotNull())
    x = F.col(column).cast("double")
    bounds = rows.groupBy("_g").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_total"))
    binned = rows.join(bounds, "_g").groupBy(
        "_g", "_lo", "_hi", "_total", C.equal_width_bin(x, F.col("_lo"), F.col("_hi"), bins).alias("bin")
    ).agg(F.count("*").alias("n"))
    width = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("_hi") - F.col("_lo")) / bins)
    return binned.select(F.col("_g").alias(by or "class"), "bin", "n", (F.col("n") / (F.col("_total") * width)).alias("density"))


def box_stats(df: DataFrame, column: str, by: str, exact: bool = True) -> DataFrame:
    """Quartiles and whiskers (last value within 1.5 iqr) per class."""
    cuts = quantiles(df, [column], [0.25, 0.5, 0.75], by=by, exact=exact)
    rows = [(g, *map(_float, per[column])) for g, per in cuts.items()]
    table = local_rows(df, rows, "_g string, q1 double, median double, q3 double")
    x = F.col(column).cast("double")
    joined = df.join(F.broadcast(table), F.col(by).cast("string") == F.col("_g"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(x >= F.col("q1") - reach, x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("q3") + reach, x)).alias("whisker_high"),
    )


def class_counts(df: DataFrame, names: dict[int, str] = LABEL_NAMES) -> DataFrame:
    """Counts and shares in fixed label order; a class without rows shows 0."""
    fixed = local_rows(df, [(i, k, v) for i, (k, v) in enumerate(names.items())], "position int, label int, label_name string")
    counts = df.filter(F.col("label").isin(*names)).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    out = fixed.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return out.select("position", "label_name", "n", F.try_divide(F.col("n"), total).alias("share"))


def top_categories_by_label(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """Label counts of the k most frequent categories (k rows: safe to broadcast)."""
    filled = df.withColumn(column, F.coalesce(F.col(column), F.lit("unknown")))
    top = top_counts(filled, column, k).select(column)
    return filled.join(F.broadcast(top), column).groupBy(column, "label").agg(F.count("*").alias("n"))
