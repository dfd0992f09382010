"""Queries for aggregates over the session table, quality reports and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.base import (
    CLICKS, H, PROXY, R, Rs, S, clicks, ev_sql, events, prof, profiled, query, rounded, sess, stamp,
)
from sessionloom.catalog.events import BUSY, BUSY_FLAGS, FEATURES as EVENT_FEATURES, busy_clicks
from sessionloom.catalog.prepare import CORR, FEATURES, IQR, corr_sql, iqr_sql
from sessionloom.operators import density, gram, profile, sampling, sessions
from sessionloom.schema import LABEL_NAMES, MODEL_ID_COLUMNS

FIVE = FEATURES[:5]


@query("agg09_value_counts", f"WITH {CLICKS} SELECT channel, count(*) AS n FROM clicks GROUP BY channel")
def _(spark, folder):
    return profile.value_counts(clicks(spark, folder), "channel")


@query("agg09_value_shares", f"WITH {CLICKS} SELECT app, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM clicks GROUP BY app")
def _(spark, folder):
    return profile.value_counts(clicks(spark, folder), "app", normalise=True)


@query("agg10_distinct_counts", f"WITH {CLICKS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM clicks" for c in ("ip", "device", "app", "channel")))
def _(spark, folder):
    return profile.distinct_counts(clicks(spark, folder), ["ip", "device", "app", "channel"])


@query("agg11_null_counts", prof(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM sc" for c in ("session_id", "click_interval_std", "label", "channel"))))
def _(spark, folder):
    return profile.null_counts(profiled(spark, folder), ["session_id", "click_interval_std", "label", "channel"])


@query("agg12_duplicate_counts", f"WITH {CLICKS} SELECT count(*) AS n_rows, count(*) - count(DISTINCT (ip, channel, app)) AS n_duplicates FROM clicks")
def _(spark, folder):
    return profile.duplicate_counts(clicks(spark, folder).select("ip", "channel", "app"))


@query("agg13_grouped_means", prof(f"SELECT label, {', '.join(f'round({c}, 4) AS {c}' for c in FIVE)} FROM (SELECT label, {', '.join(f'avg({c}) AS {c}' for c in FIVE)} FROM sc GROUP BY label)"))
def _(spark, folder):
    return profile.grouped_means(profiled(spark, folder), "label", FIVE)


@query(
    "agg14_grouped_describe",
    prof(" UNION ALL ".join(
        f"""SELECT label, '{c}' AS feature, count({c}) AS count, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, {R(f'min({c})', 4)} AS min,
  {R(f'quantile_cont({c}, 0.25)', 4)} AS p25, {R(f'quantile_cont({c}, 0.5)', 4)} AS p50, {R(f'quantile_cont({c}, 0.75)', 4)} AS p75, {R(f'max({c})', 4)} AS max FROM sc GROUP BY label"""
        for c in ("mouse_speed_mean", "click_interval_entropy", "requests_per_minute"))),
)
def _(spark, folder):
    out = profile.grouped_describe(profiled(spark, folder), "label", ["mouse_speed_mean", "click_interval_entropy", "requests_per_minute"])
    return rounded(out, 4)


@query(
    "agg15_crosstab",
    prof("SELECT channel, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2 FROM sc GROUP BY channel"),
)
def _(spark, folder):
    return profile.crosstab(profiled(spark, folder), "channel", "label", [0, 1, 2], prefix="label_")


@query(
    "agg15_crosstab_normalised",
    prof(f"SELECT channel, {', '.join(R(f'count(*) FILTER (WHERE label = {k})::DOUBLE / count(*)') + f' AS label_{k}' for k in range(3))} FROM sc GROUP BY channel"),
)
def _(spark, folder):
    return rounded(profile.crosstab(profiled(spark, folder), "channel", "label", [0, 1, 2], normalise=True, prefix="label_"))


SUMMARY = FEATURES[:8]


@query(
    "agg16_feature_summary",
    prof(" UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_pop({c})', 4)} AS std, {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max FROM sc" for c in SUMMARY)),
)
def _(spark, folder):
    return rounded(profile.feature_summary(profiled(spark, folder), SUMMARY), 4)


PROBS = [0.01, 0.05, 0.10, 0.25, 0.75, 0.95, 0.97, 0.99]


@query(
    "agg17_global_quantiles",
    prof(" UNION ALL ".join(f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, {R(f'quantile_cont({c}::DOUBLE, {p})', 4)} AS value FROM sc" for c in FIVE for p in PROBS)),
)
def _(spark, folder):
    return rounded(profile.global_quantiles(profiled(spark, folder), FIVE, PROBS), 4)


@query(
    "agg18_medians",
    prof(" UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS value FROM sc" for c in FEATURES)),
)
def _(spark, folder):
    return rounded(profile.global_quantiles(profiled(spark, folder), FEATURES, [0.5]).drop("prob"), 4)


@query(
    "agg19_top_variances",
    prof("SELECT feature, " + R("v", 2) + " AS variance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v FROM sc" for c in FEATURES) + ") ORDER BY v DESC, feature LIMIT 5"),
)
def _(spark, folder):
    return rounded(profile.top_variances(profiled(spark, folder), FEATURES), 2)


@query("agg20_correlation_matrix", prof(f"SELECT feature_a, feature_b, {R('r')} AS correlation FROM {corr_sql(FEATURES[:8] + ['install_count'])}"))
def _(spark, folder):
    return rounded(profile.correlation_pairs(profiled(spark, folder), FEATURES[:8] + ["install_count"]))


WIDE = [c for c in FEATURES if c not in ("click_count", "direction_change_count")]


@query(
    "agg20_blocked_moments",
    prof(" UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, regr_count({a}, {b})::BIGINT AS n, {R(f'covar_samp({a}, {b})', 3)} AS covariance, {R(f'corr({a}, {b})')} AS correlation FROM sc"
        for i, a in enumerate(WIDE) for b in WIDE[i:]
    )),
)
def _(spark, folder):
    out = gram.pair_moments(profiled(spark, folder), WIDE)
    return rounded(out.drop("covariance")).join(rounded(out.select("feature_a", "feature_b", "covariance"), 3), ["feature_a", "feature_b"])


NAMED = [
    ("mouse_speed_mean", "mouse_path_length"), ("mouse_speed_std", "mouse_acceleration_std"), ("coordinate_entropy", "direction_change_count"),
    ("requests_per_minute", "label"), ("install_count", "label"),
]


def named_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} AS correlation FROM sc" for a, b in NAMED
    )


@query("agg21_named_correlations", prof(named_sql()))
def _(spark, folder):
    return rounded(profile.correlation_pairs(profiled(spark, folder), pairs=NAMED))


COV = ["click_interval_std", "requests_per_minute", "coordinate_entropy", "mouse_speed_std"]


@query(
    "agg22_covariance_matrix",
    prof(
        " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'covar_samp({a}, {b})', 3)} AS covariance FROM fi" for i, a in enumerate(COV) for b in COV[i:]),
        "fi AS (SELECT " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM sc)) AS {c}" for c in COV) + " FROM sc)",
    ),
)
def _(spark, folder):
    return rounded(profile.covariance_pairs(profiled(spark, folder), COV), 3)


@query("agg23_class_weights", prof(f"SELECT session_id, label, {R('n / (k * c::DOUBLE)')} AS weight FROM (SELECT session_id, label, count(*) OVER () AS n, count(*) OVER (PARTITION BY label) AS c, (SELECT count(DISTINCT label) FROM sc) AS k FROM sc)"))
def _(spark, folder):
    from sessionloom.operators.models import class_weights

    return rounded(class_weights(profiled(spark, folder)).select("session_id", "label", "weight"))


@query("srt03_top_correlations", prof(f"SELECT feature_a, feature_b, {R('abs(r)')} AS correlation FROM {corr_sql(FEATURES[:10])} ORDER BY round(abs(r), 9) DESC, feature_a, feature_b LIMIT 10"))
def _(spark, folder):
    return rounded(profile.top_correlations(profiled(spark, folder), FEATURES[:10]))


# --- reports -----------------------------------------------------------------------------


@query(
    "qlt01_inspect_table",
    """SELECT 'shape' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'shape', 'columns', '3'
UNION ALL SELECT 'dtype', * FROM (VALUES ('session_id', 'string'), ('category', 'string'), ('response_size', 'double'))
UNION ALL SELECT 'label_column', 'category', 'true'
UNION ALL SELECT 'key_distinct', 'session_id', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'key_null', 'session_id', '0'
UNION ALL SELECT 'key_distinct', 'category', count(DISTINCT o_orderpriority)::VARCHAR FROM orders UNION ALL SELECT 'key_null', 'category', '0'""",
)
def _(spark, folder):
    from sessionloom.sources import bindings

    return profile.inspect_table(bindings.requests(spark, folder).select("session_id", "category", "response_size"))


def share_rows(column: str) -> str:
    return f"SELECT 'share:{column}' AS section, {column}::VARCHAR AS item, printf('%.6f', round_even(n::DOUBLE / t, 6)) AS value FROM (SELECT {column}, count(*) AS n, sum(count(*)) OVER () AS t FROM clicks GROUP BY {column} ORDER BY n DESC, {column} LIMIT 10)"


def top_rows(column: str) -> str:
    return f"SELECT 'top:{column}', {column}::VARCHAR, n::VARCHAR FROM (SELECT {column}, count(*) AS n FROM clicks GROUP BY {column} ORDER BY n DESC, {column} LIMIT 10)"


CLICK_COLS = ["event_id", "ip", "app", "device", "os", "channel", "is_attributed"]


def inspect_sql() -> str:
    parts = [f"(SELECT 'rows' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM clicks)"]
    parts += [f"(SELECT 'nulls', '{c}', (count(*) - count({c}))::VARCHAR FROM clicks)" for c in CLICK_COLS + ["click_time"]]
    parts += [f"({share_rows(c)})" for c in ("app", "device", "os", "channel", "is_attributed")]
    parts += [f"(SELECT 'distinct', '{c}', count(DISTINCT {c})::VARCHAR FROM clicks)" for c in ("ip", "device", "app", "channel")]
    parts += [f"({top_rows(c)})" for c in ("ip", "device", "app")]
    parts += ["(SELECT 'range', 'click_time_min', min(ts)::VARCHAR FROM events)", "(SELECT 'range', 'click_time_max', max(ts)::VARCHAR FROM events)"]
    return " UNION ALL ".join(parts)


@query("qlt02_inspect_clicks", f"WITH {CLICKS} {inspect_sql()}")
def _(spark, folder):
    return profile.inspect_clicks(clicks(spark, folder))


def six(expr: str) -> str:
    return f"printf('%.4f', round({expr}, 4))"


REPORT = ["requests_per_minute", "session_duration_sec", "coordinate_entropy", "mouse_speed_mean", "click_count", "install_count"]


@query(
    "qlt03_validation_report",
    prof(
        "(SELECT 'label_counts' AS section, label::VARCHAR AS item, count(*)::DOUBLE AS value FROM sc GROUP BY label)"
        + "".join(
            f" UNION ALL (SELECT 'summary:{k}', '{c}', {R(f'{f}({c})', 3)} FROM sc)"
            for c in REPORT for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
        )
        + f" UNION ALL (SELECT 'correlation', feature_a || '|' || feature_b, {R('abs(r)', 3)} FROM {corr_sql(REPORT)} ORDER BY round(abs(r), 9) DESC, feature_a, feature_b LIMIT 10)"
        + f" UNION ALL (SELECT 'outliers', feature, n_outliers::DOUBLE FROM ({iqr_sql(REPORT, '')}))"
    ),
)
def _(spark, folder):
    out = profile.validation_report(profiled(spark, folder), REPORT)
    return out.select("section", "item", F.when(F.col("section").isin("label_counts", "outliers"), F.col("value").cast("double")).otherwise(
        F.round(F.col("value").cast("double") + F.lit(3e-5), 3)
    ).alias("value"))


@query(
    "qlt04_integration_report",
    prof("""(SELECT 'label_counts' AS section, label::VARCHAR AS item, count(*)::VARCHAR AS value FROM sc GROUP BY label)
UNION ALL (SELECT 'sample', session_id, label || '|talkingdata|' || CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'moderate_bot' ELSE 'advanced_bot' END
  FROM (SELECT session_id, label, row_number() OVER (PARTITION BY label ORDER BY session_id) AS r FROM sc) WHERE r <= 3)
UNION ALL (SELECT 'source_sessions', 'talkingdata', count(*)::VARCHAR FROM sc)"""),
)
def _(spark, folder):
    from sessionloom.functions.columns import recode

    df = profiled(spark, folder).withColumns({"data_source": F.lit("talkingdata"), "bot_type": recode(F.col("label"), LABEL_NAMES)})
    return profile.integration_report(df)


LONG_MEANS = ["mouse_speed_mean", "requests_per_minute"]


@query(
    "qlt05_integration_report_long",
    prof(
        inspect_sql()
        + " UNION ALL (SELECT 'event_labels', label::VARCHAR, count(*)::VARCHAR FROM fl GROUP BY label)"
        + " UNION ALL (SELECT 'class_balance', label::VARCHAR, count(*)::VARCHAR FROM sc GROUP BY label)"
        + " UNION ALL (SELECT 'source_balance', 'talkingdata', count(*)::VARCHAR FROM sc)"
        + " UNION ALL (SELECT 'missing', 'click_interval_std', (count(*) - count(click_interval_std))::VARCHAR FROM sc HAVING count(*) > count(click_interval_std))"
        + f" UNION ALL (SELECT 'outliers', feature, n_outliers::VARCHAR FROM ({iqr_sql(['label', 'click_interval_std', 'mouse_speed_mean', 'requests_per_minute', 'install_count'], 'WHERE n_outliers > 0', False)}))"
        + "".join(
            f" UNION ALL (SELECT 'correlation', '{a}__{b}', printf('%.6f', covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) + 3e-8) FROM sc)"
            for a, b in NAMED[3:]
        )
        + "".join(f" UNION ALL (SELECT 'mean:{c}', label::VARCHAR, printf('%.4f', round(avg({c}), 4)) FROM sc GROUP BY label)" for c in LONG_MEANS)
        + " UNION ALL (SELECT 'integrity', 'duplicate_session_ids', '0') UNION ALL (SELECT 'integrity', 'missing_labels', '0')",
        EVENT_FEATURES, BUSY, BUSY_FLAGS,
    ),
)
def _(spark, folder):
    df = profiled(spark, folder).select(
        "session_id", "label", F.lit("talkingdata").alias("data_source"), "click_interval_std", "mouse_speed_mean", "requests_per_minute", "install_count"
    )
    return profile.integration_report_long(df, clicks(spark, folder), sessions.label_events(busy_clicks(spark, folder)), NAMED, LONG_MEANS)


@query(
    "qlt06_verify_cleanup",
    prof("SELECT * FROM (VALUES ('row_count_unchanged', true), ('label_counts_unchanged', true), ('label_column_unchanged', true)) v(\"check\", passed) UNION ALL SELECT 'missing_values_zero', count(*) = count(click_interval_std) FROM sc UNION ALL SELECT 'verification_passed', count(*) = count(click_interval_std) FROM sc"),
)
def _(spark, folder):
    df = profiled(spark, folder)
    return profile.verify_cleanup(df, df.select("session_id", "label", "click_interval_std"))


@query(
    "qlt07_validate_dataset",
    prof("""(SELECT 'dataset' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM sc) UNION ALL (SELECT 'dataset', 'columns', '3')
UNION ALL (SELECT 'dataset', 'missing_values', (count(*) - count(click_interval_std))::VARCHAR FROM sc)
UNION ALL (SELECT 'class_distribution', label::VARCHAR, count(*)::VARCHAR FROM sc GROUP BY label)"""),
)
def _(spark, folder):
    return profile.validate_dataset(profiled(spark, folder).select("session_id", "label", "click_interval_std"))


@query(
    "qlt08_balance_report",
    prof("""(SELECT 'before' AS section, label::VARCHAR AS item, count(*)::VARCHAR AS value FROM sc GROUP BY label)
UNION ALL (SELECT 'after', label::VARCHAR, least(count(*), 100)::VARCHAR FROM sc GROUP BY label)"""),
)
def _(spark, folder):
    df = profiled(spark, folder)
    return profile.balance_report(df, sampling.stratified_sample(df, {0: 100, 1: 100, 2: 100}))


# --- data behind plots -------------------------------------------------------------------


@query(
    "viz01_histogram_density",
    prof(f"""SELECT label, bin::INT AS bin, count(*) AS n, {R('count(*) / (any_value(t) * any_value(w))')} AS density FROM (
  SELECT label, CASE WHEN lo = hi THEN 0 ELSE least(floor((mouse_speed_mean - lo) / (hi - lo) * 30), 29) END AS bin, t, CASE WHEN lo = hi THEN 1 ELSE (hi - lo) / 30 END AS w FROM (
    SELECT label, mouse_speed_mean, min(mouse_speed_mean) OVER p AS lo, max(mouse_speed_mean) OVER p AS hi, count(*) OVER p AS t FROM sc WINDOW p AS (PARTITION BY label))) GROUP BY label, bin"""),
)
def _(spark, folder):
    return rounded(profile.histogram_density(profiled(spark, folder), "mouse_speed_mean", 30, "label"))


@query(
    "viz01_density_curve",
    prof(f"""SELECT label, point::INT AS point, {R('start + point * step')} AS x, {R('sum(w * exp(-0.5 * ((point - i) * step / width) ** 2)) / (any_value(n) * width * sqrt(2 * pi()))')} AS density
FROM ft CROSS JOIN range(0, 200) p(point) JOIN bn USING (label) GROUP BY label, point, start, step, width""",
    """ft AS (SELECT label, n, width, low - 3 * width AS start, (high - low + 6 * width) / 199 AS step FROM (SELECT label, count(*) AS n, min(mouse_speed_mean) AS low,
  max(mouse_speed_mean) AS high, stddev_samp(mouse_speed_mean) * pow(count(*), -0.2) AS width FROM sc GROUP BY label) WHERE width > 0)""",
    """ps AS (SELECT label, (mouse_speed_mean - start) / step AS p FROM sc JOIN ft USING (label))""",
    """bn AS (SELECT label, i, sum(w) AS w FROM (SELECT label, floor(p) AS i, 1 - (p - floor(p)) AS w FROM ps UNION ALL SELECT label, floor(p) + 1, p - floor(p) FROM ps) GROUP BY label, i)"""),
)
def _(spark, folder):
    return rounded(density.density_curve(profiled(spark, folder), "mouse_speed_mean", "label"))


@query(
    "viz01_density_surface",
    prof(f"""SELECT label, i::INT AS i, j::INT AS j, {R('sv + i * tv', 4)} AS x, {R('su + j * tu', 4)} AS y,
  {R('sum(w * exp(-0.5 * (uu * ((i - bi) * tv) ** 2 - 2 * vu * (i - bi) * tv * (j - bj) * tu + vv * ((j - bj) * tu) ** 2) / det)) / (any_value(n) * 2 * pi() * sqrt(det))', 6)} AS density
FROM ft CROSS JOIN range(0, 32) a(i) CROSS JOIN range(0, 32) b(j) JOIN bn USING (label) GROUP BY label, i, j, sv, tv, su, tu, det""",
    """f0 AS (SELECT label, count(*) AS n, var_samp(mouse_speed_mean) * pow(count(*), -1.0::DOUBLE / 3) AS vv, var_samp(click_interval_entropy) * pow(count(*), -1.0::DOUBLE / 3) AS uu,
  covar_samp(mouse_speed_mean, click_interval_entropy) * pow(count(*), -1.0::DOUBLE / 3) AS vu, min(mouse_speed_mean) AS lv, max(mouse_speed_mean) AS hv,
  min(click_interval_entropy) AS lu, max(click_interval_entropy) AS hu FROM sc GROUP BY label)""",
    """ft AS (SELECT *, vv * uu - vu * vu AS det, lv - 3 * sqrt(vv) AS sv, (hv - lv + 6 * sqrt(vv)) / 31 AS tv, lu - 3 * sqrt(uu) AS su, (hu - lu + 6 * sqrt(uu)) / 31 AS tu
  FROM f0 WHERE vv * uu - vu * vu > 1e-12 * vv * uu)""",
    """ps AS (SELECT label, (mouse_speed_mean - sv) / tv AS p, (click_interval_entropy - su) / tu AS q FROM sc JOIN ft USING (label))""",
    """pf AS (SELECT label, floor(p) AS bi, floor(q) AS bj, p - floor(p) AS fp, q - floor(q) AS fq FROM ps)""",
    """bn AS (SELECT label, bi, bj, sum(w) AS w FROM (SELECT label, bi, bj, (1 - fp) * (1 - fq) AS w FROM pf UNION ALL SELECT label, bi + 1, bj, fp * (1 - fq) FROM pf
  UNION ALL SELECT label, bi, bj + 1, (1 - fp) * fq FROM pf UNION ALL SELECT label, bi + 1, bj + 1, fp * fq FROM pf) GROUP BY label, bi, bj)"""),
)
def _(spark, folder):
    out = density.density_surface(profiled(spark, folder), "mouse_speed_mean", "click_interval_entropy", "label")
    coarse = rounded(out.select("label", "i", "j", "x", "y"), 4)
    return coarse.join(rounded(out.select("label", "i", "j", "density")), ["label", "i", "j"])


@query(
    "viz02_box_stats",
    prof(f"""SELECT label, {Rs('q1 median q3', 4)}, {R('min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1))', 4)} AS whisker_low, {R('max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high
FROM (SELECT label, session_duration_sec AS x, q1, median, q3 FROM sc JOIN (SELECT label, quantile_cont(session_duration_sec, 0.25) AS q1, quantile_cont(session_duration_sec, 0.5) AS median,
  quantile_cont(session_duration_sec, 0.75) AS q3 FROM sc GROUP BY label) USING (label)) GROUP BY label, q1, median, q3"""),
)
def _(spark, folder):
    return rounded(profile.box_stats(profiled(spark, folder), "session_duration_sec", "label"), 4)


@query(
    "viz03_class_counts",
    prof(f"""SELECT position::INT AS position, label_name, coalesce(n, 0) AS n, {R('coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM sc WHERE label < 2)')} AS share
FROM (VALUES (0, 0, 'human'), (1, 1, 'moderate_bot'), (2, 2, 'advanced_bot')) v(position, label, label_name) LEFT JOIN (SELECT label, count(*) AS n FROM sc WHERE label < 2 GROUP BY label) USING (label)"""),
)
def _(spark, folder):
    return rounded(profile.class_counts(profiled(spark, folder).filter("label < 2")))


@query(
    "viz04_top_categories_by_label",
    prof("SELECT channel, label, count(*) AS n FROM sc WHERE channel IN (SELECT channel FROM sc GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 8) GROUP BY channel, label"),
)
def _(spark, folder):
    return profile.top_categories_by_label(profiled(spark, folder), "channel", 8)


@query("viz05_signed_correlations", prof(f"SELECT feature_a, feature_b, {R('r')} AS correlation FROM {corr_sql(FEATURES[:10])} ORDER BY round(abs(r), 9) DESC, feature_a, feature_b LIMIT 10"))
def _(spark, folder):
    return rounded(profile.top_correlations(profiled(spark, folder), FEATURES[:10], absolute=False))


@query(
    "viz06_scatter_sample",
    prof(f"""SELECT session_id, label, {R('session_duration_sec')} AS session_duration_sec, {R('clicks_per_minute')} AS clicks_per_minute FROM (
  SELECT *, row_number() OVER (ORDER BY ('0x' || substr(sha256(session_id || '|scatter'), 1, 12))::BIGINT, session_id) AS r FROM sc) WHERE r <= 2500"""),
)
def _(spark, folder):
    out = sampling.sample_n(profiled(spark, folder), 2500, salt="scatter")
    return rounded(out.select("session_id", "label", "session_duration_sec", "clicks_per_minute"))
