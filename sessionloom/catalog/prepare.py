"""Queries for sampling, balancing, augmentation, imputation, cleaning and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.base import (
    CLICKS, H, N, R, Rs, U, clicks, prof, profiled, query, rounded, sess, staged,
)
from sessionloom.catalog.domain import share_sql
from sessionloom.catalog.base import PROXY
from sessionloom.operators import anomaly, clean, profile, sampling
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import BOT_NOISE, HUMAN_NOISE

FEATURES = [
    "requests_per_minute", "session_duration_sec", "coordinate_entropy", "mouse_speed_mean", "mouse_speed_std",
    "mouse_path_length", "click_interval_mean", "click_interval_std", "click_interval_entropy", "session_idle_ratio",
    "channel_entropy", "app_entropy", "click_count", "direction_change_count", "movement_curvature",
]


def hash_rank(salt: str, partition: str = "") -> str:
    return f"row_number() OVER ({partition} ORDER BY {U('session_id', salt)}, session_id)"


# --- sampling ----------------------------------------------------------------------------


@query("smp03_sample_n", prof(f"SELECT session_id FROM (SELECT session_id, {hash_rank('sample')} AS r FROM sc) WHERE r <= 150"))
def _(spark, folder):
    return sampling.sample_n(profiled(spark, folder), 150).select("session_id")


@query("smp03_sample_fraction", prof(f"SELECT session_id FROM (SELECT session_id, {hash_rank('fraction')} AS r, count(*) OVER () AS n FROM sc) WHERE r <= round_even(0.3::DOUBLE * n, 0)"))
def _(spark, folder):
    return sampling.sample_fraction(profiled(spark, folder), 0.30).select("session_id")


@query(
    "smp04_sample_with_replacement",
    prof(f"""SELECT clone::BIGINT AS clone, session_id FROM range(700) d(clone) JOIN (
  SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS i, count(*) OVER () AS n FROM sc) b
ON floor({U('clone', 'replace')} * n) = i"""),
)
def _(spark, folder):
    return sampling.sample_with_replacement(profiled(spark, folder), 700).select("clone", "session_id")


def decile_sql(column: str) -> str:
    order = f"row_number() OVER (PARTITION BY label ORDER BY {column}, {H('session_id')}, session_id)"
    return f"round_even(10.0 * {order} / count(*) OVER (PARTITION BY label), 0)::INT"


STRATA = f"""st AS (SELECT session_id, label, count(*) OVER (PARTITION BY label) AS n, least(count(*) OVER (PARTITION BY label), 120) AS target,
  {decile_sql('requests_per_minute')} AS a, {decile_sql('session_duration_sec')} AS b, {decile_sql('coordinate_entropy')} AS c FROM sc),
sq0 AS (SELECT *, count(*) OVER (PARTITION BY label, a, b, c) AS m, {hash_rank('stratum', 'PARTITION BY label, a, b, c')} AS r FROM st),
sq1 AS (SELECT *, r <= least(m, greatest(1, round_even(target * m / n, 0))) AS hit FROM sq0),
sq2 AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY label) AS got,
  {hash_rank('trim', 'PARTITION BY label, hit')} AS rt, {hash_rank('topup', 'PARTITION BY label, hit')} AS ru FROM sq1)"""


@query(
    "smp01_stratified_sample",
    prof("SELECT session_id, label FROM sq2 WHERE n <= target OR (hit AND (got <= target OR rt <= target)) OR (NOT hit AND got < target AND ru <= target - got)", STRATA),
)
def _(spark, folder):
    out = sampling.stratified_sample(profiled(spark, folder), {0: 120, 1: 120, 2: 120})
    return out.select("session_id", "label")


def bin_sql(column: str) -> str:
    order = f"row_number() OVER (ORDER BY {column}, {H('session_id')}, session_id)"
    q = f"(SELECT least(5, count(DISTINCT {column})) FROM big)"
    return f"CASE WHEN {q} <= 1 THEN 1 ELSE greatest(1, ceil(({order} - 1)::DOUBLE * {q} / (count(*) OVER () - 1)))::INT END"


BALANCE = f"""bn AS (SELECT session_id, (label <> 0)::INT AS label, 'talkingdata' AS data_source, (original_device = 0)::INT AS is_proxy, requests_per_minute, session_duration_sec, coordinate_entropy FROM sc),
cl AS (SELECT label, count(*) AS c FROM bn GROUP BY label),
big AS (SELECT * FROM bn WHERE label = (SELECT label FROM cl ORDER BY c DESC, label LIMIT 1)),
bb AS (SELECT *, data_source || '|' || is_proxy || '|' || {bin_sql('requests_per_minute')} || '|' || {bin_sql('session_duration_sec')} || '|' || {bin_sql('coordinate_entropy')} AS stratum FROM big),
bc AS (SELECT stratum, count(*) AS w FROM bb GROUP BY stratum), bq AS ({share_sql('bc', 'w', '(SELECT min(c) FROM cl)', 'stratum')}),
br AS (SELECT session_id, label, {hash_rank('balance', 'PARTITION BY stratum')} AS r, share FROM bb JOIN bq USING (stratum))"""


def binary_sessions(spark, folder):
    flags = {"label": (F.col("label") != 0).cast("int"), "data_source": F.lit("talkingdata"), "is_proxy": (F.col("original_device") == 0).cast("int")}
    return profiled(spark, folder).withColumns(flags)


@query(
    "smp02_downsample_majority",
    prof("SELECT session_id, label FROM br WHERE r <= share UNION ALL SELECT session_id, label FROM bn WHERE label = (SELECT label FROM cl ORDER BY c, label LIMIT 1)", BALANCE),
)
def _(spark, folder):
    return sampling.downsample_majority(binary_sessions(spark, folder)).select("session_id", "label")


@query(
    "smp06_stratified_split",
    prof(f"""SELECT session_id, label, r <= share AS is_test FROM (SELECT session_id, label, {hash_rank('split', 'PARTITION BY label')} AS r FROM sc) JOIN (
  SELECT label, fl + (row_number() OVER (ORDER BY fr DESC, label) <= total - sum(fl) OVER ())::INT AS share FROM (
    SELECT label, total, floor(c * total / n::DOUBLE) AS fl, round(c * total / n::DOUBLE - floor(c * total / n::DOUBLE), 9) AS fr FROM (
      SELECT label, count(*) AS c, (SELECT count(*) FROM sc) AS n, ceil(0.2 * (SELECT count(*) FROM sc)) AS total FROM sc GROUP BY label))) USING (label)"""),
)
def _(spark, folder):
    return sampling.stratified_split(profiled(spark, folder)).select("session_id", "label", "is_test")


# --- augmentation ------------------------------------------------------------------------


def human_base(spark, folder):
    return profiled(spark, folder).filter("label = 0").drop("app", "device", "os", "channel")


@query("aug01_bootstrap_class")
def _(spark, folder):
    humans = human_base(spark, folder)
    out = sampling.bootstrap_class(humans, humans.count() * 3 // 2)
    return out.select("session_id", "data_source", "click_count", "success_rate", "session_duration_sec", "bot_likelihood_score")


def cholesky_sql(columns: list[str]) -> list[str]:
    """CTEs of the lower factor of the scaled covariance matrix, one row at a time (``l`` i j)."""
    k = range(len(columns))
    cells = [f"covar_samp({columns[i]}, {columns[j]}) * 0.015{' + 1e-6' if i == j else ''} AS a{i}{j}" for i in k for j in k if j <= i]
    out = [f"k0 AS (SELECT {', '.join(cells)} FROM sc)"]
    for j in k:
        rest = lambda i: "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))  # noqa: B023, E731
        out.append(f"k{2 * j + 1} AS (SELECT *, sqrt(a{j}{j}{rest(j)}) AS l{j}{j} FROM k{2 * j})")
        below = "".join(f", (a{i}{j}{rest(i)}) / l{j}{j} AS l{i}{j}" for i in k if i > j)
        out.append(f"k{2 * j + 2} AS (SELECT *{below} FROM k{2 * j + 1})")
    return out


PROBE = [" + ".join(f"l{i}{j} * {N('session_id', f'probe{j}')}" for j in range(i + 1)) for i in range(4)]


@query(
    "rnd03_correlated_normals",
    prof(f"SELECT session_id, {', '.join(f'{R(e, 4)} AS n{i}' for i, e in enumerate(PROBE))} FROM sc CROSS JOIN k8", *cholesky_sql(FEATURES[:4])),
)
def _(spark, folder):
    df = profiled(spark, folder)
    factor = sampling.jitter_factor(df, FEATURES[:4])
    draws, combos = sampling.correlated_normals(F.col("session_id"), factor, "probe")
    return rounded(df.withColumns(draws).select("session_id", *[c.alias(f"n{i}") for i, c in enumerate(combos)]), 4)


NOISY = [c for c in BOT_NOISE if c in FEATURES]
RANGES = "rg AS (SELECT " + ", ".join(
    f"greatest(0, l{i} - 0.1 * greatest(h{i} - l{i}, 1e-6)) AS lo{i}, h{i} + 0.1 * greatest(h{i} - l{i}, 1e-6) AS hi{i}" for i in range(len(NOISY))
) + " FROM (SELECT " + ", ".join(
    f"quantile_cont({c}::DOUBLE, 0.01) AS l{i}, quantile_cont({c}::DOUBLE, 0.99) AS h{i}" for i, c in enumerate(NOISY)
) + " FROM sc))"


def noise_sql(i: int, column: str, sigma: float, key: str) -> str:
    x = f"least(greatest({column}::DOUBLE + {sigma} * {N(key, 'noise:' + column)}, lo{i}), hi{i})"
    return f"round_even({x}, 0)" if column == "click_count" else x


CLONE = "('2:' || clone)"


@query(
    "aug03_noise_expand",
    prof(
        f"""SELECT session_id, label, {Rs(NOISY)} FROM (SELECT session_id, label, {', '.join(f'{c}::DOUBLE AS {c}' for c in NOISY)} FROM own
UNION ALL SELECT session_id, label, {', '.join(f'{noise_sql(i, c, BOT_NOISE[c], CLONE)} AS {c}' for i, c in enumerate(NOISY))}
FROM range((SELECT count(*) // 2 FROM own)) d(clone) JOIN (SELECT *, row_number() OVER (ORDER BY session_id) - 1 AS i, count(*) OVER () AS n FROM own) b
  ON floor({U('clone', 'expand2')} * n) = i, rg)""",
        "own AS (SELECT * FROM sc WHERE label = 2)", RANGES,
    ),
)
def _(spark, folder):
    df = profiled(spark, folder)
    ranges = sampling.clip_ranges(df, NOISY)
    n = df.filter("label = 2").count()
    out = sampling.noise_expand(df, 2, n + n // 2, ranges)
    return rounded(out.select("session_id", "label", *NOISY))


LIGHT = [c for c in HUMAN_NOISE if c in NOISY]


@query(
    "aug04_light_noise",
    prof(
        "SELECT session_id, " + ", ".join(
            R(f"CASE WHEN r <= round_even(0.3::DOUBLE * n, 0) THEN {noise_sql(NOISY.index(c), c, HUMAN_NOISE[c], 'session_id')} ELSE {c} END") + f" AS {c}" for c in LIGHT
        ) + f" FROM (SELECT *, {hash_rank('light')} AS r, count(*) OVER () AS n FROM sc WHERE label = 0), rg",
        RANGES,
    ),
)
def _(spark, folder):
    df = profiled(spark, folder)
    return rounded(sampling.light_noise(df, 0, sampling.clip_ranges(df, NOISY)).select("session_id", *LIGHT))


@query(
    "aug05_clip_ranges",
    prof(" UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'lo{i}', 4)} AS low, {R(f'hi{i}', 4)} AS high FROM rg" for i, c in enumerate(NOISY)), RANGES),
)
def _(spark, folder):
    ranges = sampling.clip_ranges(profiled(spark, folder), NOISY)
    return rounded(spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in ranges.items()], "feature string, low double, high double"), 4)


# --- imputation and cleaning -------------------------------------------------------------


def holed(spark, folder):
    """The profiled table with regular holes."""
    df = profiled(spark, folder)
    return df.select(
        "session_id",
        "label",
        F.when(F.col("click_count") != 2, F.col("requests_per_minute")).alias("requests_per_minute"),
        F.when(F.col("label") != 1, F.col("click_count")).alias("click_count"),
        "click_interval_std",
        F.when(F.col("click_count") % 2 == 1, F.col("channel")).alias("channel"),
    )


HOLED = """ho AS (SELECT session_id, label, CASE WHEN click_count <> 2 THEN requests_per_minute END AS requests_per_minute,
  CASE WHEN label <> 1 THEN click_count END AS click_count, click_interval_std, CASE WHEN click_count % 2 = 1 THEN channel END AS channel FROM sc)"""


def filled_sql(column: str) -> str:
    return f"coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM ho))"


@query(
    "imp01_impute",
    prof(
        "SELECT session_id, label, " + ", ".join(f"{R(filled_sql(c))} AS {c}" for c in ("requests_per_minute", "click_count", "click_interval_std")) + ", coalesce(channel, 'unknown') AS channel FROM ho",
        HOLED,
    ),
)
def _(spark, folder):
    out = clean.impute(holed(spark, folder))
    return rounded(out.withColumn("click_count", F.col("click_count").cast("double")))


@query("imp02_most_frequent", prof("SELECT session_id, coalesce(channel, (SELECT channel FROM ho WHERE channel IS NOT NULL GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 1)) AS channel FROM ho", HOLED))
def _(spark, folder):
    from sessionloom.operators.models import most_frequent

    df = holed(spark, folder)
    return df.fillna(most_frequent(df, ["channel"])).select("session_id", "channel")


@query("cln01_cap_extremes", prof(f"SELECT session_id, {R('least(requests_per_minute, 1000)')} AS requests_per_minute, {R('least(session_duration_sec, 10000)')} AS session_duration_sec FROM sc"))
def _(spark, folder):
    return rounded(clean.cap_extremes(profiled(spark, folder)).select("session_id", "requests_per_minute", "session_duration_sec"))


CORR = ["requests_per_minute", "clicks_per_minute", "click_count", "total_requests", "coordinate_entropy", "mouse_speed_mean", "mouse_path_length", "request_interval_mean", "click_interval_mean"]


def corr_sql(columns: list[str], source: str = "sc") -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, covar_pop({a}::DOUBLE, {b}::DOUBLE) / nullif(stddev_pop({a}::DOUBLE) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}::DOUBLE) FILTER (WHERE {a} IS NOT NULL), 0) AS r FROM {source}"
        for a, b in pairs
    )
    return f"(SELECT * FROM ({rows}) WHERE r IS NOT NULL)"


@query(
    "cln02_correlated_drops",
    prof(
        f"""SELECT DISTINCT CASE WHEN feature_a = 'click_count' AND feature_b = 'total_requests' THEN 'total_requests'
  WHEN feature_a IN ('total_requests', 'request_interval_mean') AND feature_b NOT IN ('total_requests', 'request_interval_mean') THEN feature_a
  WHEN feature_b IN ('total_requests', 'request_interval_mean') AND feature_a NOT IN ('total_requests', 'request_interval_mean') THEN feature_b
  ELSE greatest(feature_a, feature_b) END AS dropped FROM {corr_sql(CORR)} WHERE abs(r) > 0.98
AND (feature_a IN ('total_requests', 'request_interval_mean') OR feature_b IN ('total_requests', 'request_interval_mean'))"""
    ),
)
def _(spark, folder):
    drops, _ = clean.correlated_drops(profiled(spark, folder), columns=CORR)
    return spark.createDataFrame([(d,) for d in drops], "dropped string")


@query(
    "cln03_duplicate_columns",
    prof("SELECT a AS feature_a, b AS feature_b FROM (SELECT 'click_count' AS a, 'total_requests' AS b, bool_and(click_count = total_requests) AS e FROM sc "
         "UNION ALL SELECT 'click_count', 'install_count', bool_and(click_count = install_count) FROM sc "
         "UNION ALL SELECT 'total_requests', 'install_count', bool_and(total_requests = install_count) FROM sc) WHERE e"),
)
def _(spark, folder):
    pairs = clean.duplicate_column_pairs(profiled(spark, folder), "session_id", ["click_count", "total_requests", "install_count"])
    return spark.createDataFrame(pairs, "feature_a string, feature_b string")


def robust_sql(c: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({c}::DOUBLE, {p}) FROM sc)"
    return R(f"({c} - {q(0.5)}) / CASE WHEN {q(0.75)} = {q(0.25)} THEN 1 ELSE {q(0.75)} - {q(0.25)} END", 4) + f" AS {c}"


@query("cln04_robust_scale", prof(f"SELECT session_id, {', '.join(robust_sql(c) for c in FEATURES[:5])} FROM sc"))
def _(spark, folder):
    return rounded(clean.robust_scale(profiled(spark, folder), FEATURES[:5]).select("session_id", *FEATURES[:5]), 4)


@query(
    "cln05_standard_scale",
    prof("SELECT session_id, " + ", ".join(R(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in FEATURES[:5]) + " FROM sc"),
)
def _(spark, folder):
    return rounded(clean.standard_scale(profiled(spark, folder), FEATURES[:5]).select("session_id", *FEATURES[:5]))


@query("cln06_label_encode", prof("SELECT session_id, dense_rank() OVER (ORDER BY coalesce(channel, 'nan')) - 1 AS channel FROM ho", HOLED))
def _(spark, folder):
    out = clean.label_encode(holed(spark, folder), ["channel"])
    return out.select("session_id", F.col("channel").cast("long").alias("channel"))


KNOWN = "known AS (SELECT channel, row_number() OVER (ORDER BY count(*) DESC, channel) - 1 AS slot FROM sc GROUP BY channel)"


@query(
    "cln07_one_hot",
    prof("""SELECT session_id, slot, (SELECT count(*) FROM known) AS width, 1 AS ones FROM sc JOIN known USING (channel)
UNION ALL SELECT 'unknown', -1, (SELECT count(*) FROM known), 0""", KNOWN),
)
def _(spark, folder):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from sessionloom.operators.models import encoder_stages

    df = profiled(spark, folder)
    model = Pipeline(stages=encoder_stages(df, [], {"channel": "unknown"})).fit(df)
    # a value that the fit has not seen gets no slot
    strange = df.limit(1).withColumns({"session_id": F.lit("unknown"), "channel": F.lit("never seen")})
    codes = model.transform(df.unionByName(strange)).withColumn("f", vector_to_array("features"))
    return codes.select(
        "session_id", (F.array_position("f", 1.0) - 1).alias("slot"), F.size("f").cast("long").alias("width"),
        F.size(F.filter("f", lambda x: x == 1.0)).alias("ones"),
    )


@query(
    "cln08_preprocessing_model",
    prof(f"SELECT session_id, {', '.join(robust_sql(c) for c in FEATURES[:5])}, slot FROM sc JOIN known USING (channel)", KNOWN),
)
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array

    from sessionloom.operators.models import preprocessing_model

    df = profiled(spark, folder).select("session_id", "label", *FEATURES[:5], "channel")
    out = preprocessing_model(df).transform(df).withColumn("f", vector_to_array("features"))
    hot = F.slice("f", 6, F.size("f") - 5)
    return rounded(out.select("session_id", *[F.col("f")[i].alias(c) for i, c in enumerate(FEATURES[:5])], (F.array_position(hot, 1.0) - 1).alias("slot")), 4)


# --- anomalies ---------------------------------------------------------------------------


def scored(spark, folder):
    return staged(
        spark, folder, "anomalies",
        lambda s, f: anomaly.detect_anomalies(profiled(s, f).select("session_id", "label", *FEATURES), FEATURES),
    )


@query("ano01_isolation_forest")
def _(spark, folder):
    return scored(spark, folder).select("session_id", "label", "anomaly_score")


@query("ano01_anomaly_summary")
def _(spark, folder):
    return anomaly.anomaly_summary(scored(spark, folder))


@query("ano01_share_of_anomalies", prof("SELECT count(*) AS n, true AS share_is_met, true AS rows_are_kept FROM sc"))
def _(spark, folder):
    """What must hold of any forest: every row has a score and 3 % of them, but for ties, lie above the cut."""
    above = F.count_if(F.col("anomaly_score") > 0)
    near = F.abs(above - 0.03 * F.count("*")) <= 0.01 * F.count("*") + 1
    return scored(spark, folder).agg(F.count("*").alias("n"), near.alias("share_is_met"), (F.count("anomaly_score") == F.count_distinct("session_id")).alias("rows_are_kept"))


@query(
    "ano02_threshold_count",
    prof(f"SELECT {R('q', 4)} AS threshold, count(*) FILTER (WHERE mouse_path_length >= q) AS outlier_count FROM sc, (SELECT quantile_cont(mouse_path_length, 0.97) AS q FROM sc) GROUP BY q"),
)
def _(spark, folder):
    return rounded(profile.threshold_count(profiled(spark, folder), "mouse_path_length"), 4)


def iqr_sql(columns: list[str], where: str, skip_flat: bool = True) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {'CASE WHEN any_value(q1) = any_value(q3) THEN 0 ELSE' if skip_flat else ''}
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) {'END' if skip_flat else ''} AS n_outliers
FROM sc, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM sc)"""
        for c in columns
    )
    return f"SELECT feature, n_outliers FROM ({rows}) {where}"


IQR = FEATURES + ["install_count"]


@query("ano03_iqr_outliers", prof(iqr_sql(IQR, "")))
def _(spark, folder):
    return profile.iqr_outliers(profiled(spark, folder), IQR)


@query("ano03_iqr_outliers_flat_kept", prof(iqr_sql(IQR, "WHERE n_outliers > 0", False)))
def _(spark, folder):
    return profile.iqr_outliers(profiled(spark, folder), IQR, skip_flat=False)
