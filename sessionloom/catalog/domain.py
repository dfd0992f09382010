"""Queries for motion, enrichment, legacy upgrades and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.base import (
    CLICKS, H, MOTION, MOVES, PROXY, R, Rs, S, SCORE, TEMPORAL, U, choice_sql, enriched, ev_sql, events, motion_sql, N,
    prof, profiled, query, rounded, score_sql, sess, staged, stamp, temporal, traces,
)
from sessionloom.catalog.tables import agent_sql, ip_sql
from sessionloom.functions import columns as C
from sessionloom.operators import clean, enrich, motion, sequences, structure
from sessionloom.schema import BINARY_ODDS, BOT_AGENTS, BROWSERS, REGIONS, THREE_CLASS_ODDS
from sessionloom.sources import bindings

MOTION_COLUMNS = (
    "mouse_speed_mean mouse_speed_std mouse_path_length movement_std coordinate_entropy mouse_acceleration_std movement_curvature"
)


@query("dom01_motion_features", motion_sql(f"SELECT session_id, total_movements, direction_change_count, {Rs(MOTION_COLUMNS)} FROM mo"))
def _(spark, folder):
    out = motion.motion_features(bindings.moves(spark, folder))
    return rounded(out.select("session_id", "total_movements", "direction_change_count", *MOTION_COLUMNS.split()))


# --- behaviour models with the noise off -------------------------------------------------

Z = enrich.Z_COLUMNS
ZSCORES = "zz AS (SELECT *, (label <> 0)::INT AS bot, " + ", ".join(
    f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / coalesce(nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 1) AS z{i}"
    for i, c in enumerate(Z)
) + " FROM sc)"
MODELS = """z1 AS (SELECT *, 1 - bot AS human, z1 AS rate, z3 AS irregular, (z4 + z5) / 2 AS diversity, z7 AS installs FROM zz),
z2 AS (SELECT session_id, bot, install_count, requests_per_minute,
  145 + 28 * human + 12 * rate + 10 * diversity - 14 * bot AS speed, 34 + 12 * human + 8 * irregular + 6 * diversity - 16 * bot AS sstd,
  greatest(click_count, 1) AS n1, greatest(click_count - 1, 0) AS n0, human, diversity, irregular, rate, installs,
  2.5 + 0.014 * session_duration_sec + 6 * human + 4 * diversity - 5.5 * bot AS scroll,
  2.6 + 1.1 * human + 0.45 * diversity + 0.20 * irregular - 1.15 * bot AS coord FROM z1),
z3 AS (SELECT session_id, bot AS label, requests_per_minute, greatest(speed, 35) AS mouse_speed_mean, greatest(sstd, 4) AS mouse_speed_std,
  greatest(n1 * (0.72 * speed + 18 * diversity + 6 * irregular), 50) AS mouse_path_length,
  greatest(round_even(n0 * (0.42 + 0.16 * human + 0.10 * diversity - 0.14 * bot), 0), 0)::BIGINT AS direction_change_count,
  greatest(1.20 + 0.18 * human + 0.12 * installs - 0.20 * rate - 0.15 * bot, 0.05) AS hover_time_mean,
  greatest(0.55 + 0.24 * human + 0.18 * irregular - 0.22 * bot, 0.01) AS hover_time_std,
  greatest(round_even(scroll, 0), 0)::BIGINT AS scroll_count,
  least(greatest(28 + 8.5 * ln(1 + greatest(scroll, 0)) + 16 * human + 7 * diversity - 14 * bot, 0), 100) AS scroll_depth,
  least(greatest(coord, 0.05), 8.5) AS coordinate_entropy,
  greatest(0.85 + 0.018 * sstd + 0.12 * coord + 0.08 * human - 0.12 * bot, 0.01) AS cursor_acceleration_std,
  greatest(0.5, 0.42 * greatest(sstd, 4) + 4.0) AS movement_std FROM z2)"""
NOISY = "mouse_speed_mean mouse_speed_std mouse_path_length hover_time_mean hover_time_std scroll_depth coordinate_entropy cursor_acceleration_std movement_std"


@query(
    "dom09_behaviour_models",
    prof(f"SELECT session_id, direction_change_count, scroll_count, {Rs(NOISY, 4)} FROM z3", ZSCORES, MODELS),
)
def _(spark, folder):
    binary = profiled(spark, folder).withColumn("label", (F.col("label") != 0).cast("int"))
    out = enrich.behavioural_proxies_noisy(binary, noise=False)
    return rounded(out.select("session_id", "direction_change_count", "scroll_count", *NOISY.split()), 4)


@query("dom09_behaviour_models_with_noise")
def _(spark, folder):
    binary = profiled(spark, folder).withColumn("label", (F.col("label") != 0).cast("int"))
    out = enrich.behavioural_proxies_noisy(binary)
    return out.select("session_id", "label", *NOISY.split(), "bot_likelihood_score")


# --- device and network ------------------------------------------------------------------


def region_sql(country: str, draw: str) -> str:
    parts = [f"WHEN '{c}' THEN {regions}[floor({draw} * {len(regions)})::INT + 1]" for c, regions in REGIONS.items()]
    return f"(CASE {country} {' '.join(parts)} END)"


def device_sql(odds: dict, bot: str, three: bool) -> str:
    k = "session_id"
    device = (
        f"WHEN {bot} AND {U(k, 'server')} < {odds['bot_server']} THEN 'server' WHEN label = 2 AND {U(k, 'desktop')} < {odds['advanced_desktop']} THEN 'desktop'"
        if three
        else f"WHEN {bot} AND {U(k, 'desktop')} < {odds['bot_desktop']} THEN 'desktop'"
    )
    return f"""dv0 AS (SELECT *, {choice_sql(U(k, 'browser'), BROWSERS)} AS browser,
  CASE WHEN {bot} AND {U(k, 'linux')} < {odds['bot_linux']} THEN 'Linux' ELSE {choice_sql(U(k, 'os'), odds['operating_system'])} END AS operating_system,
  {choice_sql(U(k, 'country'), odds['country'])} AS country,
  ({U(k, 'proxy')} < CASE WHEN {bot} THEN {odds['bot_proxy']} ELSE {odds['human_proxy']} END)::INT AS is_proxy FROM lab),
dv AS (SELECT *, CASE {device} WHEN operating_system IN ('Android', 'iOS') THEN 'mobile' ELSE {choice_sql(U(k, 'device'), odds['device_type'])} END AS device_type,
  {region_sql('country', U(k, 'region'))} AS region, {ip_sql(k, f"is_proxy = 1 OR {bot}" if three else bot)} AS ip_address FROM dv0)"""


THREE = f"""lab AS (SELECT * FROM px), {device_sql(THREE_CLASS_ODDS, 'label > 0', True)},
ua AS (SELECT *, {H("browser || '|' || operating_system")} AS fr FROM dv),
en AS (SELECT *, {agent_sql('label > 0', 'floor(118 + fr * 8)::BIGINT', 'floor(4200 + fr * 900)::BIGINT')} AS user_agent, {score_sql('is_proxy')} AS bot_likelihood_score FROM ua)"""
TWO = f"""lab AS (SELECT * EXCLUDE (label), (label <> 0)::INT AS label FROM px), {device_sql(BINARY_ODDS, 'label = 1', False)},
ua AS (SELECT *, least(greatest(round_even(122 + 3 * {N('session_id', 'major')}, 0), 110), 132)::BIGINT AS major,
  least(greatest(round_even(4500 + 180 * {N('session_id', 'build')}, 0), 1000), 7000)::BIGINT AS build,
  CASE WHEN operating_system IN ('Windows', 'MacOS') THEN 'Windows' ELSE 'Linux' END AS token FROM dv),
en AS (SELECT *, CASE WHEN label = 1 THEN {BOT_AGENTS}[floor({U('session_id', 'agent')} * 3)::INT + 1]
  ELSE {agent_sql('false', 'major', 'build', system='token')} END AS user_agent FROM ua)"""
DEVICE = "session_id, browser, operating_system, device_type, user_agent, ip_address, country, region, is_proxy"


@query("dom10_device_network", sess(f"SELECT {DEVICE}, bot_likelihood_score FROM en", PROXY, THREE))
def _(spark, folder):
    out = enrich.device_network_enrich(profiled(spark, folder))
    return out.select(*DEVICE.split(", "), "bot_likelihood_score")


@query("dom11_device_network_binary", sess(f"SELECT {DEVICE} FROM en", PROXY, TWO))
def _(spark, folder):
    binary = profiled(spark, folder).withColumn("label", (F.col("label") != 0).cast("int"))
    return enrich.device_network_enrich_binary(binary).select(*DEVICE.split(", "))


# --- legacy upgrades ---------------------------------------------------------------------


def legacy(spark, folder):
    """Sessions in the older layout: text date, fewer columns."""
    df = profiled(spark, folder)
    return df.select(
        "session_id",
        (F.col("label") > 0).cast("int").alias("label"),
        F.date_format("session_start", "dd/MMM/yyyy").alias("activity_date"),
        "time_range",
        "session_duration_sec",
        "total_requests",
        (F.col("click_count") * 3).alias("total_movements"),
        "request_interval_mean",
        "request_interval_std",
        "requests_per_minute",
        "clicks_per_minute",
        "mouse_speed_mean",
        "mouse_speed_std",
        "mouse_path_length",
        "direction_change_count",
        F.when(F.col("click_count") != 2, F.col("coordinate_entropy")).alias("coordinate_entropy"),
    )


LEGACY = """lg AS (SELECT session_id, (label > 0)::INT AS label, session_start, session_duration_sec, total_requests, click_count * 3 AS total_movements,
  request_interval_mean, request_interval_std, requests_per_minute, clicks_per_minute, mouse_speed_mean, mouse_speed_std, mouse_path_length,
  direction_change_count, CASE WHEN click_count <> 2 THEN coordinate_entropy END AS coordinate_entropy FROM sc)"""
SPAN = (
    f"{S('''date_trunc('second', session_start)''')} AS session_start, "
    f"{S('''date_trunc('second', session_start) + to_microseconds(floor(session_duration_sec * 1e6)::BIGINT)''')} AS session_end"
)


@query(
    "dom12_upgrade_legacy",
    prof(
        f"""SELECT session_id, 2 AS label, 'advanced_bot' AS bot_type, 'legacy_advanced' AS data_source, total_requests AS click_count, 0 AS install_count,
  {R('coalesce(coordinate_entropy, 0) / 4.0')} AS device_entropy, {R('coalesce(coordinate_entropy, 0) / 3.0')} AS channel_entropy,
  {R('coalesce(coordinate_entropy, 0) / 3.5')} AS app_entropy, {R('request_interval_mean')} AS click_interval_mean,
  {R('coalesce(coordinate_entropy, 0) / 3.0')} AS click_interval_entropy, {R('mouse_speed_std / 5.0')} AS mouse_acceleration_std,
  {R('direction_change_count / greatest(mouse_path_length, 1.0)')} AS movement_curvature, {R('0')} AS session_idle_ratio, {SPAN} FROM lg""",
        LEGACY,
    ),
)
def _(spark, folder):
    out = stamp(enrich.upgrade_legacy_sessions(legacy(spark, folder)), "session_start", "session_end")
    names = (
        "session_id label bot_type data_source click_count install_count device_entropy channel_entropy app_entropy click_interval_mean "
        "click_interval_entropy mouse_acceleration_std movement_curvature session_idle_ratio session_start session_end"
    )
    return rounded(out.select(*names.split()))


@query(
    "dom13_upgrade_legacy_binary",
    prof(
        f"""SELECT session_id, label, 'existing_clickstream' AS data_source, total_requests AS click_count, total_requests AS ip_click_frequency,
  total_movements AS device_click_frequency,
  {R('''coalesce(1.0 - CASE WHEN coordinate_entropy IS NOT NULL THEN (rank() OVER (ORDER BY coordinate_entropy NULLS LAST)
    + (count(*) OVER (PARTITION BY coordinate_entropy) - 1) / 2.0) / count(coordinate_entropy) OVER () END, 0.5)''')} AS combo_repeat_rate,
  {R('coordinate_entropy / 8.0')} AS channel_entropy, {R('coordinate_entropy / 8.0')} AS app_entropy,
  year(session_start)::INT AS year, second(session_start)::INT AS second FROM lg""",
        LEGACY,
    ),
)
def _(spark, folder):
    out = enrich.upgrade_legacy_sessions_binary(legacy(spark, folder), enrich=False)
    names = (
        "session_id label data_source click_count ip_click_frequency device_click_frequency combo_repeat_rate channel_entropy app_entropy year second"
    )
    return rounded(out.select(*names.split()))


@query("dom13_upgrade_legacy_binary_enriched")
def _(spark, folder):
    out = enrich.upgrade_legacy_sessions_binary(legacy(spark, folder))
    return out.select("session_id", "label", "combo_repeat_rate", "scroll_depth", "user_agent", "country", "is_proxy")


# --- apportionment, segments, trace sessions ---------------------------------------------


def share_sql(source: str, weight: str, total: str, key: str, out: str = "share") -> str:
    """Largest-remainder CTE body."""
    return f"""SELECT * EXCLUDE (raw, fr, r, lft), fl + (r <= lft)::INT AS {out} FROM (
  SELECT *, row_number() OVER (ORDER BY fr DESC, {H(key)}, {key}) AS r, ({total}) - sum(fl) OVER () AS lft FROM (
    SELECT *, floor(raw)::BIGINT AS fl, round(raw - floor(raw), 9) AS fr FROM (
      SELECT *, {weight}::DOUBLE / (SELECT sum({weight}::DOUBLE) FROM {source}) * ({total}) AS raw FROM {source})))"""


@query(
    "dom14_largest_remainder",
    f"""WITH w AS (SELECT o_custkey::VARCHAR AS k, count(*) AS weight FROM orders GROUP BY 1), a AS ({share_sql('w', 'weight', '54321', 'k')})
SELECT k, weight, share::BIGINT AS share FROM a""",
)
def _(spark, folder):
    w = bindings.table(spark, folder, "orders").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.count("*").alias("weight"))
    return motion.largest_remainder(w, "weight", 54321, "k")


def segments(prefix: str, target: str) -> str:
    return f"""sz AS (SELECT session_id, count(*) AS w, ({target}) AS target FROM mv0 GROUP BY 1),
ks AS (SELECT session_id, 1 + share AS k FROM ({share_sql('sz', 'w', 'greatest(0, (SELECT any_value(target) FROM sz) - (SELECT count(*) FROM sz))', 'session_id')})),
sp AS (SELECT mv0.*, k, n // k AS q, n % k AS r, ordinal - 1 AS i FROM mv0 JOIN ks USING (session_id)),
sq AS (SELECT *, CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // greatest(q, 1) END AS seg FROM sp),
sg AS (SELECT '{prefix}_' || session_id || '_' || lpad((seg + 1)::VARCHAR, 2, '0') AS session_id, session_id AS original_session_id, x, y,
  row_number() OVER (PARTITION BY session_id, seg ORDER BY i) - 1 AS movement_index FROM sq)"""


@query(
    "dom15_segment_traces",
    f"WITH {MOVES}, {segments('mod', '(SELECT count(DISTINCT session_id) * 3 // 2 FROM mv0)')} SELECT session_id, original_session_id, movement_index, {R('x')} AS x FROM sg",
)
def _(spark, folder):
    moves = bindings.moves(spark, folder)
    target = moves.select("session_id").distinct().count() * 3 // 2
    out = motion.segment_traces(moves, target, "mod")
    return rounded(out.select("session_id", "original_session_id", "movement_index", F.col("x_coordinate").alias("x")))


TRACE_SESSIONS = f"""tq AS ({share_sql('mo', 'sqrt(total_movements)', '57454', 'session_id')}),
t0 AS (SELECT *, greatest(20, share)::BIGINT AS total_requests, greatest(mouse_speed_mean, 1.0) AS sp,
  row_number() OVER (ORDER BY session_id) - 1 AS pos FROM tq),
t1 AS (SELECT *, least(greatest(total_movements / sp * 18.0, 45), 1600) AS dur FROM t0),
t2 AS (SELECT *, dur / greatest(total_requests - 1, 1) AS im, TIMESTAMP '2019-10-30 00:00:00' + to_minutes((7 * pos)::BIGINT) AS st FROM t1),
tr AS (SELECT *, greatest(0.05, im * (0.18 + 0.07 * movement_std / sp)) AS isd FROM t2)"""


@query(
    "dom16_sessions_from_traces",
    motion_sql(
        f"""SELECT session_id, total_requests, total_requests AS click_count, total_movements, {S('st')} AS session_start, strftime(st, '%Y-%m-%d') AS activity_date,
  {R('dur')} AS session_duration_sec, {R('im')} AS request_interval_mean, {R('isd')} AS request_interval_std,
  {R('coordinate_entropy / 2.5')} AS click_interval_entropy, {R('coordinate_entropy / 3.5')} AS channel_entropy,
  {R('least(isd / greatest(dur, 1.0), 1)')} AS session_idle_ratio, {R('total_requests / (dur / 60.0)')} AS requests_per_minute,
  {R('total_movements / (dur / 60.0)')} AS clicks_per_minute FROM tr""",
        TRACE_SESSIONS,
    ),
)
def _(spark, folder):
    out = stamp(motion.sessions_from_traces(bindings.moves(spark, folder)), "session_start")
    names = (
        "session_id total_requests click_count total_movements session_start activity_date session_duration_sec request_interval_mean "
        "request_interval_std click_interval_entropy channel_entropy session_idle_ratio requests_per_minute clicks_per_minute"
    )
    return rounded(out.select(*names.split()))


@query(
    "dom17_align_traces",
    prof(
        f"""SELECT m.session_id, sg.original_session_id, sg.movement_index FROM sg LEFT JOIN (
  SELECT a.session_id AS segment_id, b.session_id FROM (
    SELECT session_id, row_number() OVER (ORDER BY c DESC, {H('session_id')}, session_id) AS rk FROM (SELECT session_id, count(*) AS c FROM sg GROUP BY 1)) a
  LEFT JOIN (SELECT session_id, row_number() OVER (ORDER BY click_count DESC, direction_change_count DESC, {H('session_id')}, session_id) AS rk FROM sc) b USING (rk)) m
  ON m.segment_id = sg.session_id""",
        MOVES, segments("adv", "(SELECT count(*) FROM sc)"),
    ),
)
def _(spark, folder):
    sessions = profiled(spark, folder).select(
        "session_id", F.col("click_count").alias("total_movements"), F.col("direction_change_count").alias("total_requests")
    )
    out = motion.align_traces_to_sessions(bindings.moves(spark, folder), sessions)
    return out.select("session_id", "original_session_id", "movement_index")


IMPUTED = """un AS (SELECT session_id, label, click_count, requests_per_minute, click_interval_std, channel AS browser FROM sc
  UNION ALL SELECT session_id, NULL, NULL, mouse_speed_mean, NULL, NULL FROM mo)"""


@query(
    "dom19_combine_and_impute",
    prof(
        f"""SELECT session_id, {R('coalesce(label, (SELECT quantile_cont(label, 0.5) FROM un))')} AS label,
  {R('coalesce(click_count, (SELECT quantile_cont(click_count, 0.5) FROM un))')} AS click_count, {R('requests_per_minute')} AS requests_per_minute,
  {R('coalesce(click_interval_std, (SELECT quantile_cont(click_interval_std, 0.5) FROM un))')} AS click_interval_std, coalesce(browser, 'unknown') AS browser,
  'unknown' AS country FROM un""",
        IMPUTED, MOVES, MOTION,
    ).replace(f"{IMPUTED},\n{MOVES},\n{MOTION}", f"{MOVES},\n{MOTION},\n{IMPUTED}"),
)
def _(spark, folder):
    a = profiled(spark, folder).select(
        "session_id", "label", "click_count", "requests_per_minute", "click_interval_std", F.col("channel").alias("browser"),
        F.lit(None).cast("string").alias("country"),
    )
    b = traces(spark, folder).select("session_id", F.col("mouse_speed_mean").alias("requests_per_minute"))
    out = clean.combine_and_impute(a, b)
    doubles = {c: F.col(c).cast("double") for c in ("label", "click_count")}
    return rounded(out.select("session_id", "label", "click_count", "requests_per_minute", "click_interval_std", "browser", "country").withColumns(doubles))


# --- sequences ---------------------------------------------------------------------------


def trace_lookup(spark, folder):
    return traces(spark, folder).select(
        "session_id",
        (F.col("total_movements") % 3).cast("int").alias("label"),
        (F.col("coordinate_entropy") / 4).alias("device_entropy"),
        (F.col("coordinate_entropy") / 3).alias("channel_entropy"),
    )


MOUSE_STEPS = """ms AS (SELECT mv.session_id, (total_movements % 3)::INT AS label, ordinal::INT AS step, coalesce(di, 0)::DOUBLE AS f0,
  coalesce(dist, 0) / greatest(coalesce(di, 0) + 1, 1) AS f1, (ordinal - 1)::DOUBLE / (n - 1) AS f2, coordinate_entropy / 4 AS f3,
  coordinate_entropy / 3 AS f4 FROM mv JOIN mo USING (session_id) WHERE n >= 2 AND ordinal <= 50)"""
SUMS5 = ", ".join(f"{R(f'sum(f{i})')} AS s{i}" for i in range(5))


@query("seq01_mouse_steps", motion_sql(f"SELECT session_id, label, step, {Rs('f0 f1 f2 f3 f4')} FROM ms", MOUSE_STEPS))
def _(spark, folder):
    steps = sequences.mouse_steps(bindings.moves(spark, folder), trace_lookup(spark, folder))
    return rounded(steps.select("session_id", "label", "step", *[F.col("features")[i].alias(f"f{i}") for i in range(5)]))


@query("seq01_mouse_sequences", motion_sql(f"SELECT session_id, label, 50 AS length, {SUMS5} FROM ms GROUP BY 1, 2", MOUSE_STEPS))
def _(spark, folder):
    seq = sequences.mouse_sequences(bindings.moves(spark, folder), trace_lookup(spark, folder))
    total = lambda i: F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[i]).alias(f"s{i}")
    return rounded(seq.select("session_id", "label", F.size("steps").alias("length"), *[total(i) for i in range(5)]))


CLICK_STEPS = """cs0 AS (SELECT ev.session_id, label, interval_us / 1e6 AS f0, row_number() OVER w AS step, count(*) OVER (PARTITION BY ev.session_id) AS n,
  device_entropy AS f4, channel_entropy AS f5 FROM ev JOIN s USING (session_id) WINDOW w AS (PARTITION BY ev.session_id ORDER BY click_time, event_id)),
cs AS (SELECT session_id, label, step::INT AS step, f0, least(step, 5)::DOUBLE AS f1, CASE WHEN n > 1 THEN (step - 1)::DOUBLE / (n - 1) ELSE 0 END AS f2,
  coalesce(stddev_samp(f0) OVER (PARTITION BY session_id ORDER BY step ROWS 4 PRECEDING), 0) AS f3, f4, f5 FROM cs0),
cp AS (SELECT session_id, label, g.step::INT AS step, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3,
  coalesce(f4, 0) AS f4, coalesce(f5, 0) AS f5 FROM (SELECT DISTINCT session_id, label FROM cs) k CROSS JOIN range(0, 50) g(step)
  LEFT JOIN (SELECT * EXCLUDE (label) REPLACE (step - 1 AS step) FROM cs) USING (session_id, step))"""


def click_seq(spark, folder, length=50):
    lookup = profiled(spark, folder)
    return sequences.click_sequences(events(spark, folder), lookup, length)


@query("seq02_click_steps", sess(f"SELECT session_id, label, step, {Rs('f0 f1 f2 f3 f4 f5')} FROM cs WHERE step <= 50", CLICK_STEPS))
def _(spark, folder):
    steps = sequences.click_steps(events(spark, folder), profiled(spark, folder))
    return rounded(steps.select("session_id", "label", "step", *[F.col("features")[i].alias(f"f{i}") for i in range(6)]))


@query("seq04_zero_padded", sess(f"SELECT session_id, label, 'click-mode' AS sequence_type, step, {Rs('f0 f1 f2 f3 f4 f5')} FROM cp", CLICK_STEPS))
def _(spark, folder):
    return rounded(sequences.explode_steps(click_seq(spark, folder), 6))


@query(
    "seq05_repeat_padded",
    prof(f"""SELECT session_id, g.i::INT AS step, {R('mouse_speed_mean')} AS f0, {R('mouse_path_length')} AS f1, {R('coordinate_entropy')} AS f2
FROM sc CROSS JOIN range(0, 10) g(i)"""),
)
def _(spark, folder):
    seq = sequences.feature_row_sequences(profiled(spark, folder), ["mouse_speed_mean", "mouse_path_length", "coordinate_entropy"], 10, ["session_id"])
    return rounded(sequences.explode_steps(seq, 3))


@query(
    "seq06_key_histories",
    f"""WITH {CLICKS}, h AS (SELECT ip, app, is_attributed, row_number() OVER (PARTITION BY ip ORDER BY click_time DESC, event_id DESC) AS back FROM clicks),
l AS (SELECT ip, app, is_attributed, row_number() OVER (PARTITION BY ip ORDER BY back DESC) - 1 AS step FROM h WHERE back <= 10)
SELECT k.ip, g.step::INT AS step, {R('coalesce(app, 0)')} AS f0, {R('coalesce(is_attributed, 0)')} AS y
FROM (SELECT DISTINCT ip FROM clicks) k CROSS JOIN range(0, 10) g(step) LEFT JOIN l ON l.ip = k.ip AND l.step = g.step""",
)
def _(spark, folder):
    rows = bindings.clicks(spark, folder)
    seq = sequences.key_history_sequences(rows, "ip", ["click_time", "event_id"], ["app"], "is_attributed", 10)
    both = seq.select("ip", F.zip_with("steps", "targets", lambda s, t: F.concat(s, t)).alias("steps"))
    return rounded(sequences.explode_steps(both, 2).withColumnRenamed("f1", "y"))


@query(
    "seq07_combined_modes",
    prof(
        f"""SELECT session_id, label, 'click-mode' AS sequence_type, 6 AS width, {R('sum(f3)')} AS s3, {R('sum(f5)')} AS s5 FROM cs WHERE step <= 50 GROUP BY 1, 2
UNION ALL SELECT session_id, label, 'mouse-mode', 6, {R('sum(f3)')}, {R('0')} FROM ms GROUP BY 1, 2""",
        CLICK_STEPS, MOVES, MOTION, MOUSE_STEPS,
    ),
)
def _(spark, folder):
    mouse = sequences.mouse_sequences(bindings.moves(spark, folder), trace_lookup(spark, folder))
    both = sequences.combine_modes(click_seq(spark, folder), mouse, width=6)
    total = lambda i: F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[i]).alias(f"s{i}")
    width = F.array_max(F.transform("steps", lambda s: F.size(s))).alias("width")
    return rounded(both.select("session_id", "label", "sequence_type", width, total(3), total(5)))


SCALED = ", ".join(
    R(f"(f{i} - avg(f{i}) OVER ()) / CASE WHEN stddev_pop(f{i}) OVER () > 1e-12 THEN stddev_pop(f{i}) OVER () ELSE 1 END") + f" AS f{i}" for i in range(6)
)


@query("seq08_standardised", sess(f"SELECT session_id, label, 'click-mode' AS sequence_type, step, {SCALED} FROM cp", CLICK_STEPS))
def _(spark, folder):
    seq = click_seq(spark, folder)
    scaled = sequences.standardise_steps(seq, sequences.fit_step_scaler(seq, 6))
    return rounded(sequences.explode_steps(scaled, 6))


def legacy_steps(spark, folder):
    """Traces as the older six-feature tensors (x, y, speed, click, scroll, time), ten steps each."""
    from sessionloom.plans.chunks import ordered_points

    p = ordered_points(bindings.moves(spark, folder), "session_id", "movement_index", "tie", "x_coordinate", "y_coordinate")
    speed = F.coalesce(F.hypot(F.col("x_coordinate") - F.col("x1"), F.col("y_coordinate") - F.col("y1")), F.lit(0.0))
    features = F.array(
        "x_coordinate", "y_coordinate", speed, F.lit(1.0), (F.col("x_coordinate") % 2).cast("double"), F.col("movement_index").cast("double")
    )
    rows = p.filter("ordinal <= 10").select(
        "session_id", (F.col("n") % 2).cast("int").alias("label"), F.lit("legacy").alias("sequence_type"), F.col("ordinal").cast("int").alias("step"),
        features.alias("features"),
    )
    return sequences.zero_pad(sequences.gather_steps(rows), 10, 6)


LEGACY_STEPS = """lk AS (SELECT session_id, (any_value(n) % 2)::INT AS label, list(x ORDER BY ordinal) AS xs, list(y ORDER BY ordinal) AS ys,
  list(coalesce(dist, 0) ORDER BY ordinal) AS ds, list(movement_index ORDER BY ordinal) AS ms, least(count(*), 10) AS len FROM mv WHERE ordinal <= 10 GROUP BY 1),
lp AS (SELECT *, CASE WHEN step < len THEN xs[step + 1] ELSE 0 END AS x, CASE WHEN step < len THEN ys[step + 1] ELSE 0 END AS y,
  CASE WHEN step < len THEN ms[step + 1] ELSE 0 END AS m, greatest(step - 1, 0) AS back FROM (SELECT *, unnest(range(0, 10)) AS step FROM lk)),
lw AS (SELECT *, CASE WHEN back < len THEN xs[back + 1] ELSE 0 END AS px, CASE WHEN back < len THEN ys[back + 1] ELSE 0 END AS py,
  CASE WHEN back < len THEN ms[back + 1] ELSE 0 END AS pm,
  list_transform(range(greatest(step - 4, 0), step + 1), lambda i: CASE WHEN i < len THEN ds[i + 1] ELSE 0 END) AS win FROM lp),
le AS (SELECT *, list_min(win) AS lo, list_max(win) AS hi, least(6, greatest(2, len(win))) AS k FROM lw),
ls AS (SELECT *, list_transform(win, lambda v: CASE WHEN lo = hi THEN 0 ELSE least(floor((v - lo) / (hi - lo) * k), k - 1) END) AS slots FROM le),
lf AS (SELECT session_id, label, step, (m - pm)::DOUBLE AS f0, win[len(win)] AS f1, atan2(y - py, x - px) AS f2, CASE WHEN step < len THEN 1.0 ELSE 0.0 END AS f3,
  CASE WHEN step < len THEN x % 2 ELSE 0 END AS f4, -list_sum(list_transform(range(0, 6), lambda i: CASE WHEN len(list_filter(slots, lambda s: s = i)) = 0 THEN 0
  ELSE len(list_filter(slots, lambda s: s = i)) / len(slots)::DOUBLE * log2(len(list_filter(slots, lambda s: s = i)) / len(slots)::DOUBLE + 1e-12) END)) AS f5 FROM ls)"""


@query(
    "seq10_remapped_legacy_steps",
    motion_sql(f"SELECT session_id, label, 'legacy' AS sequence_type, step::INT AS step, {Rs('f0 f1 f2 f3 f4 f5')} FROM lf", LEGACY_STEPS),
)
def _(spark, folder):
    out = sequences.remap_legacy_steps(legacy_steps(spark, folder))
    return rounded(sequences.explode_steps(out, 6))


@query(
    "seq11_balanced_sequences",
    prof(f"""SELECT session_id, label FROM (SELECT session_id, label, row_number() OVER (PARTITION BY label ORDER BY {U('session_id', 'sequence')}, session_id) AS r FROM sc)
WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM sc GROUP BY label))"""),
)
def _(spark, folder):
    seq = click_seq(spark, folder)
    return sequences.balance_sequences(seq).select("session_id", "label")
