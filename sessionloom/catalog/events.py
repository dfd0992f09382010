"""Queries over click events and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.catalog.base import (
    CLICKS, GAP_MINUTES, H, N, PROXY, R, Rs, S, SCORE, U, clicks, ev_sql, events, prof, profiled, profiled_now, query, rounded,
    score_sql, sess, staged, stamp, temporal, with_label,
)
from sessionloom.functions import columns as C
from sessionloom.operators import enrich, ranks, sequences, sessions
from sessionloom.plans import cuts

SESSION_DOUBLES = (
    "click_interval_mean click_interval_std click_interval_median session_duration_sec device_entropy channel_entropy "
    "app_entropy click_interval_entropy request_interval_entropy request_interval_mean request_interval_std "
    "clicks_per_minute requests_per_minute session_idle_ratio success_rate"
)
SESSION_PLAIN = (
    "session_id, click_count, install_count, original_ip, original_device, original_os, app, device, os, channel, "
    "total_requests, successful_requests, logs_count, activity_date, time_range"
)


def _sessionized(spark, folder, gap):
    out = events(spark, folder, gap)
    return rounded(out.select("event_id", "session_gap_sec", "new_session", "session_index", "session_id"))


def _sessionized_sql(gap):
    return f"""WITH {CLICKS}, {ev_sql(gap)}
SELECT event_id, {R(f'CASE WHEN d IS NULL THEN {gap * 60 + 1} ELSE d / 1e6 END')} AS session_gap_sec, new_session,
  session_index, session_id FROM ev"""


@query("win01_sessionize_30min", _sessionized_sql(30))
def _(spark, folder):
    return _sessionized(spark, folder, 30)


@query("win01_sessionize_6h", _sessionized_sql(360))
def _(spark, folder):
    return _sessionized(spark, folder, 360)


@query(
    "win01_sessionize_by_address",
    f"""WITH {CLICKS}, k AS (SELECT *, epoch_us(click_time) - lag(epoch_us(click_time)) OVER w AS d FROM clicks
  WINDOW w AS (PARTITION BY ip ORDER BY click_time, event_id))
SELECT event_id, ('u_' || ip || '_' || sum(CASE WHEN d IS NULL OR d > 7200000000 THEN 1 ELSE 0 END) OVER (
  PARTITION BY ip ORDER BY click_time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT) AS session_id FROM k""",
)
def _(spark, folder):
    out = sessions.sessionize(clicks(spark, folder), keys=("ip",), gap_minutes=120, prefix="u")
    return out.select("event_id", "session_id")


@query(
    "win02_gap_seconds",
    f"""WITH {CLICKS} SELECT event_id, {R('''coalesce(epoch_us(click_time) - lag(epoch_us(click_time)) OVER (
      PARTITION BY ip ORDER BY click_time, event_id), 0) / 1e6''')} AS gap_sec FROM clicks""",
)
def _(spark, folder):
    from sessionloom.plans.chunks import time_gaps

    rows = clicks(spark, folder)
    gaps = time_gaps(rows, ["ip"], "click_time", "event_id")
    gap = F.when(F.col("event_id") == F.col("first_tie"), F.coalesce("gap_us", F.lit(0))).otherwise(0) / 1e6
    return rounded(rows.join(gaps, ["ip", "click_time"]).select("event_id", gap.alias("gap_sec")))


@query(
    "agg01_session_aggregate",
    f"""WITH {CLICKS}, {ev_sql()} SELECT session_id, count(*) AS event_count, {S('min(click_time)')} AS session_start,
  {S('max(click_time)')} AS session_end, {R('greatest((epoch_us(max(click_time)) - epoch_us(min(click_time))) / 1e6, 1)')} AS session_duration_sec
FROM ev GROUP BY session_id""",
)
def _(spark, folder):
    out = sessions.session_aggregate(events(spark, folder))
    return rounded(stamp(out, "session_start", "session_end"))


@query(
    "agg02_session_temporal_features",
    sess(f"SELECT {SESSION_PLAIN}, {S('session_start')} AS session_start, {S('session_end')} AS session_end, {Rs(SESSION_DOUBLES)} FROM s"),
)
def _(spark, folder):
    return rounded(stamp(temporal(spark, folder), "session_start", "session_end"))


@query(
    "agg04_basic_aggregates",
    f"""WITH {CLICKS} SELECT channel, count(*) AS n, sum(is_attributed)::BIGINT AS installs, min(app) AS app_min,
  max(app) AS app_max, {R('avg(app)')} AS app_mean FROM clicks GROUP BY channel""",
)
def _(spark, folder):
    out = clicks(spark, folder).groupBy("channel").agg(
        F.count("*").alias("n"),
        F.sum("is_attributed").alias("installs"),
        F.min("app").alias("app_min"),
        F.max("app").alias("app_max"),
        F.avg("app").alias("app_mean"),
    )
    return rounded(out)


@query(
    "agg05_deterministic_mode",
    f"""WITH {CLICKS} SELECT ip, app, channel FROM (
  SELECT ip, app, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, app) AS rn FROM clicks GROUP BY ip, app) a
JOIN (SELECT ip, channel, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, channel) AS rn FROM clicks GROUP BY ip, channel) c
USING (ip) WHERE a.rn = 1 AND c.rn = 1""",
)
def _(spark, folder):
    # counts of the (small) value domains first; the mode then reads one row per value
    rows = clicks(spark, folder)
    cells = F.inline(F.array(
        F.struct(F.lit("app").alias("dim"), F.col("app").alias("num"), F.lit(None).cast("string").alias("txt")),
        F.struct(F.lit("channel").alias("dim"), F.lit(None).cast("long").alias("num"), F.col("channel").alias("txt")),
    ))
    counts = rows.select("ip", cells).groupBy("ip", "dim", "num", "txt").agg(F.count("*").alias("n"))
    pick = lambda d, c: F.min(F.when(F.col("dim") == d, F.struct(-F.col("n"), F.col(c).alias("v"))))["v"]
    return counts.filter("num is not null or txt is not null").groupBy("ip").agg(
        pick("app", "num").alias("app"), pick("channel", "txt").alias("channel")
    )


@query(
    "agg06_interval_statistics",
    sess(f"SELECT session_id, {Rs('click_interval_mean click_interval_std click_interval_median')} FROM s"),
)
def _(spark, folder):
    out = temporal(spark, folder)
    return rounded(out.select("session_id", "click_interval_mean", "click_interval_std", "click_interval_median"))


@query(
    "agg07_categorical_entropy",
    sess(f"SELECT session_id, {Rs('device_entropy channel_entropy app_entropy')} FROM s"),
)
def _(spark, folder):
    out = temporal(spark, folder)
    return rounded(out.select("session_id", "device_entropy", "channel_entropy", "app_entropy"))


@query("agg08_interval_entropy", sess(f"SELECT session_id, {Rs('click_interval_entropy')} FROM s"))
def _(spark, folder):
    return rounded(temporal(spark, folder).select("session_id", "click_interval_entropy"))


@query(
    "joi01_aggregate_with_intervals",
    sess(f"""SELECT a.session_id, a.event_count, {R('a.d')} AS session_duration_sec, {R('s.click_interval_mean')} AS click_interval_mean
FROM (SELECT session_id, count(*) AS event_count, greatest((epoch_us(max(click_time)) - epoch_us(min(click_time))) / 1e6, 1) AS d
  FROM ev GROUP BY 1) a LEFT JOIN s USING (session_id)"""),
)
def _(spark, folder):
    ev = events(spark, folder)
    stats = ev.groupBy("session_id").agg((F.avg("interval_us") / 1e6).alias("click_interval_mean"))
    out = sessions.session_aggregate(ev).join(stats, "session_id", "left")
    return rounded(out.select("session_id", "event_count", "session_duration_sec", "click_interval_mean"))


# --- windows inside a session ------------------------------------------------------------

STEPS = f"""WITH {CLICKS}, {ev_sql()},
st AS (SELECT session_id, event_id, interval_us / 1e6 AS pause, row_number() OVER w AS step, count(*) OVER (PARTITION BY session_id) AS n
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY click_time, event_id))"""


def step_rows(spark, folder, length=10**9):
    ev = events(spark, folder)
    sized = ev.groupBy("session_id").agg(F.lit(0).alias("label"), F.lit(0.0).alias("device_entropy"), F.lit(0.0).alias("channel_entropy"))
    return sequences.click_steps(ev, sized, length)


@query("win04_rolling_count", STEPS + " SELECT session_id, step, count(*) OVER (PARTITION BY session_id ORDER BY step ROWS 4 PRECEDING) AS rolling_n FROM st")
def _(spark, folder):
    out = step_rows(spark, folder)
    return out.select("session_id", F.col("step").cast("long").alias("step"), F.col("features")[1].cast("long").alias("rolling_n"))


@query(
    "win05_rolling_std",
    STEPS + f""" SELECT session_id, step, {R('coalesce(stddev_samp(pause) OVER (PARTITION BY session_id ORDER BY step ROWS 4 PRECEDING), 0)')} AS rolling_std
FROM st""",
)
def _(spark, folder):
    out = step_rows(spark, folder)
    return rounded(out.select("session_id", F.col("step").cast("long").alias("step"), F.col("features")[3].alias("rolling_std")))


@query(
    "win06_rolling_entropy",
    STEPS + f""", r AS (SELECT session_id, step, pause, (unnest(list(pause) OVER (PARTITION BY session_id ORDER BY step ROWS 4 PRECEDING))) AS v FROM st),
b AS (SELECT session_id, step, v, min(v) OVER p AS lo, max(v) OVER p AS hi, least(6, greatest(2, count(*) OVER p)) AS k FROM r
  WINDOW p AS (PARTITION BY session_id, step)),
c AS (SELECT session_id, step, CASE WHEN lo = hi THEN 0 ELSE least(floor((v - lo) / (hi - lo) * k), k - 1) END AS slot FROM b),
q AS (SELECT session_id, step, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY session_id, step) AS p FROM c GROUP BY session_id, step, slot)
SELECT session_id, step, {R('-sum(p * log2(p + 1e-12))')} AS rolling_entropy FROM q GROUP BY session_id, step""",
)
def _(spark, folder):
    rows = step_rows(spark, folder).withColumn("pause", F.col("features")[0])
    w = W.partitionBy("session_id").orderBy("step").rowsBetween(-4, 0)
    out = rows.withColumn("last5", F.collect_list("pause").over(w))
    out = out.select("session_id", F.col("step").cast("long").alias("step"), sequences.rolling_entropy(F.col("last5")).alias("rolling_entropy"))
    return rounded(out)


@query("win07_session_progress", STEPS + f" SELECT session_id, step, {R('CASE WHEN n = 1 THEN 0 ELSE (step - 1)::DOUBLE / (n - 1) END')} AS progress FROM st")
def _(spark, folder):
    out = step_rows(spark, folder)
    return rounded(out.select("session_id", F.col("step").cast("long").alias("step"), F.col("features")[2].alias("progress")))


@query("win13_first_steps", STEPS + " SELECT session_id, step, event_id FROM st WHERE step <= 3")
def _(spark, folder):
    order = W.partitionBy("session_id").orderBy("click_time", "event_id")
    out = events(spark, folder).withColumn("step", F.row_number().over(order).cast("long")).filter("step <= 3")
    return out.select("session_id", "step", "event_id")


# --- event features and labels -----------------------------------------------------------

FEATURES = f"""ef0 AS (
  SELECT *, count(*) OVER (PARTITION BY ip) AS ip_click_frequency, count(*) OVER (PARTITION BY device) AS device_click_frequency,
    (sum(is_attributed) OVER (PARTITION BY ip))::BIGINT AS ip_install_count,
    (sum(is_attributed) OVER (PARTITION BY device))::BIGINT AS device_install_count,
    count(*) OVER (PARTITION BY ip, device, channel) AS combo_n,
    coalesce((epoch_us(click_time) - lag(epoch_us(click_time)) OVER (PARTITION BY ip ORDER BY click_time, event_id)) / 1e6, 0) AS ip_time_gap_sec
  FROM clicks),
ef AS (
  SELECT *, ip_install_count / ip_click_frequency AS ip_install_rate, combo_n / ip_click_frequency AS combo_repeat_rate,
    1.0 - least(combo_n / ip_click_frequency, 1.0) AS non_repetitive_combo_score FROM ef0)"""

FLAGS = """q AS (
  SELECT quantile_cont(ip_click_frequency, 0.99) AS hi_ip, quantile_cont(device_click_frequency, 0.99) AS hi_dev,
    greatest(0.5, quantile_cont(ip_time_gap_sec, 0.05)) AS low_gap,
    quantile_cont(non_repetitive_combo_score, 0.10) AS low_div FROM ef),
fl AS (
  SELECT ef.*, CASE WHEN is_attributed = 0 AND (
      (ip_click_frequency >= hi_ip AND ip_install_count = 0 AND ip_time_gap_sec <= low_gap)
      OR (device_click_frequency >= hi_dev AND device_install_count = 0 AND non_repetitive_combo_score < low_div))
    THEN 1 ELSE 0 END AS label FROM ef, q)"""


def busy_clicks(spark, folder):
    return staged(spark, folder, "busy_clicks", _busy_clicks)


def _busy_clicks(spark, folder):
    """Click features where installs of busy keys are blanked, so that the flag rule has hits."""
    feats = sessions.event_features(clicks(spark, folder))
    return feats.withColumns(
        {
            "ip_install_count": F.when(F.col("ip") % 2 == 0, 0).otherwise(F.col("ip_install_count")),
            "device_install_count": F.when(F.col("device") == 0, 0).otherwise(F.col("device_install_count")),
        }
    )


BUSY = """ef1 AS (SELECT * REPLACE (CASE WHEN ip % 2 = 0 THEN 0 ELSE ip_install_count END AS ip_install_count,
  CASE WHEN device = 0 THEN 0 ELSE device_install_count END AS device_install_count) FROM ef)"""


@query(
    "dom04_event_features",
    f"""WITH {CLICKS}, {FEATURES} SELECT event_id, year(click_time)::INT AS year, month(click_time)::INT AS month, day(click_time)::INT AS day,
  hour(click_time)::INT AS hour, minute(click_time)::INT AS minute, second(click_time)::INT AS second,
  ip_click_frequency, device_click_frequency, ip_install_count, device_install_count,
  {Rs('ip_install_rate ip_time_gap_sec combo_repeat_rate non_repetitive_combo_score')} FROM ef""",
)
def _(spark, folder):
    out = sessions.event_features(clicks(spark, folder))
    return rounded(out.drop("ip", "app", "device", "os", "channel", "click_time", "is_attributed"))


@query(
    "win03_joi05_group_totals",
    f"""WITH {CLICKS} SELECT event_id, count(*) OVER (PARTITION BY device) AS device_n,
  (sum(is_attributed) OVER (PARTITION BY device))::BIGINT AS device_installs FROM clicks""",
)
def _(spark, folder):
    from sessionloom.operators.structure import group_totals

    out = group_totals(clicks(spark, folder), "device", {"device_n": F.count("*"), "device_installs": F.sum("is_attributed")})
    return out.select("event_id", "device_n", "device_installs")


@query(
    "dom05_label_events",
    f"""WITH {CLICKS}, {FEATURES}, {BUSY}, {FLAGS.replace('FROM ef),', 'FROM ef1),').replace('ef.*', 'ef1.*').replace('FROM ef, q', 'FROM ef1, q')}
SELECT event_id, label, 1 - label AS human_heuristic, label AS possible_bot_heuristic,
  CASE WHEN label = 1 THEN 'possible_bot' ELSE 'human' END AS behavior_class FROM fl""",
)
def _(spark, folder):
    out = sessions.label_events(busy_clicks(spark, folder))
    return out.select("event_id", "label", "human_heuristic", "possible_bot_heuristic", "behavior_class")


ROLLUP = f"""cx AS (
  SELECT session_id, max(ip_click_frequency) AS ip_click_frequency, max(device_click_frequency) AS device_click_frequency,
    max(ip_install_rate) AS ip_install_rate, avg(combo_repeat_rate) AS combo_repeat_rate, avg(1 - fl.label) AS human_event_ratio,
    avg(fl.label) AS possible_bot_ratio FROM ev JOIN fl USING (event_id) GROUP BY session_id),
ru AS (SELECT s.* EXCLUDE (label) REPLACE (coalesce(click_interval_std, 0) AS click_interval_std), cx.* EXCLUDE (session_id),
  year(session_start)::INT AS year, hour(session_start)::INT AS hour FROM s JOIN cx USING (session_id))"""
BUSY_FLAGS = FLAGS.replace("FROM ef),", "FROM ef1),").replace("ef.*", "ef1.*").replace("FROM ef, q", "FROM ef1, q")


def rollup(spark, folder):
    return staged(spark, folder, "rollup", _rollup)


def _rollup(spark, folder):
    labelled = sessions.label_events(busy_clicks(spark, folder))
    ev = sessions.sessionize(labelled, gap_minutes=GAP_MINUTES)
    return sessions.session_rollup_with_context(ev, sessions.CLICK_KEYS)


@query(
    "agg03_session_rollup_with_context",
    sess(
        f"""SELECT session_id, click_count, install_count, app, channel, ip_click_frequency, device_click_frequency, year, hour,
  {Rs('ip_install_rate combo_repeat_rate human_event_ratio possible_bot_ratio click_interval_mean click_interval_std requests_per_minute session_duration_sec channel_entropy')} FROM ru""",
        FEATURES, BUSY, BUSY_FLAGS, ROLLUP,
    ),
)
def _(spark, folder):
    out = rollup(spark, folder)
    return rounded(
        out.select(
            "session_id", "click_count", "install_count", "app", "channel", "ip_click_frequency", "device_click_frequency",
            "year", "hour", "ip_install_rate", "combo_repeat_rate", "human_event_ratio", "possible_bot_ratio",
            "click_interval_mean", "click_interval_std", "requests_per_minute", "session_duration_sec", "channel_entropy",
        )
    )


RATIO = """lr AS (SELECT ru.*, CASE WHEN install_count > 0 THEN 0 WHEN possible_bot_ratio >= 0.5
  OR requests_per_minute >= (SELECT quantile_cont(requests_per_minute, 0.99) FROM ru) THEN 1 ELSE 0 END AS label FROM ru)"""


@query(
    "dom06_label_sessions_by_ratio",
    sess(
        """SELECT session_id, label, CASE WHEN label = 1 THEN 'talkingdata_possible_bot' ELSE 'talkingdata_human' END AS bot_type FROM lr""",
        FEATURES, BUSY, BUSY_FLAGS, ROLLUP, RATIO,
    ),
)
def _(spark, folder):
    out = sessions.label_sessions_by_ratio(rollup(spark, folder))
    return out.select("session_id", "label", "bot_type")


@query(
    "dom07_label_sessions_by_install",
    sess("""SELECT session_id, CASE WHEN install_count > 0 THEN 0 END AS label, install_count > 0 AS candidate_human,
  CASE WHEN install_count > 0 THEN 'human' ELSE 'unknown' END AS bot_type FROM s"""),
)
def _(spark, folder):
    out = sessions.label_sessions_by_install(temporal(spark, folder))
    return out.select("session_id", "label", "candidate_human", "bot_type")


@query(
    "fil03_split_by_flag",
    sess("SELECT install_count > 0 AS candidate_human, count(*) AS n, sum(click_count)::BIGINT AS clicks FROM s GROUP BY 1"),
)
def _(spark, folder):
    human, unknown = sessions.split_by_flag(sessions.label_sessions_by_install(temporal(spark, folder)), "candidate_human")
    size = lambda df: df.groupBy("candidate_human").agg(F.count("*").alias("n"), F.sum("click_count").alias("clicks"))
    return size(human).unionByName(size(unknown))


# --- scores and proxies ------------------------------------------------------------------

PROXY_COLUMNS = (
    "mouse_speed_mean mouse_speed_std mouse_path_length coordinate_entropy movement_std mouse_acceleration_std movement_curvature"
)


@query("dom08_behavioural_proxies", prof(f"SELECT session_id, direction_change_count, {Rs(PROXY_COLUMNS)} FROM sc"))
def _(spark, folder):
    out = enrich.behavioural_proxies(temporal(spark, folder))
    return rounded(out.select("session_id", "direction_change_count", *PROXY_COLUMNS.split()))


@query("dom02_bot_score", prof("SELECT session_id, bot_likelihood_score FROM sc"))
def _(spark, folder):
    return profiled_now(spark, folder).select("session_id", "bot_likelihood_score")


@query(
    "dom03_bot_score_quantile",
    prof(f"""SELECT session_id, {R('''2.2 * (requests_per_minute > q95)::INT + 1.6 * (coordinate_entropy < e10)::INT
  + 1.4 * (mouse_speed_std < s10)::INT + 1.1 * label''')} AS bot_likelihood_score FROM sc, (
  SELECT quantile_cont(requests_per_minute, 0.95) AS q95, quantile_cont(coordinate_entropy, 0.10) AS e10,
    quantile_cont(mouse_speed_std, 0.10) AS s10 FROM sc)"""),
)
def _(spark, folder):
    out = enrich.bot_score_quantile(profiled(spark, folder))
    return rounded(out.select("session_id", "bot_likelihood_score"))


@query(
    "top_sessions_by_score",
    prof(f"SELECT session_id, click_count, bot_likelihood_score, {Rs('requests_per_minute')} FROM sc ORDER BY bot_likelihood_score DESC, session_id LIMIT 20"),
)
def top_sessions(spark, folder):
    out = profiled_now(spark, folder).orderBy(F.desc("bot_likelihood_score"), "session_id").limit(20)
    return rounded(out.select("session_id", "click_count", "bot_likelihood_score", "requests_per_minute"))
