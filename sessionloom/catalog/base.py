"""Registry of named queries, shared inputs and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators import enrich, motion, sessions
from sessionloom.session import materialise
from sessionloom.sources import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GAP_MINUTES = 360


def query(name: str, sql: str | None = None):
    """Register a callable under a name, with the SQL it must agree with."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded off the tie points that microsecond timestamps produce."""
    shift = 3e-8 if digits == 6 else 3 * 10.0 ** (-digits - 2)
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(shift), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def R(expr: str, digits: int = 6) -> str:
    shift = "3e-8" if digits == 6 else f"{3 * 10.0 ** (-digits - 2):.12f}"
    return f"round(({expr}) + {shift}, {digits})"


def Rs(columns: str | list[str], digits: int = 6) -> str:
    """Rounded select list of plain columns."""
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"{R(c, digits)} AS {c}" for c in names)


def stamp(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so both engines print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def S(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def H(text: str) -> str:
    """SQL of the 48-bit hash fraction."""
    return f"(('0x' || substr(sha256({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def U(key: str, salt: str) -> str:
    return H(f"{key} || '|{salt}'")


def N(key: str, salt: str) -> str:
    return f"(sqrt(-2.0 * ln(greatest({U(key, salt + ':a')}, 1e-12))) * cos(2.0 * pi() * {U(key, salt + ':b')}))"


def choice_sql(draw: str, weights: dict[str, float]) -> str:
    total, running, parts = sum(weights.values()), 0.0, []
    values = list(weights)
    for v in values[:-1]:
        running += weights[v]
        parts.append(f"WHEN {draw} < {round(running / total, 12)!r} THEN '{v}'")
    return f"(CASE {' '.join(parts)} ELSE '{values[-1]}' END)"


# --- inputs ------------------------------------------------------------------------------


def clicks(spark, folder):
    return bindings.clicks(spark, folder)


def events(spark, folder, gap: int = GAP_MINUTES):
    return sessions.sessionize(bindings.clicks(spark, folder), gap_minutes=gap)


def temporal(spark, folder, gap: int = GAP_MINUTES):
    return sessions.session_temporal_features(events(spark, folder, gap), keys=sessions.CLICK_KEYS)


def with_label(df):
    return df.withColumn(
        "label", F.when(F.col("install_count") > 0, 0).when(F.col("click_count") >= 2, 1).otherwise(2)
    )


_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark, folder, name, build) -> DataFrame:
    """Stage table of this application: built from the given tables once, then read back.

    Cleaning, profiling, sampling and training all start from the written session table;
    they scan it several times and must not redo the sessions for every scan.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGES:
        _STAGES[key] = materialise(build(spark, folder), name)
    return _STAGES[key]


def profiled_now(spark, folder):
    """Labelled sessions with proxies and score."""
    return enrich.with_score(enrich.behavioural_proxies(with_label(temporal(spark, folder))))


def profiled(spark, folder):
    return staged(spark, folder, "profiled", profiled_now)


def enriched(spark, folder):
    """The profiled table with device and network columns."""
    return staged(spark, folder, "enriched", lambda s, f: enrich.device_network_enrich(profiled(s, f)))


def traces(spark, folder):
    """Motion features per trace."""
    return staged(spark, folder, "traces", lambda s, f: motion.motion_features(bindings.moves(s, f)))


# --- SQL fragments -----------------------------------------------------------------------

CLICKS = """clicks AS (
  SELECT event_id, user_id AS ip, CAST(props->>'$.k' AS BIGINT) % 10 AS app, user_id % 3 AS device,
         user_id % 4 AS os, event_type AS channel, ts AS click_time,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_attributed
  FROM events)"""


def ev_sql(gap_minutes: int = GAP_MINUTES, source: str = "clicks") -> str:
    limit = gap_minutes * 60_000_000
    return f"""g AS (
  SELECT *, epoch_us(click_time) - lag(epoch_us(click_time)) OVER (
    PARTITION BY ip, device, os ORDER BY click_time, event_id) AS d FROM {source}),
f AS (SELECT *, CASE WHEN d IS NULL OR d > {limit} THEN 1 ELSE 0 END AS new_session FROM g),
x AS (SELECT *, sum(new_session) OVER (
    PARTITION BY ip, device, os ORDER BY click_time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_index FROM f),
ev AS (SELECT *, 'td_' || ip || '_' || device || '_' || os || '_' || session_index AS session_id,
    CASE WHEN new_session = 1 THEN 0 ELSE d END AS interval_us FROM x)"""


def entropy_sql(column: str, source: str = "ev", key: str = "session_id") -> str:
    return f"""(SELECT {key}, -sum(p * log2(p + 1e-12)) AS h FROM (
      SELECT {key}, {column}, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {key}) AS p
      FROM {source} WHERE {column} IS NOT NULL GROUP BY {key}, {column}) GROUP BY {key})"""


def mode_sql(column: str) -> str:
    return f"""(SELECT session_id, {column} AS v FROM (
      SELECT session_id, {column}, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, {column}) AS rn
      FROM ev WHERE {column} IS NOT NULL GROUP BY session_id, {column}) WHERE rn = 1)"""


def hist_entropy_sql(column: str, bins: int, source: str, key: str = "session_id") -> str:
    return f"""(SELECT {key}, -sum(p * log2(p + 1e-12)) AS h FROM (
      SELECT {key}, b, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {key}) AS p FROM (
        SELECT {key}, CASE WHEN lo = hi THEN 0 ELSE least(floor(({column} - lo)::DOUBLE / (hi - lo)::DOUBLE * {bins}), {bins - 1}) END AS b
        FROM (SELECT {key}, {column}, min({column}) OVER (PARTITION BY {key}) AS lo, max({column}) OVER (PARTITION BY {key}) AS hi
              FROM {source})) GROUP BY {key}, b) GROUP BY {key})"""


TEMPORAL = f"""base AS (
  SELECT session_id, min(click_time) AS session_start, max(click_time) AS session_end, count(*) AS click_count,
    sum(is_attributed)::BIGINT AS install_count, min(ip) AS original_ip, min(device) AS original_device,
    min(os) AS original_os, avg(interval_us) / 1e6 AS click_interval_mean,
    stddev_samp(interval_us) / 1e6 AS click_interval_std, quantile_cont(interval_us, 0.5) / 1e6 AS click_interval_median,
    greatest((epoch_us(max(click_time)) - epoch_us(min(click_time))) / 1e6, 1.0) AS session_duration_sec
  FROM ev GROUP BY session_id),
s AS (
  SELECT base.*, ma.v AS app, base.original_device AS device, base.original_os AS os, mc.v AS channel,
    hd.h AS device_entropy, hc.h AS channel_entropy, ha.h AS app_entropy, hi.h AS click_interval_entropy,
    hi.h AS request_interval_entropy, click_count AS total_requests, install_count AS successful_requests,
    click_count AS logs_count, click_interval_mean AS request_interval_mean,
    coalesce(click_interval_std, 0) AS request_interval_std,
    click_count / (session_duration_sec / 60.0) AS clicks_per_minute,
    click_count / (session_duration_sec / 60.0) AS requests_per_minute,
    least(greatest(coalesce(click_interval_std, 0) / (session_duration_sec + 1e-6), 0), 1) AS session_idle_ratio,
    strftime(session_start, '%Y-%m-%d') AS activity_date,
    strftime(session_start, '%H:%M:%S') || '-' || strftime(session_end, '%H:%M:%S') AS time_range,
    install_count::DOUBLE / greatest(click_count, 1) AS success_rate,
    CASE WHEN install_count > 0 THEN 0 WHEN click_count >= 2 THEN 1 ELSE 2 END AS label
  FROM base JOIN {mode_sql('app')} ma USING (session_id) JOIN {mode_sql('channel')} mc USING (session_id)
    JOIN {entropy_sql('device')} hd USING (session_id) JOIN {entropy_sql('channel')} hc USING (session_id)
    JOIN {entropy_sql('app')} ha USING (session_id) JOIN {hist_entropy_sql('interval_us', 10, 'ev')} hi USING (session_id))"""

PROXY = """p0 AS (
  SELECT *, greatest(click_interval_mean, 0.05) AS m,
    coalesce(click_interval_std, 0) / (greatest(click_interval_mean, 0.05) + 1.0) AS v,
    ln(1.0 + requests_per_minute) AS cad, click_interval_entropy AS e FROM s),
p1 AS (
  SELECT *, least(greatest(120.0 / (m + 0.5) + 18.0 * e, 15.0), 320.0) AS mouse_speed_mean,
    least(greatest(4.0 + 14.0 * v + 3.0 * e, 0.5), 120.0) AS mouse_speed_std,
    least(greatest(0.9 + 1.2 * e + 0.4 * v, 0.1), 8.0) AS coordinate_entropy,
    greatest(round_even((click_count - 1) * (0.65 + 0.35 * e), 0), 0)::BIGINT AS direction_change_count FROM p0),
p2 AS (
  SELECT *, greatest(20.0, mouse_speed_mean * sqrt(greatest(click_count, 1)) * (1.0 + 0.25 * cad)) AS mouse_path_length,
    greatest(0.2, 0.35 * mouse_speed_std + 0.2 * cad) AS movement_std,
    greatest(0.1, mouse_speed_std / (m + 1.0)) AS mouse_acceleration_std FROM p1),
px AS (SELECT *, least(direction_change_count / greatest(mouse_path_length, 1.0), 5.0) AS movement_curvature FROM p2)"""


def score_sql(proxy: str = "0") -> str:
    return f"""round_even(
    (CASE WHEN requests_per_minute > 120 THEN 2.0 WHEN requests_per_minute > 60 THEN 1.0 ELSE 0.0 END)::DOUBLE
    + (CASE WHEN clicks_per_minute > 120 THEN 0.8 ELSE 0.0 END)
    + (CASE WHEN request_interval_std < 0.35 THEN 1.4 WHEN request_interval_std < 1.0 THEN 0.6 ELSE 0.0 END)
    + (CASE WHEN coordinate_entropy < 1.6 THEN 1.6 WHEN coordinate_entropy < 2.6 THEN 0.8 ELSE 0.0 END)
    + (CASE WHEN device_entropy < 0.2 THEN 0.6 ELSE 0.0 END)
    + (CASE WHEN click_interval_entropy < 0.4 THEN 0.9 ELSE 0.0 END)
    + (CASE WHEN movement_curvature < 0.02 THEN 0.5 ELSE 0.0 END)
    + (CASE WHEN session_idle_ratio < 0.02 AND requests_per_minute > 80 THEN 0.7 ELSE 0.0 END)
    + (CASE WHEN {proxy} <> 0 THEN 1.0 ELSE 0.0 END), 4)"""


SCORE = f"sc AS (SELECT *, {score_sql()} AS bot_likelihood_score FROM px)"


def sess(select: str, *more: str, gap: int = GAP_MINUTES) -> str:
    """Query over the session table ``s``."""
    return "WITH " + ",\n".join([CLICKS, ev_sql(gap), TEMPORAL, *more]) + "\n" + select


def prof(select: str, *more: str) -> str:
    """Query over the profiled session table ``sc``."""
    return sess(select, PROXY, SCORE, *more)


MOVES = """mv0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_linenumber::BIGINT AS movement_index, l_quantity AS x,
    l_extendedprice / 1000.0 AS y,
    row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax)),
mv1 AS (
  SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, movement_index - lag(movement_index) OVER o AS di
  FROM mv0 WINDOW o AS (PARTITION BY session_id ORDER BY ordinal)),
mv2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, atan2(dy, dx) AS heading FROM mv1),
mv AS (SELECT *, abs(heading - lag(heading) OVER o) AS turn,
    CASE WHEN dist IS NOT NULL THEN coalesce(dist - lag(dist) OVER o, 0) END AS accel
  FROM mv2 WINDOW o AS (PARTITION BY session_id ORDER BY ordinal))"""

MOTION = f"""mo AS (
  SELECT mv.session_id, count(*) AS total_movements, coalesce(avg(dist), 0) AS mouse_speed_mean,
    coalesce(stddev_pop(dist), 0) AS mouse_speed_std, coalesce(sum(dist), 0) AS mouse_path_length,
    count(*) FILTER (WHERE turn > pi() / 4) AS direction_change_count,
    coalesce(any_value(pooled.s), 0) AS movement_std, coalesce(stddev_pop(accel), 0) AS mouse_acceleration_std,
    coalesce(avg(turn / greatest(dist, 1.0)), 0) AS movement_curvature,
    CASE WHEN count(*) > 1 THEN (any_value(hx.h) + any_value(hy.h)) / 2 ELSE 0 END AS coordinate_entropy
  FROM mv
  LEFT JOIN (SELECT session_id, stddev_pop(v) AS s FROM (
      SELECT session_id, dx AS v FROM mv UNION ALL SELECT session_id, dy FROM mv) GROUP BY 1) pooled ON pooled.session_id = mv.session_id
  JOIN {hist_entropy_sql('x', 16, 'mv')} hx ON hx.session_id = mv.session_id
  JOIN {hist_entropy_sql('y', 16, 'mv')} hy ON hy.session_id = mv.session_id
  GROUP BY mv.session_id)"""


def motion_sql(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([MOVES, MOTION, *more]) + "\n" + select
