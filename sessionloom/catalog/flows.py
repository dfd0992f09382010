"""Queries that go through files and through whole flows: read, sessions, labels, score, balance, report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.catalog.base import (
    CLICKS, GAP_MINUTES, R, S, clicks, prof, profiled, query, rounded, stamp, with_label,
)
from sessionloom.catalog.prepare import BALANCE, CORR, corr_sql
from sessionloom.operators import clean, enrich, sampling, sessions
from sessionloom.operators.profile import union_all
from sessionloom.schema import LEAKAGE_COLUMNS, NON_MODEL_COLUMNS, REDUNDANT_COLUMNS
from sessionloom.session import work_folder
from sessionloom.sources import readers, writers

#: Click files of this library carry the channel as a number; the driver's events name it, so the flow reads it as text.
FILE_SCHEMA = "event_id long, ip long, app long, device long, os long, channel string, click_time string, is_attributed int"


def click_file(spark, folder):
    """The click log written as CSV with a heading: the path of its folder."""
    path = work_folder(spark, "clicks")
    rows = stamp(clicks(spark, folder), "click_time")
    writers.write_table(rows, f"{path}/train.csv", "csv")
    return path


def clicks_from_file(spark, folder):
    path = click_file(spark, folder)
    return readers.normalise_clicks(readers.read_table(spark, f"{path}/train.csv", T.StructType.fromDDL(FILE_SCHEMA)), calendar=False)


@query("src01_csv_round_trip", f"WITH {CLICKS} SELECT event_id, ip, app, device, os, channel, {S('click_time')} AS click_time, is_attributed FROM clicks")
def _(spark, folder):
    return stamp(clicks_from_file(spark, folder), "click_time").select("event_id", "ip", "app", "device", "os", "channel", "click_time", "is_attributed")


@query("src02_projected_click_file", f"WITH {CLICKS} SELECT ip, app, device, os, length(channel) AS channel, {S('click_time')} AS click_time, is_attributed FROM clicks")
def _(spark, folder):
    path = work_folder(spark, "projected")
    rows = clicks(spark, folder).select("ip", "app", "device", "os", F.length("channel").alias("channel"), "click_time", F.lit(None).cast("timestamp").alias("attributed_time"), "is_attributed")
    writers.write_table(rows, f"{path}/train_sample.parquet")
    return stamp(readers.read_clicks_projected(spark, path, "parquet"), "click_time")


@query("src04_inferred_csv", f"WITH {CLICKS} SELECT channel, sum(app)::BIGINT AS app_sum, max(ip) AS ip_max, sum(is_attributed)::BIGINT AS installs, {S('max(click_time)')} AS last FROM clicks GROUP BY channel")
def _(spark, folder):
    rows = readers.read_csv_inferred(spark, f"{click_file(spark, folder)}/train.csv")
    out = rows.groupBy("channel").agg(
        F.sum("app").cast("long").alias("app_sum"), F.max("ip").cast("long").alias("ip_max"),
        F.sum("is_attributed").cast("long").alias("installs"), F.max("click_time").cast("timestamp").alias("last"),
    )
    return stamp(out, "last")


@query("sch06_modelling_columns", prof("SELECT session_id, label, click_count, install_count, " + ", ".join(
    f"{R(c)} AS {c}" for c in ("requests_per_minute", "session_duration_sec", "mouse_speed_mean", "click_interval_mean")) + " FROM sc"))
def _(spark, folder):
    left = profiled(spark, folder).drop(*REDUNDANT_COLUMNS, *LEAKAGE_COLUMNS, *NON_MODEL_COLUMNS)
    assert not set(left.columns) & {*REDUNDANT_COLUMNS, *LEAKAGE_COLUMNS, *NON_MODEL_COLUMNS}
    return rounded(left.select("session_id", "label", "click_count", "install_count", "requests_per_minute", "session_duration_sec", "mouse_speed_mean", "click_interval_mean"))


DROPPED = f"""SELECT DISTINCT CASE WHEN feature_a = 'click_count' AND feature_b = 'total_requests' THEN 'total_requests'
  WHEN feature_a IN ('total_requests', 'request_interval_mean') AND feature_b NOT IN ('total_requests', 'request_interval_mean') THEN feature_a
  WHEN feature_b IN ('total_requests', 'request_interval_mean') AND feature_a NOT IN ('total_requests', 'request_interval_mean') THEN feature_b
  ELSE greatest(feature_a, feature_b) END AS dropped FROM {corr_sql(CORR)} WHERE abs(r) > 0.98
AND (feature_a IN ('total_requests', 'request_interval_mean') OR feature_b IN ('total_requests', 'request_interval_mean'))"""


@query(
    "cln02_table_without_correlated",
    prof("SELECT session_id, name, " + R("value") + " AS value FROM (" + " UNION ALL ".join(
        f"SELECT session_id, '{c}' AS name, {c}::DOUBLE AS value FROM sc" for c in CORR) + f") WHERE name NOT IN ({DROPPED})"),
)
def _(spark, folder):
    left, _ = clean.drop_correlated(profiled(spark, folder).select("session_id", *CORR))
    names = [c for c in left.columns if c != "session_id"]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return rounded(left.select("session_id", F.inline(cells)))


@query(
    "flow01_clicks_to_balanced_sessions",
    prof(f"""SELECT 'before' AS stage, label, count(*) AS n, {R('avg(bot_likelihood_score)', 4)} AS score FROM (SELECT (label <> 0)::INT AS label, bot_likelihood_score FROM sc) GROUP BY label
UNION ALL SELECT 'after', k.label, count(*), {R('avg(sc.bot_likelihood_score)', 4)} FROM (
  SELECT session_id, label FROM br WHERE r <= share UNION ALL SELECT session_id, label FROM bn WHERE label = (SELECT label FROM cl ORDER BY c, label LIMIT 1)) k
  JOIN sc USING (session_id) GROUP BY k.label""", BALANCE),
)
def _(spark, folder):
    """File -> typed clicks -> sessions -> features -> labels -> proxies -> score -> balance -> report."""
    ev = sessions.sessionize(clicks_from_file(spark, folder), gap_minutes=GAP_MINUTES)
    table = enrich.with_score(enrich.behavioural_proxies(with_label(sessions.session_temporal_features(ev, keys=sessions.CLICK_KEYS))))
    flags = {"label": (F.col("label") != 0).cast("int"), "data_source": F.lit("talkingdata"), "is_proxy": (F.col("original_device") == 0).cast("int")}
    before = table.withColumns(flags)
    path = work_folder(spark, "flow-sessions")
    writers.write_table(before, path)
    before = spark.read.parquet(path)
    report = [
        df.groupBy("label").agg(F.count("*").alias("n"), F.avg("bot_likelihood_score").alias("score")).select(F.lit(stage).alias("stage"), "*")
        for stage, df in (("before", before), ("after", sampling.downsample_majority(before)))
    ]
    return rounded(union_all(report), 4)
