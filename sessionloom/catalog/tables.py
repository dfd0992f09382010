"""Queries for sources, schema work, filters, joins, sets, ordering, scalars and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.catalog.base import (
    CLICKS, H, MOVES, R, Rs, S, U, choice_sql, clicks, enriched, ev_sql, events, motion_sql, N, prof, profiled, query,
    rounded, sess, stamp, temporal, traces,
)
from sessionloom.functions import columns as C
from sessionloom.operators import enrich, motion, profile, ranks, structure
from sessionloom.schema import (
    BOT_AGENTS, BROWSERS, DATACENTRE_PREFIXES, LABEL_NAMES, RESIDENTIAL_PREFIXES, SESSION_COLUMNS,
)
from sessionloom.sources import bindings, readers

# --- sources -----------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


@query("src01_read_typed", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, folder):
    df = readers.read_table(spark, f"{folder}/events.parquet", EVENT_SCHEMA, "parquet")
    return df.select("event_id", "user_id", "event_type", "value")


@query("src02_read_projected", f"WITH {CLICKS} SELECT ip, app, device, os, channel, {S('click_time')} AS click_time, is_attributed FROM clicks")
def _(spark, folder):
    return stamp(clicks(spark, folder).select(*readers.CLICK_COLUMNS), "click_time")


#: Small enough to cut at every scale of the given tables.
NEGATIVE_CAP, POSITIVE_MINIMUM, CHUNK_ROWS = 400, 150, 128


@query(
    "src03_capped_class_scan",
    f"""WITH {CLICKS}, o AS (SELECT event_id, is_attributed, event_id - (SELECT min(event_id) FROM clicks) AS place FROM clicks),
c AS (SELECT place // {CHUNK_ROWS} AS part, sum(is_attributed) AS p, sum(1 - is_attributed) AS n FROM o GROUP BY 1),
u AS (SELECT part, sum(p) OVER w AS p, sum(n) OVER w AS n FROM c WINDOW w AS (ORDER BY part)),
e AS (SELECT coalesce(min(part), (SELECT max(part) FROM c)) AS last FROM u WHERE p >= {POSITIVE_MINIMUM} AND n >= {NEGATIVE_CAP}),
k AS (SELECT *, sum(1 - is_attributed) OVER (ORDER BY place) AS nth FROM o WHERE place // {CHUNK_ROWS} <= (SELECT last FROM e))
SELECT event_id, is_attributed FROM k WHERE is_attributed = 1 OR nth <= {NEGATIVE_CAP}""",
)
def _(spark, folder):
    rows = readers.read_numbered(spark, f"{folder}/events.parquet").withColumn("is_attributed", (F.col("event_type") == "purchase").cast("int"))
    return readers.capped_class_scan(rows, NEGATIVE_CAP, POSITIVE_MINIMUM, CHUNK_ROWS).select("event_id", "is_attributed")


@query("src04_read_schema_on_read", "SELECT o_custkey AS session_id, count(*) AS total_requests, count(*) FILTER (WHERE o_orderstatus = 'F') AS successful_requests FROM orders GROUP BY 1")
def _(spark, folder):
    rows = bindings.requests(spark, folder)
    return rows.groupBy(F.col("session_id").cast("long").alias("session_id")).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("status_code") == 200).alias("successful_requests")
    )


@query("src05_read_head", f"WITH {CLICKS} SELECT event_id, ip, channel FROM clicks ORDER BY event_id LIMIT 5")
def _(spark, folder):
    return readers.read_head(clicks(spark, folder).select("event_id", "ip", "channel"), 5, ("event_id",))


@query("src07_empty_on_missing", "SELECT event_id, user_id FROM events")
def _(spark, folder):
    missing = readers.read_or_empty(spark, f"{folder}/no_such_table.parquet", EVENT_SCHEMA, "parquet")
    present = readers.read_or_empty(spark, f"{folder}/events.parquet", EVENT_SCHEMA, "parquet")
    return missing.unionByName(present).select("event_id", "user_id")


@query(
    "src09_normalise_clicks",
    f"""SELECT event_id, {S('ts')} AS click_time, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_attributed,
  year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second
FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, folder):
    raw = bindings.table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("string")).otherwise("not a time").alias("click_time"),
        F.when(F.col("event_type") == "purchase", 1).alias("is_attributed"),
    )
    return stamp(readers.normalise_clicks(raw), "click_time")


# --- schema ------------------------------------------------------------------------------


def _sparse(df):
    """A session table with holes, as legacy inputs have them."""
    return df.select(
        "session_id",
        F.when(F.col("label") < 2, F.col("label")).alias("label"),
        F.when(F.col("click_count") % 2 == 0, F.col("click_count")).alias("click_count"),
        (F.col("click_count") + 1).alias("total_requests"),
        F.when(F.col("install_count") > 0, F.col("install_count")).alias("install_count"),
        "requests_per_minute",
        "coordinate_entropy",
        F.col("app").alias("extra_app"),
    )


SPARSE = """sp AS (SELECT session_id, CASE WHEN label < 2 THEN label END AS label, CASE WHEN click_count % 2 = 0 THEN click_count END AS click_count,
  click_count + 1 AS total_requests, CASE WHEN install_count > 0 THEN install_count END AS install_count, requests_per_minute, coordinate_entropy, app AS extra_app FROM sc)"""


@query(
    "sch01_align_schema",
    prof(
        f"""SELECT '{','.join(SESSION_COLUMNS + ['extra_app'])}' AS columns, count(*) AS n, count(label) AS labels, 0 AS browsers,
  sum(extra_app)::BIGINT AS extra FROM sp""",
        SPARSE,
    ),
)
def _(spark, folder):
    out = structure.align_schema(_sparse(profiled(spark, folder)), defaults=False)
    return out.agg(
        F.lit(",".join(out.columns)).alias("columns"),
        F.count("*").alias("n"),
        F.count("label").alias("labels"),
        F.count("browser").alias("browsers"),
        F.sum("extra_app").alias("extra"),
    )


@query(
    "sch02_default_chain",
    prof(
        f"""SELECT session_id, coalesce(label, -1) AS label, CASE coalesce(label, -1) WHEN 0 THEN 'human' WHEN 1 THEN 'moderate_bot' WHEN 2 THEN 'advanced_bot' END AS bot_type,
  'unknown' AS data_source, false AS candidate_human, coalesce(click_count, total_requests) AS click_count, total_requests,
  coalesce(click_count, total_requests) AS total_movements, coalesce(install_count, 0) AS successful_requests,
  coalesce(click_count, total_requests) AS logs_count, coalesce(install_count, 0) AS install_count, 0 AS is_proxy,
  {R('coalesce(install_count, 0)::DOUBLE / greatest(total_requests, 1)')} AS success_rate,
  round_even((CASE WHEN requests_per_minute > 120 THEN 2.0 WHEN requests_per_minute > 60 THEN 1.0 ELSE 0.0 END)::DOUBLE
    + CASE WHEN coordinate_entropy < 1.6 THEN 1.6 WHEN coordinate_entropy < 2.6 THEN 0.8 ELSE 0.0 END, 4) AS bot_likelihood_score FROM sp""",
        SPARSE,
    ),
)
def _(spark, folder):
    out = structure.align_schema(_sparse(profiled(spark, folder)))
    names = (
        "session_id label bot_type data_source candidate_human click_count total_requests total_movements successful_requests "
        "logs_count install_count is_proxy success_rate bot_likelihood_score"
    ).split()
    return rounded(out.select(*names)).withColumn("bot_likelihood_score", F.bround(F.round("bot_likelihood_score", 4), 4))


@query(
    "sch03_default_from_absent",
    prof(f"""SELECT session_id, {R('device_entropy')} AS device_entropy, {R('coordinate_entropy / 3.0')} AS click_probe,
  {R('mouse_speed_std / 5.0')} AS accel_probe FROM sc"""),
)
def _(spark, folder):
    # device_entropy is present and stays; the probes are absent and get their rule
    out = structure.with_defaults(
        profiled(spark, folder),
        {
            "device_entropy": F.col("coordinate_entropy") / 4.0,
            "click_probe": F.col("coordinate_entropy") / 3.0,
            "accel_probe": F.col("mouse_speed_std") / 5.0,
        },
    )
    return rounded(out.select("session_id", "device_entropy", "click_probe", "accel_probe"))


@query(
    "sch04_align_and_union",
    prof(f"""SELECT session_id, label, click_count, NULL::BIGINT AS movement_total, NULL::DOUBLE AS absent FROM sc
UNION ALL SELECT session_id, NULL, NULL, count(*), NULL FROM mv0 GROUP BY 1, 2, 3, 5""", MOVES),
)
def _(spark, folder):
    a = profiled(spark, folder).select("session_id", "label", "click_count")
    b = bindings.moves(spark, folder).groupBy("session_id").agg(F.count("*").alias("movement_total"))
    return structure.align_and_union(a, b, ["session_id", "label", "click_count", "movement_total", "absent"])


@query("sch06_drop_columns", prof("SELECT session_id, label, click_count FROM sc"))
def _(spark, folder):
    df = profiled(spark, folder)
    keep = {"session_id", "label", "click_count"}
    return df.drop(*[c for c in df.columns if c not in keep], "not_there")


@query(
    "sch08_cast_or_median",
    f"""WITH {CLICKS}, t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE app::VARCHAR END AS app_text, app FROM clicks)
SELECT event_id, {R('coalesce(try_cast(app_text AS DOUBLE), (SELECT quantile_cont(app, 0.5) FROM t))')} AS app_text FROM t""",
)
def _(spark, folder):
    from sessionloom.plans.cuts import quantiles

    rows = clicks(spark, folder)
    medians = {"app_text": quantiles(rows, ["app"], [0.5])["app"][0]}
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("app").cast("string"))
    out = structure.numeric_or_original_median(rows.select("event_id", text.alias("app_text")), ["app_text"], medians)
    return rounded(out)


# --- filters and projections -------------------------------------------------------------


@query("fil01_drop_null_keys", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark, folder):
    key = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return clicks(spark, folder).withColumnRenamed("ip", "user_id").withColumn("k", key).dropna(subset=["k"]).select("event_id")


@query("fil02_label_predicate", prof("SELECT session_id FROM sc WHERE label = 1 AND channel = 'click'"))
def _(spark, folder):
    return profiled(spark, folder).filter((F.col("label") == 1) & (F.col("channel") == "click")).select("session_id")


@query("fil04_joi06_semi_join", sess("SELECT event_id FROM ev WHERE session_id IN (SELECT session_id FROM s WHERE install_count > 0)"))
def _(spark, folder):
    ev = events(spark, folder)
    humans = ev.groupBy("session_id").agg(F.sum("is_attributed").alias("n")).filter("n > 0")
    return structure.keep_listed(ev, humans).select("event_id")


@query("fil05_zero_subset_count", prof("SELECT label, count(*) AS n FROM sc WHERE device_entropy < 0.000001 AND direction_change_count = 0 GROUP BY label"))
def _(spark, folder):
    hit = (F.col("device_entropy") < 1e-6) & (F.col("direction_change_count") == 0)
    return profiled(spark, folder).filter(hit).groupBy("label").agg(F.count("*").alias("n"))


@query("fil06_min_group_size", sess("SELECT event_id FROM ev WHERE session_id IN (SELECT session_id FROM s WHERE click_count >= 2)"))
def _(spark, folder):
    return structure.min_group_size(events(spark, folder), "session_id", 2).select("event_id")


@query("prj01_recode", prof("SELECT session_id, CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'moderate_bot' ELSE 'unknown' END AS bot_type FROM sc"))
def _(spark, folder):
    names = {k: v for k, v in LABEL_NAMES.items() if k < 2}
    return profiled(spark, folder).select("session_id", C.recode(F.col("label"), names, "unknown").alias("bot_type"))


@query("prj02_conditional_column", prof("SELECT session_id, CASE WHEN click_count > 3 OR install_count = 0 THEN 1 ELSE 0 END AS flag FROM sc"))
def _(spark, folder):
    flag = F.when((F.col("click_count") > 3) | (F.col("install_count") == 0), 1).otherwise(0)
    return profiled(spark, folder).select("session_id", flag.alias("flag"))


@query("prj03_infinite_to_null", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events")
def _(spark, folder):
    wild = F.when(F.col("event_id") % 8 == 0, float("inf")).when(F.col("event_id") % 8 == 4, float("-inf")).otherwise(F.col("value"))
    rows = bindings.table(spark, folder, "events").withColumn("value", wild)
    return rows.select("event_id", C.null_if_infinite(F.col("value")).alias("value"))


# --- joins -------------------------------------------------------------------------------


@query(
    "joi02_join_replacing",
    prof("SELECT session_id, click_count, CASE WHEN label = 0 THEN 'known' END AS channel FROM sc"),
)
def _(spark, folder):
    df = profiled(spark, folder)
    right = df.filter("label = 0").select("session_id", F.lit("known").alias("channel"))
    return structure.join_replacing(df.select("session_id", "click_count", "channel"), right, "session_id")


@query("joi03_lookup_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, folder):
    orders = bindings.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(bindings.table(spark, folder, "customer"), "c_custkey").select("o_orderkey", "c_mktsegment")


@query(
    "joi04_rank_matched_join",
    prof(
        f"""SELECT a.session_id AS segment_id, b.session_id FROM (
  SELECT session_id, row_number() OVER (ORDER BY n DESC, {H('session_id')}, session_id) AS r FROM (SELECT session_id, count(*) AS n FROM mv0 GROUP BY 1)) a
LEFT JOIN (SELECT session_id, row_number() OVER (ORDER BY click_count DESC, direction_change_count DESC, {H('session_id')}, session_id) AS r FROM sc) b USING (r)""",
        MOVES,
    ),
)
def _(spark, folder):
    sessions = profiled(spark, folder).select(
        "session_id", F.col("click_count").alias("total_movements"), F.col("direction_change_count").alias("total_requests")
    )
    return motion.rank_matched_ids(bindings.moves(spark, folder), sessions)


@query(
    "joi07_fitted_scalars",
    f"""WITH {CLICKS}, t AS (SELECT ip, count(*) AS n FROM clicks GROUP BY ip)
SELECT ip, n, n >= (SELECT quantile_cont(n, 0.75) FROM t) AS busy, {R('(n - (SELECT avg(n) FROM t)) / (SELECT stddev_pop(n) FROM t)')} AS z FROM t""",
)
def _(spark, folder):
    from sessionloom.plans.cuts import quantiles

    t = clicks(spark, folder).groupBy("ip").agg(F.count("*").alias("n"))
    cut = quantiles(t, ["n"], [0.75])["n"][0]
    return rounded(t.select("ip", "n", (F.col("n") >= cut).alias("busy"), enrich.fitted_z(t, ["n"])["n"].alias("z")))


@query(
    "joi08_row_cycle_join",
    """WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT clone::BIGINT AS clone, s_suppkey FROM range(250) r(clone) JOIN b ON clone % n = i""",
)
def _(spark, folder):
    key = F.format_string("%012d", "s_suppkey")
    base = motion.id_ordinals(bindings.table(spark, folder, "supplier").withColumn("k", key), "k", "i")
    return structure.cycle_rows(base, 250, "i").select("clone", "s_suppkey")


# --- sorts and sets ----------------------------------------------------------------------


@query("srt01_multi_key_sort", "SELECT event_id, user_id FROM events ORDER BY user_id, ts, event_id")
def _(spark, folder):
    return bindings.table(spark, folder, "events").orderBy("user_id", "ts", "event_id").select("event_id", "user_id")


@query("srt02_sort_nulls_last", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events ORDER BY v NULLS LAST, event_id")
def _(spark, folder):
    v = F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v")
    return bindings.table(spark, folder, "events").select("event_id", v).orderBy(F.asc_nulls_last("v"), "event_id")


@query("srt03_top_counts", f"WITH {CLICKS} SELECT ip, count(*) AS n FROM clicks GROUP BY ip ORDER BY n DESC, ip LIMIT 10")
def _(spark, folder):
    return structure.top_counts(clicks(spark, folder), "ip", 10)


@query("srt04_head_per_class", prof("SELECT label, session_id FROM (SELECT label, session_id, row_number() OVER (PARTITION BY label ORDER BY session_id) AS r FROM sc) WHERE r <= 3"))
def _(spark, folder):
    return structure.head_per_class(profiled(spark, folder)).select("label", "session_id")


@query("set01_union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def _(spark, folder):
    a = bindings.table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = bindings.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set02_distinct_rows", f"WITH {CLICKS} SELECT DISTINCT ip, device, channel FROM clicks")
def _(spark, folder):
    return clicks(spark, folder).select("ip", "device", "channel").dropDuplicates()


@query("set03_leftover_rows", prof("SELECT session_id FROM sc WHERE session_id NOT IN (SELECT session_id FROM sc WHERE label = 2)"))
def _(spark, folder):
    df = profiled(spark, folder)
    return structure.keep_unlisted(df, df.filter("label = 2")).select("session_id")


@query(
    "set04_replace_class",
    prof("SELECT session_id, label, click_count FROM sc WHERE label <> 0 UNION ALL SELECT session_id, 0, click_count + 100 FROM sc WHERE label = 0"),
)
def _(spark, folder):
    df = profiled(spark, folder).select("session_id", "label", "click_count")
    grown = df.filter("label = 0").withColumn("click_count", F.col("click_count") + 100)
    return structure.replace_class(df, grown, 0)


@query(
    "win14_first_per_key",
    f"""WITH {CLICKS} SELECT ip, channel, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ip, channel ORDER BY click_time, event_id) AS r FROM clicks) WHERE r = 1""",
)
def _(spark, folder):
    rows = clicks(spark, folder).withColumn("k", F.concat_ws("|", "ip", "channel")).select("k", "ip", "channel", "event_id", "click_time")
    return structure.first_per_key(rows, "k", ["click_time", "event_id"]).select("ip", "channel", "event_id")


@query(
    "dom18_merge_sources",
    prof("SELECT session_id, label, click_count FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY src) AS r FROM "
         "(SELECT session_id, label, click_count, 0 AS src FROM sc WHERE label < 2 UNION ALL SELECT session_id, 2, click_count + 7, 1 FROM sc WHERE click_count > 2)) WHERE r = 1"),
)
def _(spark, folder):
    df = profiled(spark, folder)
    b = df.filter("click_count > 2").withColumns({"label": F.lit(2), "click_count": F.col("click_count") + 7})
    return structure.merge_sources(df.filter("label < 2"), b).select("session_id", "label", "click_count")


# --- window ranks ------------------------------------------------------------------------


@query("win08_step_deltas", f"WITH {MOVES} SELECT session_id, ordinal, coalesce(di, 0)::BIGINT AS d_index, {R('coalesce(dx, 0)')} AS dx, {R('coalesce(dy, 0)')} AS dy FROM mv")
def _(spark, folder):
    from sessionloom.plans.chunks import ordered_points

    p = ordered_points(bindings.moves(spark, folder), "session_id", "movement_index", "tie", "x_coordinate", "y_coordinate")
    out = p.select(
        "session_id",
        "ordinal",
        F.coalesce(F.col("movement_index") - F.col("i1"), F.lit(0)).alias("d_index"),
        F.coalesce(F.col("x_coordinate") - F.col("x1"), F.lit(0.0)).alias("dx"),
        F.coalesce(F.col("y_coordinate") - F.col("y1"), F.lit(0.0)).alias("dy"),
    )
    return rounded(out)


def rank_sql(value: str) -> str:
    return f"row_number() OVER (ORDER BY {value}, {H('session_id')}, session_id)"


@query(
    "win09_decile_strata",
    prof(f"SELECT session_id, round_even(10.0 * {rank_sql('requests_per_minute')} / count(*) OVER (), 0)::INT AS decile FROM sc"),
)
def _(spark, folder):
    return ranks.decile_strata(profiled(spark, folder), {"requests_per_minute": "decile"}, "session_id").select("session_id", "decile")


@query(
    "win10_average_rank_pct",
    prof(f"SELECT session_id, {R('(rank() OVER (ORDER BY click_count) + (count(*) OVER (PARTITION BY click_count) - 1) / 2.0) / count(*) OVER ()')} AS pct FROM sc"),
)
def _(spark, folder):
    return rounded(ranks.average_rank(profiled(spark, folder), "click_count", "pct", pct=True).select("session_id", "pct"))


@query(
    "win11_frequency_strata",
    prof(f"SELECT session_id, greatest(1, ceil(({rank_sql('click_count')} - 1) * 5.0 / (count(*) OVER () - 1)))::INT AS bin FROM sc"),
)
def _(spark, folder):
    return ranks.frequency_strata(profiled(spark, folder), {"click_count": "bin"}, "session_id").select("session_id", "bin")


@query("win12_ordinal_reindex", f"WITH {MOVES} SELECT session_id, ordinal - 1 AS movement_index, {R('x')} AS x FROM mv0")
def _(spark, folder):
    from sessionloom.plans.chunks import ordered_points

    p = ordered_points(bindings.moves(spark, folder), "session_id", "movement_index", "tie", "x_coordinate", "y_coordinate")
    return rounded(p.select("session_id", (F.col("ordinal") - 1).alias("movement_index"), F.col("x_coordinate").alias("x")))


@query("global_rank", prof(f"SELECT session_id, row_number() OVER (ORDER BY click_count DESC, {H('session_id')}, session_id) AS rank FROM sc"))
def _(spark, folder):
    return ranks.ranked(profiled(spark, folder), "click_count", "session_id", descending=True).select("session_id", F.col("rank").cast("long").alias("rank"))


# --- scalars -----------------------------------------------------------------------------


@query("sca01_calendar_parts", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events")
def _(spark, folder):
    return bindings.table(spark, folder, "events").select("event_id", *[x.alias(n) for n, x in C.calendar_parts(F.col("ts")).items()])


@query("sca02_date_and_range", sess("SELECT session_id, activity_date, time_range FROM s"))
def _(spark, folder):
    from sessionloom.operators.sessions import session_aggregate

    s = session_aggregate(events(spark, folder))
    start, end = F.col("session_start"), F.col("session_end")
    return s.select("session_id", C.activity_date(start).alias("activity_date"), C.time_range(start, end).alias("time_range"))


@query("sca03_parse_access_log_time", f"SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events")
def _(spark, folder):
    text = F.concat(F.lit("["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]"))
    rows = bindings.table(spark, folder, "events").withColumn("raw", F.when(F.col("event_id") % 9 != 0, text).otherwise("[broken"))
    return rows.select("event_id", F.date_format(C.parse_access_log_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query(
    "sca04_parse_session_span",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS session_start, "
    "strftime(date_trunc('second', ts) + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS session_end FROM events",
)
def _(spark, folder):
    rows = bindings.table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "dd/MMM/yyyy").alias("activity_date"),
        F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("-23:59:59")).alias("time_range"),
        F.lit(90.0).alias("session_duration_sec"),
    )
    out = enrich.legacy_span(rows)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("event_id", fmt("session_start"), fmt("session_end"))


@query("sca05_stable_fraction", f"SELECT event_id, {H('event_id::VARCHAR')} AS u FROM events")
def _(spark, folder):
    return bindings.table(spark, folder, "events").select("event_id", C.stable_fraction(F.col("event_id").cast("string")).alias("u"))


@query(
    "sca06_category_label",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 WHEN '5-LOW' THEN 7 END AS label FROM orders""",
)
def _(spark, folder):
    # priorities play the category texts: mixed case, several words, a number, and no match
    texts = {"1-URGENT": " Humans_and_ADVANCED_bots ", "2-HIGH": "moderate bot", "3-MEDIUM": "Human", "5-LOW": "7"}
    rows = bindings.table(spark, folder, "orders")
    text = C.recode(F.col("o_orderpriority"), texts, "other")
    return rows.select("o_orderkey", C.category_label(text).alias("label"))


@query("sca07_session_key", "SELECT event_id, 'td_' || user_id || '_' || (user_id % 3) || '_' || (event_id % 11) AS session_id FROM events")
def _(spark, folder):
    key = C.session_key("td", F.col("user_id"), F.col("user_id") % 3, F.col("event_id") % 11)
    return bindings.table(spark, folder, "events").select("event_id", key.alias("session_id"))


def agent_sql(headless: str, major: str, build: str, browser: str = "browser", system: str = "operating_system") -> str:
    webkit = "AppleWebKit/537.36 (KHTML, like Gecko)"
    win = "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"
    num = f"{major} || '.0.' || {build} || '.0'"
    return f"""CASE WHEN {headless} AND {browser} = 'Chrome' THEN 'Mozilla/5.0 (X11; Linux x86_64) {webkit} HeadlessChrome/' || {num} || ' Safari/537.36'
  WHEN {browser} = 'Safari' THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/' || greatest(15, {major} // 8) || '.0 Safari/605.1.15'
  WHEN {browser} = 'Firefox' THEN 'Mozilla/5.0 (' || CASE WHEN {system} = 'Linux' THEN 'X11; Linux x86_64' ELSE 'Windows NT 10.0; Win64; x64' END || '; rv:' || {major} || '.0) Gecko/20100101 Firefox/' || {major} || '.0'
  WHEN {browser} = 'Edge' THEN '{win} {webkit} Chrome/' || {num} || ' Safari/537.36 Edg/' || {num}
  ELSE '{win} {webkit} Chrome/' || {num} || ' Safari/537.36' END"""


@query(
    "sca08_user_agent",
    f"""WITH t AS (SELECT o_orderkey, ['Chrome', 'Safari', 'Firefox', 'Edge'][(o_orderkey % 4)::INT + 1] AS browser,
  ['Windows', 'Linux', 'MacOS'][(o_orderkey % 3)::INT + 1] AS operating_system, {H('o_orderkey::VARCHAR')} AS fr FROM orders),
v AS (SELECT *, floor(118 + fr * 8)::BIGINT AS major, floor(4200 + fr * 900)::BIGINT AS build FROM t)
SELECT o_orderkey, {agent_sql('o_orderkey % 2 = 0', 'major', 'build')} AS user_agent FROM v""",
)
def _(spark, folder):
    rows = bindings.table(spark, folder, "orders")
    k = F.col("o_orderkey")
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v) for v in values]), (k % m + 1).cast("int"))
    fr = C.stable_fraction(k.cast("string"))
    agent = enrich.user_agent(
        pick(["Chrome", "Safari", "Firefox", "Edge"], 4), pick(["Windows", "Linux", "MacOS"], 3), k % 2 == 0,
        F.floor(118 + fr * 8), F.floor(4200 + fr * 900),
    )
    return rows.select("o_orderkey", agent.alias("user_agent"))


def pool_sql(pool: list[int], draw: str) -> str:
    return f"{pool}[floor({draw} * {len(pool)})::INT + 1]"


def ip_sql(key: str, datacentre: str) -> str:
    u0 = U(key, "ip0")
    return f"""(CASE WHEN {datacentre} THEN {pool_sql(DATACENTRE_PREFIXES, u0)} ELSE {pool_sql(RESIDENTIAL_PREFIXES, u0)} END || '.' ||
  floor({U(key, 'ip1')} * 256)::INT || '.' || floor({U(key, 'ip2')} * 256)::INT || '.' || (floor({U(key, 'ip3')} * 254)::INT + 1))"""


@query("sca09_ipv4", f"SELECT o_orderkey, {ip_sql('o_orderkey::VARCHAR', 'o_orderkey % 2 = 0')} AS ip_address FROM orders")
def _(spark, folder):
    k = F.col("o_orderkey")
    return bindings.table(spark, folder, "orders").select("o_orderkey", enrich.ipv4(k.cast("string"), k % 2 == 0).alias("ip_address"))


@query("sca10_rnd01_weighted_choice", f"SELECT o_orderkey, {choice_sql(U('o_orderkey::VARCHAR', 'browser'), BROWSERS)} AS browser FROM orders")
def _(spark, folder):
    draw = C.uniform(F.col("o_orderkey"), "browser")
    return bindings.table(spark, folder, "orders").select("o_orderkey", C.weighted_choice(draw, BROWSERS).alias("browser"))


@query("sca11_rates_per_minute", sess(f"SELECT session_id, {Rs('clicks_per_minute requests_per_minute')} FROM s"))
def _(spark, folder):
    from sessionloom.operators.sessions import session_aggregate

    s = session_aggregate(events(spark, folder))
    rate = C.per_minute(F.col("event_count"), F.col("session_duration_sec"))
    return rounded(s.select("session_id", rate.alias("clicks_per_minute"), rate.alias("requests_per_minute")))


@query("sca12_clip", "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN least(greatest(value, 10.0), 60.0) END AS v FROM events")
def _(spark, folder):
    x = F.when(F.col("event_id") % 6 != 0, F.col("value"))
    return bindings.table(spark, folder, "events").select("event_id", C.clip(x, 10.0, 60.0).alias("v"))


@query(
    "sca13_math",
    f"""SELECT event_id, {R('ln(1 + value)')} AS log1p, {R('sqrt(value)')} AS root, round_even(value / 10, 0) AS rint,
  {R('atan2(value - 20, value - 30)')} AS heading, floor(value)::BIGINT AS whole, abs(value - 25) AS size FROM events""",
)
def _(spark, folder):
    v = F.col("value")
    out = bindings.table(spark, folder, "events").select(
        "event_id",
        (F.log1p(v)).alias("log1p"),
        F.sqrt(v).alias("root"),
        F.atan2(v - 20, v - 30).alias("heading"),
        F.rint(v / 10).alias("rint"),
        F.floor(v).alias("whole"),
        F.abs(v - 25).alias("size"),
    )
    exact = out.select("event_id", "rint", "whole", "size")
    return rounded(out.select("event_id", "log1p", "root", "heading")).join(exact, "event_id")


@query("sca14_burstiness", sess(f"SELECT session_id, {R('(request_interval_std - click_interval_mean) / (request_interval_std + click_interval_mean + 1e-9)')} AS burstiness FROM s"))
def _(spark, folder):
    s = temporal(spark, folder)
    return rounded(s.select("session_id", C.burstiness(F.col("request_interval_std"), F.col("click_interval_mean")).alias("burstiness")))


@query("sca15_success_rate", "SELECT o_custkey, round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) + 3e-8, 6) AS success_rate FROM orders GROUP BY 1")
def _(spark, folder):
    g = bindings.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n")
    )
    return rounded(g.select("o_custkey", C.success_rate(F.col("s"), F.col("n")).alias("success_rate")))


@query("sca16_half_even_round", "SELECT event_id, round_even((event_id % 40) / 8.0, 2) AS v FROM events")
def _(spark, folder):
    return bindings.table(spark, folder, "events").select("event_id", F.bround((F.col("event_id") % 40) / 8.0, 2).alias("v"))


@query("sca17_fill_unknown", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS channel FROM events")
def _(spark, folder):
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("channel")
    return bindings.table(spark, folder, "events").select("event_id", text).fillna("unknown", subset=["channel"])


@query("sca19_bot_flag", prof("SELECT session_id, (label <> 0)::INT AS bot FROM sc"))
def _(spark, folder):
    return profiled(spark, folder).select("session_id", (F.col("label") != 0).cast("int").alias("bot"))


@query("rnd02_standard_normal", f"SELECT event_id, {R(N('event_id::VARCHAR', 'z'))} AS z FROM events")
def _(spark, folder):
    return rounded(bindings.table(spark, folder, "events").select("event_id", C.standard_normal(F.col("event_id"), "z").alias("z")))
