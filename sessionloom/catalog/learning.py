"""Queries for models, evaluation, sinks and streams."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.catalog.base import (
    CLICKS, GAP_MINUTES, H, ORACLES, PROXY, R, Rs, S, SCORE, U, clicks, ev_sql, events, hist_entropy_sql, prof, profiled, query, rounded,
    sess, staged, stamp, temporal,
)
from sessionloom.catalog.domain import click_seq
from sessionloom.catalog.prepare import FEATURES
from sessionloom.catalog.tables import EVENT_SCHEMA
from sessionloom.operators import boosting, evaluation, models, sampling
from sessionloom.operators.sequences import standardise_steps
from sessionloom.functions.columns import uniform
from sessionloom.session import work_folder
from sessionloom.sources import bindings, writers
from sessionloom.streaming import labels, late, scored
from sessionloom.streaming import sessions as streams

# --- evaluation on given predictions -----------------------------------------------------


def probability_sql(i: int) -> str:
    return f"(({U('o_orderkey::VARCHAR', f'p{i}')} + CASE WHEN label = {i} THEN 0.4 ELSE 0 END))"


PRED = f"""pr0 AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, * FROM orders),
pr1 AS (SELECT k, label, round({probability_sql(0)}, 3) AS a, round({probability_sql(1)}, 3) AS b, round({probability_sql(2)}, 3) AS c FROM pr0),
pr AS (SELECT k, label, a AS p0, b AS p1, c AS p2, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS prediction FROM pr1)"""


def predictions(spark, folder):
    """Orders with a class from their status and hash scores leaning to it."""
    rows = bindings.table(spark, folder, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    scores = [F.round(uniform(F.col("o_orderkey"), f"p{i}") + F.when(F.col("label") == i, 0.4).otherwise(0.0), 3) for i in range(3)]
    out = rows.withColumn("label", label).select(F.col("o_orderkey").alias("k"), "label", F.array(*scores).alias("probability_array"))
    return out.withColumn("prediction", models.predicted_class(F.col("probability_array")))


CM = "cm AS (SELECT a.label, b.prediction, count(pr.k) AS n FROM (VALUES (0), (1), (2)) a(label) CROSS JOIN (VALUES (0), (1), (2)) b(prediction) LEFT JOIN pr ON pr.label = a.label AND pr.prediction = b.prediction GROUP BY 1, 2)"
REPORT = """pc AS (SELECT label, support, coalesce(tp / nullif(guessed, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM (
  SELECT label, sum(n)::DOUBLE AS support, sum(n) FILTER (WHERE label = prediction)::DOUBLE AS tp FROM cm GROUP BY label) JOIN (
  SELECT prediction AS label, sum(n)::DOUBLE AS guessed FROM cm GROUP BY prediction) USING (label)),
pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc)"""


@query("evl02_confusion_matrix", f"WITH {PRED}, {CM} SELECT * FROM cm")
def _(spark, folder):
    return evaluation.confusion_matrix(predictions(spark, folder))


@query(
    "evl01_metrics",
    f"""WITH {PRED}, {CM}, {REPORT} SELECT {R("(SELECT avg((label = prediction)::INT) FROM pr)")} AS accuracy, {R('sum(precision * support) / sum(support)')} AS precision,
  {R('sum(recall * support) / sum(support)')} AS recall, {R('sum(f1 * support) / sum(support)')} AS f1 FROM pf""",
)
def _(spark, folder):
    return rounded(evaluation.classification_metrics(predictions(spark, folder)))


@query(
    "evl03_class_report",
    f"""WITH {PRED}, {CM}, {REPORT} SELECT label::VARCHAR AS class, {Rs('precision recall f1')}, support::BIGINT AS support FROM pf
UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, sum(support)::BIGINT FROM pf
UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')}, {R('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM pf""",
)
def _(spark, folder):
    return rounded(evaluation.class_report(predictions(spark, folder)))


STACK = "sk AS (SELECT 0 AS class, p0 AS score, (label = 0)::INT AS hit FROM pr UNION ALL SELECT 1, p1, (label = 1)::INT FROM pr UNION ALL SELECT 2, p2, (label = 2)::INT FROM pr)"


@query(
    "evl04_roc_auc",
    f"""WITH {PRED}, {STACK}, rk AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM sk),
au AS (SELECT class, (sum(r) FILTER (WHERE hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)))::DOUBLE AS auc, sum(hit)::BIGINT AS support FROM rk GROUP BY class)
SELECT class::VARCHAR AS class, {R('auc')} AS auc, support FROM au UNION ALL SELECT 'weighted', {R('sum(auc * support) / sum(support)')}, sum(support)::BIGINT FROM au""",
)
def _(spark, folder):
    return rounded(evaluation.roc_auc(predictions(spark, folder)))


@query(
    "evl05_micro_roc_curve",
    f"""WITH {PRED}, {STACK}, d AS (SELECT score, count(*) AS n, sum(hit) AS pos FROM sk GROUP BY score)
SELECT score AS threshold, {R('sum(n - pos) OVER w / (SELECT sum(n - pos) FROM d)::DOUBLE')} AS fpr, {R('sum(pos) OVER w / (SELECT sum(pos) FROM d)::DOUBLE')} AS tpr FROM d WINDOW w AS (ORDER BY score DESC)""",
)
def _(spark, folder):
    out = evaluation.micro_roc_curve(predictions(spark, folder))
    return rounded(out.select("fpr", "tpr", F.col("threshold").cast("decimal(6,3)").alias("t"))).select("fpr", "tpr", F.col("t").cast("double").alias("threshold"))


@query(
    "mdl05_soft_vote",
    f"""WITH {PRED}, m AS (SELECT k, 0.7 * p0 + 0.3 * p1 AS a, 0.7 * p1 + 0.3 * p2 AS b, 0.7 * p2 + 0.3 * p0 AS c FROM pr)
SELECT k, {R('a', 4)} AS p0, {R('b', 4)} AS p1, {R('c', 4)} AS p2 FROM m""",
)
def _(spark, folder):
    one = predictions(spark, folder)
    p = F.col("probability_array")
    two = one.withColumn("probability_array", F.array(p[1], p[2], p[0]))
    out = models.soft_vote(one, two, "k")
    return rounded(out.select("k", *[F.col("probability_array")[i].alias(f"p{i}") for i in range(3)]), 4)


@query(
    "mdl07_best_model",
    f"""WITH {PRED}, m AS (SELECT o_orderpriority AS model, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS position, avg((label = prediction)::INT) AS f1 FROM pr JOIN orders ON o_orderkey = k GROUP BY 1)
SELECT model, {R('f1')} AS f1 FROM m ORDER BY f1 DESC, position LIMIT 1""",
)
def _(spark, folder):
    pr = predictions(spark, folder)
    orders = bindings.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    hit = (F.col("label") == F.col("prediction")).cast("int")
    m = pr.join(orders, "k").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(hit).alias("f1"))
    return rounded(models.best_model(m.withColumn("position", F.col("model"))).select("model", "f1"))


# --- training ----------------------------------------------------------------------------

TRAIN_FEATURES = [
    "mouse_speed_mean", "mouse_path_length", "coordinate_entropy", "click_interval_entropy", "requests_per_minute",
    "session_duration_sec", "channel_entropy", "app_entropy",
]


def split_sessions(spark, folder):
    def build(s, f):
        df = profiled(s, f).select("session_id", "label", *TRAIN_FEATURES, "channel")
        return sampling.stratified_split(df)

    return staged(spark, folder, "split", build)


PREDICTION = ["session_id", "label", "prediction", "probability_array"]


@query("mdl01_model_input", prof(f"SELECT label, {Rs(TRAIN_FEATURES)}, channel FROM sc"))
def _(spark, folder):
    kept, numeric, categorical = models.model_input(profiled(spark, folder).select("session_id", "label", *TRAIN_FEATURES, "channel"))
    return rounded(kept.select("label", *numeric, *categorical))


_MODELS: dict[tuple[str, str, str], object] = {}


def fitted_once(spark, folder, name, build):
    """A model of this application and folder, fitted once for all queries that need it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def training_rows(spark, folder):
    return split_sessions(spark, folder).filter("not is_test").drop("is_test")


def test_rows(spark, folder):
    return split_sessions(spark, folder).filter("is_test").drop("is_test")


def forest_model(spark, folder):
    """The forest in memory and the path it was saved to."""

    def build():
        model, path = models.fit_classifier(training_rows(spark, folder), models.random_forest()), work_folder(spark, "forest-model")
        writers.save_model(model, path)
        return model, path

    return fitted_once(spark, folder, "forest", build)


def forest(spark, folder):
    """Test predictions of the saved forest, written once."""
    return staged(spark, folder, "forest", lambda s, f: models.apply_classifier(writers.load_model(forest_model(s, f)[1]), test_rows(s, f)).select(*PREDICTION))


def boosted_model(spark, folder, settings=None):
    settings = settings or boosting.level_wise()
    return fitted_once(spark, folder, repr(settings), lambda: models.fit_boosted(training_rows(spark, folder), settings))


def boosted(spark, folder):
    return staged(spark, folder, "boosted", lambda s, f: boosted_model(s, f).apply(test_rows(s, f)).select(*PREDICTION))


def leaf_wise(spark, folder):
    return staged(spark, folder, "leaf_wise", lambda s, f: boosted_model(s, f, boosting.leaf_wise()).apply(test_rows(s, f)).select(*PREDICTION))


#: What must hold of any classifier's output: a row per test session, probabilities that sum to one, the largest wins.
TESTED = f"SELECT count(*) AS n, count(*) AS sums_to_one, count(*) AS largest_wins FROM ({ORACLES['smp06_stratified_split']}) WHERE is_test"


def invariants(out):
    total = F.aggregate("probability_array", F.lit(0.0), lambda t, p: t + p)
    return out.agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.element_at("probability_array", F.col("prediction").cast("int") + 1) >= F.array_max("probability_array") - 1e-12).alias("largest_wins"),
    )


@query("mdl02_random_forest")
def _(spark, folder):
    return forest(spark, folder)


@query("mdl02_forest_invariants", TESTED)
def _(spark, folder):
    return invariants(forest(spark, folder))


def deep_forest(spark, folder):
    """Test predictions of the forest without a depth limit, written once."""

    def build(s, f):
        return models.fit_forest(training_rows(s, f)).apply(test_rows(s, f)).select(*PREDICTION)

    return staged(spark, folder, "deep_forest", build)


@query("mdl02_unlimited_forest")
def _(spark, folder):
    return deep_forest(spark, folder)


@query("mdl02_unlimited_invariants", TESTED)
def _(spark, folder):
    return invariants(deep_forest(spark, folder))


@query("mdl06_feature_importance")
def _(spark, folder):
    model = forest_model(spark, folder)[0]
    return models.feature_importance(model, model.transform(training_rows(spark, folder).withColumn("label", F.col("label").cast("double"))))


@query("mdl06_boosted_importance")
def _(spark, folder):
    return models.boosted_importance(boosted_model(spark, folder), spark)


@query("mdl03_boosted_trees")
def _(spark, folder):
    return boosted(spark, folder)


@query("mdl03_boosted_invariants", TESTED)
def _(spark, folder):
    return invariants(boosted(spark, folder))


@query("mdl03_leaf_wise_trees")
def _(spark, folder):
    return leaf_wise(spark, folder)


@query("mdl03_leaf_wise_invariants", TESTED)
def _(spark, folder):
    return invariants(leaf_wise(spark, folder))


@query("mdl03_jobs_equal_task", f"SELECT count(*) AS n, count(*) AS equal FROM ({ORACLES['smp06_stratified_split']}) WHERE is_test")
def _(spark, folder):
    """A few rounds grown by a job per level and inside one task give the same probabilities."""
    few = boosting.level_wise(rounds=3, depth=4)
    one, many = (models.fit_boosted(training_rows(spark, folder), few, task_rows=n).apply(test_rows(spark, folder)) for n in (1 << 40, 0))
    both = one.select("session_id", F.col("probability_array").alias("p")).join(many, "session_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("probability_array")).alias("equal"))


def sequence_predictions(spark, folder):
    def build(s, f):
        seq = click_seq(s, f).select("session_id", "label", "steps")
        marked = staged(s, f, "sequence_split", lambda *_: sampling.stratified_split(seq))
        model, scaler = models.fit_sequences(marked.filter("not is_test"), 6)
        return model.transform(standardise_steps(marked.filter("is_test"), scaler)).select(*PREDICTION)

    return staged(spark, folder, "sequence_predictions", build)


@query("mdl04_sequence_classifier")
def _(spark, folder):
    return sequence_predictions(spark, folder)


@query("mdl04_sequence_invariants", TESTED)
def _(spark, folder):
    return invariants(sequence_predictions(spark, folder))


@query("evl01_model_comparison")
def _(spark, folder):
    outs = {"RandomForest": forest(spark, folder)}
    fits = {"Boosted": boosted, "LeafWise": leaf_wise, "Sequence": sequence_predictions}
    # these fits wait for many small jobs: side by side they fill each other's pauses
    with ThreadPoolExecutor(len(fits)) as pool:
        outs |= dict(zip(fits, pool.map(lambda fit: fit(spark, folder), fits.values())))
    vote = models.soft_vote(outs["Boosted"], outs["Sequence"], "session_id")
    outs["Ensemble"] = vote.join(outs["Boosted"].select("session_id", "label"), "session_id")
    return models.compare_models({name: evaluation.classification_metrics(out) for name, out in outs.items()})


# --- sinks: written, read back and compared ----------------------------------------------


@query("snk01_write_parquet", prof(f"SELECT session_id, label, {Rs('requests_per_minute')} FROM sc"))
def _(spark, folder):
    path = work_folder(spark, "sink-parquet")
    writers.write_table(profiled(spark, folder).select("session_id", "label", "requests_per_minute"), path)
    return rounded(spark.read.parquet(path))


@query("snk01_write_csv", prof(f"SELECT session_id, label, {Rs('requests_per_minute')} FROM sc"))
def _(spark, folder):
    path = work_folder(spark, "sink-csv")
    writers.write_table(profiled(spark, folder).select("session_id", "label", "requests_per_minute"), path, "csv")
    return rounded(spark.read.schema("session_id string, label int, requests_per_minute double").option("header", True).csv(path))


@query("snk02_write_report_json", prof("SELECT 'label_counts' AS section, label::VARCHAR AS item, count(*)::VARCHAR AS value FROM sc GROUP BY label"))
def _(spark, folder):
    from sessionloom.operators.profile import label_counts

    path = work_folder(spark, "sink-json")
    writers.write_report_json(label_counts(profiled(spark, folder)), path)
    return spark.read.schema("section string, item string, value string").json(path)


@query("snk03_write_sequences", prof("SELECT session_id, label, 50 AS length, 6 AS features FROM sc"))
def _(spark, folder):
    from sessionloom.operators.sequences import fit_step_scaler

    path = work_folder(spark, "sink-sequences")
    seq = click_seq(spark, folder)
    writers.write_sequences(seq, fit_step_scaler(seq, 6), path)
    width = spark.read.parquet(f"{path}/scaler").count()
    return spark.read.parquet(f"{path}/sequences").select("session_id", "label", F.size("steps").alias("length"), F.lit(width).cast("int").alias("features"))


def reloaded(spark, folder):
    """Test rows with the predictions of the forest before and after it was saved and loaded."""
    # a category the fit has not seen and a missing one go through the saved fills
    odd = F.when(F.crc32(F.col("session_id").cast("binary")) % 5 == 0, F.lit(None)).when(F.crc32(F.col("session_id").cast("binary")) % 5 == 1, "never seen")
    test = test_rows(spark, folder).withColumn("channel", F.when(F.crc32(F.col("session_id").cast("binary")) % 5 < 2, odd).otherwise(F.col("channel")))
    model, path = forest_model(spark, folder)
    before = models.apply_classifier(model, test).select("session_id", F.col("probability_array").alias("p"))
    return models.apply_classifier(writers.load_model(path), test).select(*PREDICTION).join(before, "session_id")


@query("snk04_save_model")
def _(spark, folder):
    return reloaded(spark, folder).select(*PREDICTION)


@query("snk04_reload_equality", f"SELECT count(*) AS n, count(*) AS equal FROM ({ORACLES['smp06_stratified_split']}) WHERE is_test")
def _(spark, folder):
    return reloaded(spark, folder).agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("probability_array")).alias("equal"))


# --- streams -----------------------------------------------------------------------------


def click_stream(spark, folder):
    raw = streams.stream_table(spark, folder, "events", EVENT_SCHEMA)
    return raw.select(
        "event_id",
        F.col("user_id").alias("ip"),
        (F.col("user_id") % 3).alias("device"),
        (F.col("user_id") % 4).alias("os"),
        F.col("ts").cast("timestamp").alias("click_time"),
        (F.col("event_type") == "purchase").cast("int").alias("is_attributed"),
    )


KEYS = ["ip", "device", "os"]
GAP = f"{GAP_MINUTES} minutes"
# a session is emitted once the watermark (newest time - 10 minutes, whole milliseconds) reaches its end + gap
CLOSED = f"""cw AS (SELECT ip, device, os, count(*) AS click_count, sum(is_attributed)::BIGINT AS install_count, min(click_time) AS a, max(click_time) AS z,
  sum(interval_us) / count(*) / 1e6 AS im, stddev_samp(interval_us) / 1e6 AS isd, any_value(session_id) AS session_id FROM ev GROUP BY ev.session_id, ip, device, os),
cd AS (SELECT * FROM cw WHERE epoch_us(z) + {GAP_MINUTES * 60_000_000} <= (SELECT (epoch_us(max(click_time)) // 1000 - 600000) * 1000 FROM clicks))"""
WATCH = f"WITH {CLICKS}, {ev_sql()}, {CLOSED}"


@query(
    "str01_session_windows",
    f"""{WATCH} SELECT ip, device, os, click_count, install_count, {S('a')} AS session_start, {S('z')} AS session_end FROM cd""",
)
def _(spark, folder):
    out = streams.run_to_table(streams.session_windows(click_stream(spark, folder), KEYS, GAP), "session-windows")
    return stamp(out, "session_start", "session_end")


@query(
    "str01_session_windows_complete",
    f"""{WATCH} SELECT ip, device, os, click_count, install_count, {S('a')} AS session_start, {S('z')} AS session_end FROM cw""",
)
def _(spark, folder):
    out = streams.run_to_table(streams.session_windows(click_stream(spark, folder), KEYS, GAP), "session-windows", "complete")
    return stamp(out, "session_start", "session_end")


@query(
    "str02_session_window_features",
    f"""{WATCH} SELECT ip, device, os, click_count, {R('greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1)')} AS session_duration_sec,
  {R('(epoch_us(z) - epoch_us(a)) / 1e6 / click_count')} AS click_interval_mean,
  {R('click_count / (greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) / 60.0)')} AS requests_per_minute, {R('install_count / click_count::DOUBLE')} AS success_rate FROM cd""",
)
def _(spark, folder):
    out = streams.run_to_table(streams.session_window_features(click_stream(spark, folder), KEYS, GAP), "session-features")
    return rounded(out.drop("install_count", "session_start", "session_end"))


@query(
    "str02_labelled_sessions",
    f"""{WATCH}, sr AS (SELECT *, click_count / (greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) / 60.0) AS rate FROM cd)
SELECT ip, device, os, click_count, {R('rate')} AS requests_per_minute, (install_count = 0 AND rate >= (SELECT quantile_disc(rate, 0.99) FROM sr))::INT AS label FROM sr""",
)
def _(spark, folder):
    out, _ = labels.label_closed_sessions(streams.session_window_features(click_stream(spark, folder), KEYS, GAP))
    return rounded(out.select(*KEYS, "click_count", "requests_per_minute", "label"))


@query(
    "str03_session_interval_features",
    f"""{WATCH} SELECT ip, device, os, click_count, {R('im')} AS click_interval_mean, {R('isd')} AS click_interval_std FROM cd""",
)
def _(spark, folder):
    out = streams.session_interval_features(click_stream(spark, folder), KEYS, GAP_MINUTES * 60_000_000)
    done = streams.run_to_table(out, "session-intervals")
    return rounded(done.select(*KEYS, "click_count", "click_interval_mean", "click_interval_std"))


@query(
    "str03_scored_sessions",
    f"""{WATCH}, hs AS {hist_entropy_sql('interval_us', 10, 'ev')},
s AS (SELECT cd.*, im AS click_interval_mean, isd AS click_interval_std, h AS click_interval_entropy, coalesce(isd, 0) AS request_interval_std, 0.0 AS device_entropy,
  greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) AS session_duration_sec, click_count / (greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) / 60.0) AS requests_per_minute,
  click_count / (greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) / 60.0) AS clicks_per_minute,
  least(greatest(coalesce(isd, 0) / (greatest((epoch_us(z) - epoch_us(a)) / 1e6, 1) + 1e-6), 0), 1) AS session_idle_ratio FROM cd JOIN hs USING (session_id)),
{PROXY}, {SCORE} SELECT ip, device, os, click_count, {Rs('click_interval_mean click_interval_std click_interval_entropy coordinate_entropy bot_likelihood_score')} FROM sc""",
)
def _(spark, folder):
    out = scored.scored_sessions(click_stream(spark, folder), KEYS, GAP_MINUTES * 60_000_000)
    done = streams.run_to_table(out, "scored-sessions")
    return rounded(done.select(*KEYS, "click_count", "click_interval_mean", "click_interval_std", "click_interval_entropy", "coordinate_entropy", "bot_likelihood_score"))


def disordered(spark, folder):
    """The clicks as they arrive when a tenth of them is up to nine days late, a file for every three days of arrival."""
    path = work_folder(spark, "disordered")
    draw = uniform(F.col("event_id"), "late")
    delay = F.when(draw < 0.1, draw * 7_776_000.0).otherwise(0.0)
    arrival = F.floor((F.unix_micros("click_time") / 1e6 + delay) / 259_200.0)
    rows = staged(spark, folder, "arrivals", lambda s, f: clicks(s, f).select("event_id", "click_time", arrival.alias("arrival")))
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    for turn in range(first, last + 1) if first is not None else ():
        rows.where(F.col("arrival") == turn).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("event_id long, click_time timestamp").option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "str06_late_rows",
    f"""WITH {CLICKS}, a AS (SELECT event_id, epoch_us(click_time) AS us, {U('event_id::VARCHAR', 'late')} AS u FROM clicks),
b AS (SELECT *, dense_rank() OVER (ORDER BY floor((us / 1e6 + CASE WHEN u < 0.1 THEN u * 7776000.0::DOUBLE ELSE 0 END) / 259200.0::DOUBLE)) - 1 AS batch FROM a),
m AS (SELECT batch, max(us) AS top FROM b GROUP BY batch),
w AS (SELECT batch, (max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 - 600000) * 1000 AS mark FROM m)
SELECT event_id, batch::INT AS batch, (mark - us)::BIGINT AS late_us FROM b JOIN w USING (batch) WHERE us <= mark""",
)
def _(spark, folder):
    return late.split_late(disordered(spark, folder), "click_time", 600_000)[1].select("event_id", "batch", "late_us")


@query(
    "str04_rate_windows",
    f"""WITH {CLICKS}, b AS (SELECT ip, date_trunc('hour', click_time) AS w, count(*) AS n FROM clicks GROUP BY 1, 2)
SELECT ip, {S('w')} AS window_start, n, {R('n / 60.0')} AS per_minute FROM b WHERE w + INTERVAL 1 HOUR <= (SELECT max(click_time) - INTERVAL 10 MINUTE FROM clicks)""",
)
def _(spark, folder):
    out = streams.run_to_table(streams.rate_windows(click_stream(spark, folder), ["ip"], "1 hour"), "rate-windows")
    return rounded(stamp(out.drop("window_end"), "window_start"))


@query(
    "str04_sliding_rate_windows",
    f"""WITH {CLICKS}, b AS (SELECT ip, time_bucket(INTERVAL 30 MINUTE, click_time) - to_minutes(30 * k) AS w, count(*) AS n FROM clicks, (VALUES (0), (1)) v(k) GROUP BY 1, 2)
SELECT ip, {S('w')} AS window_start, n FROM b WHERE w + INTERVAL 1 HOUR <= (SELECT max(click_time) - INTERVAL 10 MINUTE FROM clicks)""",
)
def _(spark, folder):
    out = streams.run_to_table(streams.rate_windows(click_stream(spark, folder), ["ip"], "1 hour", "30 minutes"), "sliding-windows")
    return stamp(out.select("ip", "window_start", "n"), "window_start")


@query("str05_first_per_key", f"WITH {CLICKS} SELECT DISTINCT ip, device, os FROM clicks")
def _(spark, folder):
    out = streams.first_per_key_stream(click_stream(spark, folder), KEYS, "click_time", "3650 days")
    return streams.run_to_table(out.select(*KEYS, "click_time", "event_id"), "first-per-key").select(*KEYS)
