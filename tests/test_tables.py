"""Cleaning, sequences, anomalies, sources and streams on small fixtures."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import anomaly, clean, evaluation, profile, sequences, structure
from sessionloom.schema import CLICK_SCHEMA
from sessionloom.session import work_folder
from sessionloom.sources import readers, writers
from sessionloom.streaming import sessions as streams


def test_correlated_and_equal_columns(spark):
    rng = np.random.default_rng(1)
    a = rng.random(200)
    pdf = pd.DataFrame({"session_id": [f"s{i}" for i in range(200)], "label": 0, "click_count": a, "total_requests": 2 * a, "zeta": a + rng.random(200) * 1e-6, "free": rng.random(200), "same": a, "flat": 1.0})
    df = spark.createDataFrame(pdf)
    drops, kept = clean.correlated_drops(df)
    # the pair rule keeps click_count, the protected one stays, later names go; flat has no correlation
    assert drops == ["same", "total_requests", "zeta"] and kept == []
    assert clean.duplicate_column_pairs(df, "session_id", ["click_count", "same", "free", "flat"]) == [("click_count", "same")]
    thinner, gone = clean.drop_duplicate_columns(df.drop("zeta"), "session_id")
    assert gone == ["same"] and "click_count" in thinner.columns


def test_impute_and_scale(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("b", None, 5.0, "x"), ("c", 4, None, "y")], "session_id string, n int, v double, t string")
    rows = {r["session_id"]: r for r in clean.impute(df).collect()}
    assert rows["b"]["n"] == 2.5 and rows["c"]["v"] == 3.0 and rows["a"]["t"] == "unknown"
    scaled = sorted(r["v"] for r in clean.robust_scale(df.dropna(subset=["v"]), ["v"]).collect())
    assert scaled == [-1.0, 1.0]
    codes = {r["session_id"]: r["t"] for r in clean.label_encode(df, ["t"]).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def steps(spark, n):
    rows = [("s", 0, "m", i + 1, [float(i), 10.0 * i]) for i in range(n)]
    return sequences.gather_steps(spark.createDataFrame(rows, "session_id string, label int, sequence_type string, step int, features array<double>"))


def test_padding_rules(spark):
    short, long = steps(spark, 2), steps(spark, 5)
    first = lambda df: [s[0] for s in df.first()["steps"]]
    assert first(sequences.zero_pad(short, 4, 2)) == [0, 1, 0, 0]
    assert first(sequences.zero_pad(long, 3, 2)) == [0, 1, 2]
    assert first(sequences.repeat_pad(short, 4)) == [0, 1, 1, 1]
    assert first(sequences.keep_last_pad(long, 3, 2)) == [2, 3, 4]
    assert first(sequences.keep_last_pad(short, 3, 2)) == [0, 1, 0]
    wide = sequences.widen_features(short, 4).first()["steps"]
    assert wide[1] == [1.0, 10.0, 0.0, 0.0]
    padded = sequences.zero_pad(short, 4, 2)
    scaler = sequences.fit_step_scaler(padded, 2)
    got = np.array(sequences.standardise_steps(padded, scaler).first()["steps"])
    raw = np.array([[0, 0], [1, 10], [0, 0], [0, 0]], dtype=float)
    np.testing.assert_allclose(got, (raw - raw.mean(0)) / raw.std(0))


def test_rolling_entropy(spark):
    rows = [([1.0],), ([1.0, 1.0, 1.0],), ([0.0, 1.0],), ([0.0, 1.0, 2.0, 3.0, 4.0],)]
    out = spark.createDataFrame(rows, "v array<double>").select(sequences.rolling_entropy(F.col("v")).alias("e"))
    assert [r["e"] for r in out.collect()] == pytest.approx([0.0, 0.0, 1.0, np.log2(5)], abs=1e-9)


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (600, 3)), rng.normal(12, 0.5, (12, 3))])
    pdf = pd.DataFrame(x, columns=list("abc")).assign(session_id=[f"s{i}" for i in range(len(x))])
    df = spark.createDataFrame(pdf)
    one = anomaly.detect_anomalies(df, list("abc"), trees=40).toPandas().set_index("session_id")["anomaly_score"]
    far = [f"s{i}" for i in range(600, 612)]
    assert one[far].min() > one.drop(far).quantile(0.95)
    assert int((one > 0).sum()) == pytest.approx(0.03 * len(x), abs=2)
    two = anomaly.detect_anomalies(df.repartition(3), list("abc"), trees=40).toPandas().set_index("session_id")["anomaly_score"]
    pd.testing.assert_series_equal(one.sort_index(), two.sort_index())


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 3, 300), rng.dirichlet([1, 1, 1], 300).round(2)
    rows = [(i, int(a), [float(v) for v in b], int(np.argmax(b))) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "k int, label int, probability_array array<double>, prediction int")
    got = evaluation.classification_metrics(df).first()
    assert got["accuracy"] == pytest.approx((y == p.argmax(1)).mean())
    assert got["recall"] == pytest.approx(got["accuracy"])
    auc = {r["class"]: r["auc"] for r in evaluation.roc_auc(df).collect()}
    for c in range(3):
        pos, neg = p[y == c, c], p[y != c, c]
        want = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
        assert auc[str(c)] == pytest.approx(want)
    curve = evaluation.micro_roc_curve(df).orderBy("threshold").collect()
    assert curve[0]["fpr"] == curve[0]["tpr"] == 1.0


def test_sources_and_sinks(spark):
    path = work_folder(spark, "test-csv")
    rows = spark.createDataFrame([(1, 2, 3, 4, 5, "2017-11-07 09:30:00", None, 1)], "ip long, app long, device long, os long, channel long, click_time string, attributed_time string, is_attributed int")
    writers.write_table(rows, f"{path}/train_sample.csv", "csv")
    assert readers.read_clicks_projected(spark, path).first()["click_time"].year == 2017
    assert readers.read_or_empty(spark, f"{path}/none.csv", CLICK_SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_clicks_projected(spark, f"{path}/nowhere")
    with pytest.raises(ValueError):
        readers.normalise_clicks(rows.drop("click_time"))


def test_first_per_key_and_cycle(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in structure.first_per_key(df, "k", ["o"]).collect()} == {"a": "y", "b": "z"}
    base = spark.createDataFrame([(0, "p"), (1, "q")], "i long, v string")
    assert [r["v"] for r in structure.cycle_rows(base, 5, "i").orderBy("clone").collect()] == ["p", "q", "p", "q", "p"]


def test_flat_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 1.0)], "a double, b double, c double")
    rows = profile.correlation_pairs(df, ["a", "b", "c"]).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in rows] == [("a", "b")] and rows[0]["correlation"] == pytest.approx(1.0)


# --- streams -----------------------------------------------------------------------------


def replay(spark, batches):
    """Write one file per batch and stream them in order."""
    path = work_folder(spark, "replay")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), a) for k, t, a in rows], "ip long, click_time timestamp, is_attributed int")
        df.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [
    [(1, "2024-01-01 00:00:00", 0), (1, "2024-01-01 00:20:00", 1), (2, "2024-01-01 00:05:00", 0)],
    [(1, "2024-01-01 00:50:00", 0), (2, "2024-01-01 06:00:00", 0)],  # exactly 30 min after: same session
    [(5, "2024-01-01 06:01:00", 0)],
    [(1, "2024-01-01 00:40:00", 0), (3, "2024-01-01 12:00:00", 0)],  # far behind the watermark: dropped
    [(4, "2024-01-02 12:00:00", 0)],
]


def test_stream_sessions_drop_late_events(spark):
    out = streams.run_to_table(streams.session_windows(replay(spark, BATCHES), ["ip"], "30 minutes"), "t-sessions")
    rows = sorted((r["ip"], r["click_count"], str(r["session_start"])) for r in out.collect())
    assert rows == [(1, 3, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:05:00"), (2, 1, "2024-01-01 06:00:00"), (3, 1, "2024-01-01 12:00:00"), (5, 1, "2024-01-01 06:01:00")]


def test_stream_interval_statistics(spark):
    stream = streams.session_interval_features(replay(spark, BATCHES), ["ip"], 30 * 60_000_000)
    rows = {(r["ip"], r["click_count"]): r for r in streams.run_to_table(stream, "t-intervals").collect()}
    pauses = np.array([0.0, 1200.0, 1800.0])
    one = rows[(1, 3)]
    assert one["click_interval_mean"] == pytest.approx(pauses.mean())
    assert one["click_interval_std"] == pytest.approx(pauses.std(ddof=1))
    assert one["click_interval_entropy"] == pytest.approx(np.log2(3), abs=1e-6)
    assert rows[(2, 1)]["click_interval_std"] is None


def test_stream_dedup_within_watermark(spark):
    out = streams.run_to_table(streams.first_per_key_stream(replay(spark, BATCHES), ["ip"], "click_time", "30 days"), "t-dedup")
    assert sorted(r["ip"] for r in out.collect()) == [1, 2, 3, 4, 5]


def test_python_workers_need_no_package_copy(tmp_path):
    """The forest runs from a working directory where the package cannot be imported by workers."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import functions as F
from sessionloom.session import build_session
from sessionloom.operators.anomaly import detect_anomalies
spark = build_session("ship", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
df = spark.range(300).select(F.col("id").cast("string").alias("session_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
print("rows", detect_anomalies(df, ["a", "b"], trees=5, sample=32).filter("anomaly_score is not null").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 300" in done.stdout, done.stderr[-2000:]


def test_replacing_a_class_keeps_rows_without_label(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "session_id string, label int")
    new = spark.createDataFrame([("d", 1)], "session_id string, label int")
    assert sorted(r["session_id"] for r in structure.replace_class(df, new, 1).collect()) == ["b", "c", "d"]


def test_preprocessing_fills_scales_and_ignores_unknown_values(spark):
    from pyspark.ml.functions import vector_to_array

    from sessionloom.operators.models import preprocessing_model

    rows = [("a", 0, 5.0, 1.0, "x"), ("b", 1, 5.0, 3.0, "x"), ("c", 0, 5.0, None, "y"), ("d", 1, 6.0, 5.0, None)]
    df = spark.createDataFrame(rows, "session_id string, label int, flat double, wide double, kind string")
    model = preprocessing_model(df)
    fresh = spark.createDataFrame([("e", 0, 6.0, None, "z"), ("f", 0, None, 5.0, "y")], df.schema)
    got = {r["session_id"]: r["f"] for r in model.transform(fresh).select("session_id", vector_to_array("features").alias("f")).collect()}
    assert got["e"][0] == 4.0  # (6 - 5) / 0.25
    assert got["e"][1] == 0.0 and got["e"][2:] == [0.0, 0.0, 0.0]
    assert got["f"][0] == 0.0 and sum(got["f"][2:]) == 1.0


def in_file_order(rows, cap, minimum, chunk):
    """The chunk loop of a reader over (key, label) rows."""
    positives, negatives = [], []
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        positives += [k for k, label in part if label == 1]
        negatives += [k for k, label in part if label != 1][: max(0, cap - len(negatives))]
        if len(positives) >= minimum and len(negatives) >= cap:
            break
    return sorted(positives + negatives)


@pytest.mark.parametrize("cap, minimum, chunk", [(40, 10, 16), (40, 60, 16), (0, 5, 16), (16, 1, 16), (10_000, 5, 16), (50, 10_000, 7), (64, 1, 1000), (15, 2, 15)])
def test_capped_scan_reads_like_a_chunk_loop(spark, tmp_path, cap, minimum, chunk):
    from sessionloom.sources import readers

    rows = [(i, None if i % 17 == 3 else int(i % 5 == 0 and (i < 60 or i > 150))) for i in range(300)]
    path = str(tmp_path / "clicks")
    spark.createDataFrame(rows, "k int, is_attributed int").coalesce(1).write.parquet(path)
    got = readers.capped_class_scan(readers.read_numbered(spark, path), cap, minimum, chunk)
    assert sorted(r["k"] for r in got.collect()) == in_file_order(rows, cap, minimum, chunk)


def test_capped_scan_of_nothing(spark, tmp_path):
    from sessionloom.sources import readers

    path = str(tmp_path / "none")
    spark.createDataFrame([], "k int, is_attributed int").write.parquet(path)
    assert readers.capped_class_scan(readers.read_numbered(spark, path), 5, 5, 5).count() == 0


LATE_BATCHES = [
    [(1, "2024-01-01 00:00:00", 0), (2, "2024-01-01 01:00:00", 0)],
    [(3, "2024-01-01 02:00:00", 0), (4, "2024-01-01 00:10:00", 0)],
    [(5, "2024-01-01 03:00:00", 0), (6, "2024-01-01 00:49:59", 0), (7, "2024-01-01 00:50:00", 0), (8, "2024-01-01 00:50:00.001", 0)],
    [(9, "2024-01-01 00:00:01", 0), (10, "2024-01-01 04:00:00", 0)],
    [(11, "2024-01-01 02:50:00", 0), (12, "2024-01-01 05:00:00", 0)],
]


def test_late_rows_are_those_the_engine_drops(spark):
    from sessionloom.streaming import late

    on_time, behind = late.split_late(replay(spark, LATE_BATCHES), "click_time", 600_000)
    assert {r["ip"]: (r["batch"], r["late_us"]) for r in behind.collect()} == {6: (2, 1_000_000), 7: (2, 0), 9: (3, 6_599_000_000), 11: (4, 0)}
    assert sorted(r["ip"] for r in on_time.collect()) == [1, 2, 3, 4, 5, 8, 10, 12]
    target = work_folder(spark, "dropped")
    stream = replay(spark, LATE_BATCHES).withWatermark("click_time", "10 minutes").dropDuplicates(["ip", "click_time"])
    query = stream.writeStream.option("checkpointLocation", target + "-state").trigger(availableNow=True).format("parquet").start(target)
    query.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == behind.count()


def test_scored_sessions_on_map_state(spark):
    from sessionloom.streaming import scored

    out = streams.run_to_table(scored.scored_sessions(replay(spark, BATCHES), ["ip"], 30 * 60_000_000), "t-scored")
    rows = {(r["ip"], r["click_count"], str(r["session_start"])): r for r in out.collect()}
    assert set(rows) == {(1, 3, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:05:00"), (2, 1, "2024-01-01 06:00:00"), (3, 1, "2024-01-01 12:00:00"), (5, 1, "2024-01-01 06:01:00")}
    pauses = np.array([0.0, 1200.0, 1800.0])
    one = rows[(1, 3, "2024-01-01 00:00:00")]
    assert one["click_interval_std"] == pytest.approx(pauses.std(ddof=1)) and one["click_interval_entropy"] == pytest.approx(np.log2(3), abs=1e-6)
    assert one["bot_likelihood_score"] is not None


class CountedState:
    """A keyed state in memory that counts the calls of all states."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "exists":
                return bool(self.held)
            if name == "clear":
                self.held = None
            elif name == "appendList":
                self.held = (self.held or []) + list(given[0])
            elif name in ("put", "update"):
                self.held = given[0]
            elif name == "containsKey":
                return given[0] in (self.held or {})
            elif name == "getValue":
                return self.held[given[0]]
            elif name == "updateValue":
                self.held = {**(self.held or {}), given[0]: given[1]}
            elif name == "removeKey":
                del self.held[given[0]]
            elif name == "iterator":
                return iter((self.held or {}).items())
            elif name == "keys":
                return iter(list(self.held or {}))
            elif name == "get":
                return iter(self.held or []) if isinstance(self.held, (list, type(None))) else self.held

        return call


def test_state_calls_follow_the_keys_not_their_events():
    from types import SimpleNamespace

    from sessionloom.streaming import scored

    calls, minute = [], 60_000_000
    state = lambda *_: CountedState(calls)
    handle = SimpleNamespace(getValueState=state, getMapState=state, getListState=state, registerTimer=lambda ms: calls.append("registerTimer"))
    one = scored.IntervalSessions(["ip"], 30 * minute)
    one.init(handle)
    # 300 sessions of two instants, an hour apart; the watermark passes all but the last 50
    times = [h * 60 * minute + m * minute for h in range(1, 301) for m in (0, 10)]
    assert not list(one.handleInputRows((7,), iter([pd.DataFrame({"us": times[::-1]})]), None))
    mark = lambda h: SimpleNamespace(getCurrentWatermarkInMs=lambda: h * 3_600_000 - 1)
    first = pd.concat(one.handleExpiredTimer((7,), mark(251), None))
    rest = pd.concat(one.handleExpiredTimer((7,), mark(302), None))
    both = pd.concat([first, rest])
    assert (len(first), len(both)) == (250, 300) and set(both["click_count"]) == {2} and both["session_start"].is_monotonic_increasing
    assert len(calls) < 30


def test_thresholds_of_a_stream_stay_within_the_sketch_bound(spark):
    """Three batches of sessions; after each, the threshold's rank among all sessions so far is near 0.9."""
    from sessionloom.streaming import labels

    draw, path, parts = np.random.RandomState(3), work_folder(spark, "rates"), []
    for i in range(3):
        rates = np.round(draw.lognormal(i, 1, 4000), 3)
        parts.append(rates)
        rows = [(int(k), float(v), int(k % 5 == 0)) for k, v in enumerate(rates)]
        spark.createDataFrame(rows, "k int, requests_per_minute double, install_count int").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k int, requests_per_minute double, install_count int").option("maxFilesPerTrigger", 1).parquet(path)
    out, thresholds = labels.label_closed_sessions(stream, 0.9, size=400)
    held = {r["batch"]: (r["threshold"], r["seen"]) for r in thresholds.collect()}
    assert [held[b][1] for b in range(3)] == [4000, 8000, 12000]
    for b in range(3):
        so_far = np.concatenate(parts[: b + 1])
        assert abs((so_far <= held[b][0]).mean() - 0.9) < 2.3 / 400**0.9 + 1e-3
    for r in out.groupBy("batch").agg({"label": "sum", "k": "count"}).collect():
        rates = parts[r["batch"]]
        want = sum(1 for k, v in enumerate(rates) if v >= held[r["batch"]][0] and k % 5)
        assert (r["sum(label)"], r["count(k)"]) == (want, 4000)
