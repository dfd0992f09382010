"""Sessions against hand-computed values and a pandas restatement."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.score import bot_score
from sessionloom.operators import enrich, sessions, structure
from sessionloom.operators.motion import motion_features
from sessionloom.plans.chunks import hot_keys, ordered_points, time_gaps
from sessionloom.schema import SESSION_COLUMNS
from sessionloom.sources.readers import normalise_clicks

SCHEMA = "event_id long, ip long, app long, device long, os long, channel long, click_time string, is_attributed int"


def clicks(spark, rows):
    full = [(i, 1, 3, 1, 13, 111, t, a) for i, (t, a) in enumerate(rows)]
    return normalise_clicks(spark.createDataFrame(full, SCHEMA), calendar=False)


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("2017-11-07 09:30:00", 1), ("2017-11-07 09:30:05", 0), ("2017-11-07 10:15:00", 0), ("2017-11-07 10:15:03", 1)]
    ev = sessions.sessionize(clicks(spark, rows))
    df = enrich.behavioural_proxies(sessions.label_sessions_by_install(sessions.session_temporal_features(ev)))
    df = df.withColumn("is_proxy", F.lit(0))
    return {r["session_id"]: r.asDict() for r in df.withColumn("score", bot_score(df)).collect()}


GOLDEN = {
    "td_1_1_13_1": dict(
        click_count=2, install_count=1, label=0, session_duration_sec=5.0, click_interval_mean=2.5, click_interval_std=3.5355,
        click_interval_median=2.5, requests_per_minute=24.0, click_interval_entropy=1.0, device_entropy=0.0, session_idle_ratio=0.7071,
        success_rate=0.5, mouse_speed_mean=58.0, mouse_speed_std=21.1421, mouse_path_length=148.0310, direction_change_count=1,
        coordinate_entropy=2.5041, movement_std=8.0435, mouse_acceleration_std=6.0406, movement_curvature=0.0068, score=1.9,
        original_ip=1, app=3, channel=111,
    ),
    "td_1_1_13_2": dict(
        click_count=2, install_count=1, label=0, session_duration_sec=3.0, click_interval_mean=1.5, click_interval_std=2.1213,
        click_interval_median=1.5, requests_per_minute=40.0, click_interval_entropy=1.0, channel_entropy=0.0, session_idle_ratio=0.7071,
        success_rate=0.5, mouse_speed_mean=78.0, mouse_speed_std=18.8794, mouse_path_length=212.7184, direction_change_count=1,
        coordinate_entropy=2.4394, movement_std=7.3505, mouse_acceleration_std=7.5518, movement_curvature=0.0047, score=1.9,
    ),
}


@pytest.mark.parametrize("session_id", sorted(GOLDEN))
def test_golden_rows(golden, session_id):
    assert set(golden) == set(GOLDEN)
    for name, want in GOLDEN[session_id].items():
        assert golden[session_id][name] == pytest.approx(want, abs=6e-5), name


def test_gap_edges_nulls_and_copies(spark):
    rows = [
        ("2017-11-07 09:00:00", 0), ("2017-11-07 09:30:00", 0),  # exactly the gap: same session
        ("2017-11-07 10:00:01", 0),  # one second more: new session
        ("2017-11-07 10:00:01", 1), ("broken", 0), (None, 1),
    ]
    ev = sessions.sessionize(clicks(spark, rows)).orderBy("event_id").collect()
    assert [r["session_index"] for r in ev] == [1, 1, 2, 2]
    assert [r["new_session"] for r in ev] == [1, 0, 1, 0]
    assert [r["interval_us"] for r in ev] == [0, 1_800_000_000, 0, 0]
    keyless = clicks(spark, rows[:2]).withColumn("ip", F.when(F.col("event_id") == 0, F.col("ip")))
    assert sessions.sessionize(keyless).count() == 1


def test_single_click_session(spark):
    ev = sessions.sessionize(clicks(spark, [("2017-11-07 09:00:00", 0)]).withColumn("app", F.lit(None).cast("long")))
    row = sessions.session_temporal_features(ev).first()
    assert row["session_duration_sec"] == 1.0 and row["requests_per_minute"] == 60.0
    assert row["click_interval_std"] is None and row["request_interval_std"] == 0.0
    assert row["app"] is None and row["app_entropy"] == 0.0


def random_clicks(n=3000, seed=3):
    """One key holds a third of the rows, a tenth of all rows are copies of one instant."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    second = rng.integers(0, 5000, n)
    hot = rng.random(n) < 0.1
    key[hot], second[hot] = 0, 77
    return pd.DataFrame({"event_id": np.arange(n), "k": key, "t": pd.to_datetime(second, unit="s")})


@pytest.mark.parametrize("chunk_seconds", [1, 7, 600, 100_000])
def test_time_gaps_do_not_depend_on_chunks(spark, chunk_seconds):
    pdf = random_clicks()
    df = spark.createDataFrame(pdf)
    got = time_gaps(df, ["k"], "t", "event_id", 20_000_000, chunk_seconds).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.drop_duplicates(["k", "t"]).sort_values(["k", "t"]).reset_index(drop=True)
    gap = want.groupby("k")["t"].diff().dt.total_seconds()
    assert len(got) == len(want)
    np.testing.assert_allclose(got["gap_us"].astype(float) / 1e6, gap)
    index = ((gap > 20) | gap.isna()).astype(int).groupby(want["k"]).cumsum()
    assert got["session_index"].tolist() == index.tolist()
    tie = pdf.groupby(["k", "t"])["event_id"].min().reset_index()["event_id"]
    assert got["first_tie"].tolist() == tie.tolist()


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 10_000])
def test_ordered_points_do_not_depend_on_chunks(spark, chunk_rows):
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"s": f"s{g}", "i": np.sort(rng.choice(60, n, replace=False)), "x": rng.random(n), "y": rng.random(n)}) for g, n in enumerate([1, 2, 3, 40, 17])]
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("tie", F.lit(0))
    got = ordered_points(df, "s", "i", "tie", "x", "y", chunk_rows).toPandas().sort_values(["s", "i"])
    want = pdf.sort_values(["s", "i"])
    for k, names in ((1, ["x1", "y1"]), (2, ["x2", "y2"])):
        for name in names:
            np.testing.assert_allclose(got[name], want.groupby("s")[name[0]].shift(k))
    np.testing.assert_allclose(got["i1"], want.groupby("s")["i"].shift(1))
    assert got["ordinal"].tolist() == (want.groupby("s").cumcount() + 1).tolist()
    assert got["n"].tolist() == want.groupby("s")["i"].transform("size").tolist()
    np.testing.assert_allclose(got["x_max"], want.groupby("s")["x"].transform("max"))


@pytest.mark.parametrize("hot_rows", [0, 2, 16, 10_000])
def test_long_and_short_traces_are_ordered_alike(spark, hot_rows):
    rng = np.random.default_rng(6)
    pdf = pd.concat([pd.DataFrame({"s": f"s{g}", "i": rng.integers(0, 30, n), "x": rng.random(n), "y": rng.random(n)}) for g, n in enumerate([1, 2, 3, 40, 17])])
    pdf["tie"] = rng.permutation(len(pdf))
    df = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([(None, 1, 0.5, 0.5, 1), ("s1", None, 0.5, 0.5, 1)], df.schema)
    got = ordered_points(df.union(odd), "s", "i", "tie", "x", "y", 7, hot_rows).toPandas().sort_values(["s", "i", "tie"])
    want = pdf.sort_values(["s", "i", "tie"])
    assert got["tie"].tolist() == want["tie"].tolist()
    for k, names in ((1, ["x1", "y1"]), (2, ["x2", "y2"])):
        for name in names:
            np.testing.assert_allclose(got[name], want.groupby("s")[name[0]].shift(k))
    np.testing.assert_allclose(got["i1"], want.groupby("s")["i"].shift(1))
    assert got["ordinal"].tolist() == (want.groupby("s").cumcount() + 1).tolist()
    assert got["n"].tolist() == want.groupby("s")["i"].transform("size").tolist()
    for c in "xy":
        np.testing.assert_allclose(got[f"{c}_min"], want.groupby("s")[c].transform("min"))
        np.testing.assert_allclose(got[f"{c}_max"], want.groupby("s")[c].transform("max"))


def test_traces_are_shuffled_once(spark):
    df = spark.range(40000).selectExpr("cast(id % 7000 AS string) AS session_id", "id DIV 7000 AS movement_index", "id AS tie", "rand(1) AS x_coordinate", "rand(2) AS y_coordinate")
    plan = motion_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_hot_keys_are_counted_exactly(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 100 THEN id % 3 ELSE id END AS a", "'k' AS b")
    hot, n = hot_keys(df, ["a", "b"], 33)
    assert n == 1000 and hot.collect() == [(0, "k")]
    assert hot_keys(df, ["a", "b"], 34) == (None, 1000)
    assert hot_keys(df.limit(0), ["a", "b"], 0) == (None, 0)


def test_schema_alignment_is_idempotent(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("b", None, 3.0)], "session_id string, label int, extra double")
    once = structure.align_schema(df)
    assert once.columns == SESSION_COLUMNS + ["extra"]
    twice = structure.align_schema(once)
    assert twice.columns == once.columns
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    assert {r["label"] for r in once.collect()} == {0, -1}


def test_missing_values_score_nothing(spark):
    df = spark.createDataFrame([(float("nan"), None)], "requests_per_minute double, coordinate_entropy double")
    from sessionloom.functions.columns import null_if_nan

    clean = df.withColumn("requests_per_minute", null_if_nan(F.col("requests_per_minute")))
    # absent columns count as 0 and earn their low-value points, missing values earn none
    clean = clean.withColumns({c: F.lit(9.0) for c in ("request_interval_std", "device_entropy", "click_interval_entropy", "movement_curvature")})
    assert clean.select(bot_score(clean)).first()[0] == 0.0


def test_whole_keys_and_chunks_agree(spark):
    """A key that is ordered whole and one that is cut into chunks get the same sessions, copies of instants and repeated ties too."""
    draw = np.random.RandomState(5)
    rows = [(i, int(draw.randint(3)), 3, 1, 13, 111, f"2017-11-07 {9 + m // 60:02d}:{m % 60:02d}:00", 0) for i, m in enumerate(draw.randint(0, 600, 400))]
    df = normalise_clicks(spark.createDataFrame(rows + rows[:9], SCHEMA), calendar=False)
    names = ["event_id", "session_id", "session_gap_sec", "new_session", "session_index", "interval_us"]
    whole, chunks, mixed = (
        sorted(map(tuple, sessions.sessionize(df, gap_minutes=4, hot_rows=n).select(*names).collect())) for n in (1 << 30, 0, 130)
    )
    assert whole == chunks == mixed


def test_sessions_take_one_shuffle(spark):
    """From clicks to session rows the events are dealt once, by key."""
    rows = clicks(spark, [("2017-11-07 09:30:00", 1), ("2017-11-07 09:30:05", 0), ("2017-11-07 10:15:00", 0)])
    out = sessions.session_temporal_features(sessions.sessionize(rows), keys=sessions.CLICK_KEYS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    plain = sessions.session_temporal_features(sessions.sessionize(rows))
    assert sorted(out.columns) == sorted(plain.columns)
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
