"""Order statistics, ranks and hash samples against brute force, on skewed data."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import motion, ranks, sampling
from sessionloom.plans import chunks, cuts


def skewed(n=4000, seed=11):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.35, 60.0, rng.lognormal(3, 2, n))
    return pd.DataFrame({"id": [f"r{i:05d}" for i in range(n)], "x": x, "z": rng.integers(0, 3, n).astype(float), "label": rng.integers(0, 2, n)})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    return spark.createDataFrame(pdf), pdf


PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.97, 1.0]


@pytest.mark.parametrize("limit", [40, 10**6])
def test_order_statistics_with_and_without_narrowing(frame, limit):
    df, pdf = frame
    n = len(pdf)
    targets = [0, 1, n // 10, n // 3, n // 2, n - 2, n - 1]
    found, sizes = cuts.order_statistics(cuts.to_long(df, ["x", "z"]), rank_of=lambda _: targets, limit=limit)
    for c in ("x", "z"):
        ordered = np.sort(pdf[c])
        g = f"\t{c}" if f"\t{c}" in sizes else c
        assert sizes[g] == n
        for r in targets:
            value, below, same = found[(g, r)]
            assert value == ordered[r]
            assert below == int((pdf[c] < value).sum()) and same == int((pdf[c] == value).sum())


def test_quantiles_equal_linear_interpolation(frame):
    df, pdf = frame
    got = cuts.quantiles(df, ["x", "z"], PROBS)
    for c in ("x", "z"):
        np.testing.assert_allclose(got[c], pdf[c].quantile(PROBS))
    by = cuts.quantiles(df, ["x"], PROBS, by="label")
    for g, part in pdf.groupby("label"):
        np.testing.assert_allclose(by[str(g)]["x"], part["x"].quantile(PROBS))
    assert cuts.quantiles(df.withColumn("empty", F.lit(None).cast("double")), ["empty"], [0.5]) == {"empty": [None]}


def test_quantiles_with_infinite_and_missing_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf,), (1.0,), (2.0,), (-inf,), (None,), (float("nan"),)], "x double")
    found, sizes = cuts.order_statistics(cuts.to_long(df, ["x"]), rank_of=lambda n: range(n))
    assert list(sizes.values()) == [4]
    assert [found[(g, r)][0] for g in sizes for r in range(4)] == [-inf, 1.0, 2.0, inf]


def hashed(ids):
    import hashlib

    return [int(hashlib.sha256(i.encode()).hexdigest()[:12], 16) / 16**12 for i in ids]


def brute_rank(pdf, column, descending=False):
    sign = -1 if descending else 1
    order = sorted(range(len(pdf)), key=lambda i: (sign * pdf[column].iloc[i], h[i], pdf["id"].iloc[i])) if (h := hashed(pdf["id"])) else []
    rank = np.empty(len(pdf), dtype=int)
    rank[order] = np.arange(1, len(pdf) + 1)
    return dict(zip(pdf["id"], rank))


def test_global_rank_under_ties(frame):
    df, pdf = frame
    for column, descending in (("x", True), ("z", False)):
        got = {r["id"]: r["rank"] for r in ranks.ranked(df, column, "id", descending).select("id", "rank").collect()}
        assert got == brute_rank(pdf, column, descending)


def test_strata_match_rank_formulas(frame):
    df, pdf = frame
    n = len(pdf)
    rank = brute_rank(pdf, "x")
    got = ranks.decile_strata(df, {"x": "d"}, "id").collect()
    assert all(r["d"] == int(np.rint(10 * rank[r["id"]] / n)) for r in got)
    got = ranks.frequency_strata(df, {"x": "b"}, "id").collect()
    assert all(r["b"] == max(1, -(-(rank[r["id"]] - 1) * 5 // (n - 1))) for r in got)
    three = brute_rank(pdf, "z")
    got = ranks.frequency_strata(df, {"z": "b"}, "id").collect()
    assert all(r["b"] == max(1, -(-(three[r["id"]] - 1) * 3 // (n - 1))) for r in got)


def test_average_rank(frame):
    df, pdf = frame
    got = ranks.average_rank(df, "x", "r").select("id", "r").toPandas().set_index("id")["r"]
    want = pdf.set_index("id")["x"].rank()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("buckets", [1, 8, 16384])
def test_take_by_hash_is_exact_and_partition_free(spark, frame, partitions, buckets):
    df, pdf = frame
    quota = spark.createDataFrame([(0, 137), (1, 5000)], "label long, take long")
    got = cuts.flag_by_hash(df.repartition(partitions), ["label"], quota, "id", "t", buckets=buckets).collect()
    assert len(got) == len(pdf)
    taken = {r["id"] for r in got if r["taken"]}
    pdf = pdf.assign(h=hashed(pdf["id"] + "|t"))
    zero = set(pdf[pdf["label"] == 0].sort_values(["h", "id"])["id"][:137])
    assert taken == zero | set(pdf[pdf["label"] == 1]["id"])


def test_largest_remainder_sums_and_stays_near(frame):
    df, pdf = frame
    got = motion.largest_remainder(df, "x", 12_345, "id").toPandas()
    assert got["share"].sum() == 12_345
    exact = got["x"] / got["x"].sum() * 12_345
    assert (np.abs(got["share"] - exact) < 1).all()


def test_id_ordinals(spark):
    ids = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids], "session_id string")
    got = {r["session_id"]: r["_ordinal"] for r in motion.id_ordinals(df).collect()}
    assert got == {k: i for i, k in enumerate(sorted(ids))}


def sessions_like(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "session_id": [f"s{i}" for i in range(n)],
            "label": np.where(rng.random(n) < 0.8, 1, 0),
            "data_source": "clicks",
            "is_proxy": rng.integers(0, 2, n),
            "requests_per_minute": np.where(rng.random(n) < 0.5, 60.0, rng.random(n) * 100),
            "session_duration_sec": 1 + rng.random(n) * 50,
            "coordinate_entropy": rng.random(n) * 3,
            "click_count": rng.integers(1, 9, n),
        }
    )
    return spark.createDataFrame(pdf), pdf


def test_samples_hit_their_targets(spark):
    df, pdf = sessions_like(spark)
    sample = sampling.stratified_sample(df, {0: 10_000, 1: 300}).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in sample} == {0: int((pdf.label == 0).sum()), 1: 300}
    balanced = sampling.downsample_majority(df)
    counts = {r["label"]: r["count"] for r in balanced.groupBy("label").count().collect()}
    assert counts[0] == counts[1] == int((pdf.label == 0).sum())
    assert balanced.select("session_id").distinct().count() == balanced.count()
    split = sampling.stratified_split(df).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in split}[True] == -(-len(pdf) // 5)


def test_bootstrap_invariants(spark):
    df, pdf = sessions_like(spark)
    humans = df.filter("label = 0")
    n = int((pdf.label == 0).sum())
    grown = sampling.bootstrap_class(humans, n + 57)
    rows = grown.filter("data_source = 'synthetic_human'").collect()
    assert grown.count() == n + 57 and len(rows) == 57
    assert all(r["click_count"] >= 2 and r["total_requests"] >= r["click_count"] for r in rows)
    assert all(r["session_duration_sec"] >= 1 and 0 <= r["success_rate"] <= 1 for r in rows)
    assert all(r["requests_per_minute"] == pytest.approx(r["total_requests"] / (r["session_duration_sec"] / 60)) for r in rows)
    assert sampling.bootstrap_class(humans, n).count() == n
    with pytest.raises(ValueError):
        sampling.bootstrap_class(humans.filter("label = 9"), 10)
    again = sampling.bootstrap_class(humans.repartition(5), n + 57)
    assert sorted(r["coordinate_entropy"] for r in again.collect()) == pytest.approx(sorted(r["coordinate_entropy"] for r in grown.collect()))


def test_order_statistics_end_with_infinite_values(spark):
    values = [float("inf")] * 60 + [float("-inf")] * 15 + [float(i) for i in range(25)]
    long = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    found, sizes = cuts.order_statistics(long, ranks={"g": [0, 14, 15, 30, 39, 40, 80, 99]}, limit=10)
    ordered = sorted(values)
    assert sizes == {"g": 100}
    for rank in (0, 14, 15, 30, 39, 40, 80, 99):
        value = ordered[rank]
        assert found[("g", rank)] == (value, ordered.index(value), ordered.count(value))


def test_rank_cuts_count_repeated_keys(spark):
    base = spark.createDataFrame([("g", 1.0, "same")] * 40 + [("g", 1.0, f"k{i}") for i in range(10)], "g string, v double, k string")
    triples = cuts.rank_cuts(base, ranks={"g": list(range(1, 51))})["g"]
    keys = [k for _, _, k in triples]
    assert keys.count("same") == 40 and len(set(keys)) == 11


def test_every_row_is_ranked(spark):
    rows = [("a", 3.0), ("b", None), ("c", float("nan")), ("d", 1.0), ("e", float("inf")), ("f", float("-inf")), ("g", 3.0)]
    df = spark.createDataFrame(rows, "id string, v double")
    up = {r["id"]: r["rank"] for r in chunks.ranked(df, "v", "id").collect()}
    down = {r["id"]: r["rank"] for r in chunks.ranked(df, "v", "id", descending=True).collect()}
    assert sorted(up.values()) == sorted(down.values()) == list(range(1, 8))
    assert (up["f"], up["d"], up["e"]) == (1, 2, 5) and {up["b"], up["c"]} == {6, 7} and {up["a"], up["g"]} == {3, 4}
    assert (down["e"], down["d"], down["f"]) == (1, 4, 5) and {down["b"], down["c"]} == {6, 7}


def test_sessions_match_by_movements_then_requests(spark):
    rows = [("a", 5, 2**26 + 50), ("b", 5, 2**26 + 5), ("c", 5, 1), ("d", 2**40, 0), ("e", None, 7)]
    sessions = spark.createDataFrame(rows, "session_id string, total_movements long, total_requests long")
    segments = spark.createDataFrame([(f"s{i}",) for i in range(5) for _ in range(5 - i)], "session_id string")
    got = {r["segment_id"]: r["session_id"] for r in motion.rank_matched_ids(segments, sessions).collect()}
    assert got == {"s0": "d", "s1": "a", "s2": "b", "s3": "c", "s4": "e"}


def test_cell_counts_of_many_edges(spark):
    """Counts per open cell and edge against plain counting; the edges reach tasks as arrays, without a pass over them per row."""
    draw = np.random.RandomState(3)
    values = {g: np.concatenate([draw.randint(-40, 40, 500) / 4.0, [-0.0, 0.0]]) for g in ("a", "b\tx")}
    long = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("other", 1.0)], "g string, v double")
    edges = {"a": [-3.0, 0.0, 2.25], "b\tx": list(np.arange(-10, 10, 0.25))}
    cells = [(g, lo, hi) for g, e in edges.items() for lo, hi in zip([-np.inf, *e], [*e, np.inf])]
    got = cuts._cell_counts(spark, long, cells)
    for g, e in edges.items():
        want = []
        for lo, hi in zip([-np.inf, *e], [*e, np.inf]):
            want.append(("cell", lo, hi, int(((values[g] > lo) & (values[g] < hi)).sum())))
            if hi < np.inf:
                want.append(("point", hi, hi, int((values[g] == hi).sum())))
        assert got[g] == want
    batch = pa.RecordBatch.from_pydict({"g": ["a", "a", "other"], "v": [2.25, 9.0, 1.0]})
    assert [r.to_pydict() for r in cuts._placed([batch], {"a": np.array([0.0, 2.25])})] == [{"g": ["a", "a"], "slot": [3, 4], "n": [1, 1]}]
