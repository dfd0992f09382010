import numpy as np
import pandas as pd

from sessionloom.operators import gram


def test_five_hundred_columns_in_one_pass(spark):
    draw = np.random.RandomState(1)
    base = draw.normal(size=(300, 20))
    x = base @ draw.normal(size=(20, 500)) + 0.2 * draw.normal(size=(300, 500)) + 1e6 * (np.arange(500) % 3)
    x[draw.uniform(size=x.shape) < 0.05] = np.nan
    x[:, 7], x[2:, 9] = 4.0, np.nan
    x[0, 11] = np.inf
    frame = pd.DataFrame(x, columns=[f"v{i}" for i in range(500)])
    out = gram.pair_moments(spark.createDataFrame(frame).repartition(3), list(frame.columns)).toPandas()
    assert len(out) == 500 * 501 // 2
    frame = frame.replace(np.inf, np.nan)
    want_cov, want = frame.cov().to_numpy(), frame.corr().to_numpy()
    a, b = (out[c].str[1:].astype(int).to_numpy() for c in ("feature_a", "feature_b"))
    fine = ~np.isin(a, (7, 9)) & ~np.isin(b, (7, 9))
    assert np.allclose(out["covariance"][fine], want_cov[a, b][fine], rtol=1e-6, atol=1e-6)
    assert np.allclose(out["correlation"][fine], want[a, b][fine], atol=1e-8)
    assert out["correlation"][(a == 7) | (b == 7)].isna().all()
    there = frame.notna().to_numpy().astype(int)
    assert (out["n"].to_numpy() == (there.T @ there)[a, b]).all()


def test_no_rows(spark):
    out = gram.pair_moments(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert all(r["n"] == 0 and r["covariance"] is None for r in out)
