"""Pairwise moments of many columns in one pass: a blocked Gram matrix.

One expression per pair of columns makes a plan that grows with the square of their number. Here a task multiplies its rows as matrices,
values against values and against the marks of what is present, and returns square blocks of sums; blocks of the same place are added by
a shuffle. Pairs are complete by themselves: a row counts for a pair if it has both values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import ship_by_value

ship_by_value(__name__)

#: Columns of a block's side.
SIDE = 128
SUMS = "i int, j int, sums binary"
PAIR = "a int, b int, n long, covariance double, correlation double"


def _summed(batches, columns: list[str], shift: np.ndarray):
    c = len(columns)
    total = np.zeros((6, c, c))
    for batch in batches:
        x = np.stack([np.asarray(batch.column(k).cast(pa.float64()).fill_null(np.nan)) for k in columns], 1).reshape(-1, c)
        there = np.isfinite(x)
        x = np.where(there, x - shift, 0.0)
        m = there.astype(np.float64)
        square = x * x
        for t, (u, v) in enumerate(((m, m), (x, m), (m, x), (square, m), (m, square), (x, x))):
            total[t] += u.T @ v
    rows = [(i, j, np.ascontiguousarray(total[:, i : i + SIDE, j : j + SIDE]).tobytes()) for i in range(0, c, SIDE) for j in range(i, c, SIDE)]
    i, j, sums = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums)], ["i", "j", "sums"])


def _pairs(part: pa.Table, c: int) -> pa.Table:
    """The moments of one block, both orders of a pair once (a before b, or a equal to b)."""
    i, j = part["i"][0].as_py(), part["j"][0].as_py()
    shape = (6, min(SIDE, c - i), min(SIDE, c - j))
    n, sa, sb, qa, qb, p = sum(np.frombuffer(s, np.float64).reshape(shape) for s in part["sums"].to_pylist())
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = (p - sa * sb / n) / (n - 1)
        va, vb = (qa - sa * sa / n) / (n - 1), (qb - sb * sb / n) / (n - 1)
        correlation = covariance / np.sqrt(va * vb)
        # what is left of a constant column's deviation is rounding
        flat = (va <= 1e-14 * qa / n) | (vb <= 1e-14 * qb / n) | (va <= 0) | (vb <= 0)
    a, b = np.meshgrid(np.arange(i, i + shape[1]), np.arange(j, j + shape[2]), indexing="ij")
    use = a <= b
    covariance, correlation = covariance[use], correlation[use]
    few, flat = n[use] < 2, flat[use] | (n[use] < 2)
    columns = [pa.array(a[use], pa.int32()), pa.array(b[use], pa.int32()), pa.array(n[use].astype(np.int64))]
    return pa.table(columns + [pa.array(covariance, mask=few), pa.array(np.clip(correlation, -1, 1), mask=flat)], ["a", "b", "n", "covariance", "correlation"])


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature_a``, ``feature_b``, ``n``, ``covariance`` (n - 1), ``correlation`` of every pair of columns, each with itself too.

    Missing and infinite values are left out pair by pair; fewer than two common rows give no covariance, a column without spread no
    correlation. Columns are shifted by their means first, so large offsets cost no digits.
    """
    numbers = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = numbers.columns
    finite = [F.when((F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c)) for c in names]
    means = numbers.agg(*[F.avg(x).alias(c) for c, x in zip(names, finite)]).first()
    shift = np.array([means[c] or 0.0 for c in names])
    sums = numbers.mapInArrow(lambda b: _summed(b, names, shift), SUMS)
    pairs = sums.groupBy("i", "j").applyInArrow(lambda t: _pairs(t, len(columns)), PAIR)
    name = F.array(*[F.lit(c) for c in columns])
    return pairs.select(name[F.col("a")].alias("feature_a"), name[F.col("b")].alias("feature_b"), "n", "covariance", "correlation")
