"""Isolation-forest anomaly scores (Liu, Ting, Zhou 2008).

Python runs in two places: one worker call per tree on at most 256 sampled rows, and
vectorised scoring of Arrow batches. Everything else is plan expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions import columns as C
from sessionloom.plans.cuts import quantiles
from sessionloom.session import ship_by_value

ship_by_value(__name__)

NODE_SCHEMA = "tree int, node int, feature int, split double, size int"


def average_path(n):
    """Expected unsuccessful-search depth of a binary tree over n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int]]:
    """(node, feature, split, size) of one tree; children of node i are 2i+1 and 2i+2, feature -1 is a leaf."""
    nodes, stack = [], [(0, rows, 0)]
    while stack:
        node, part, depth = stack.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, len(part)))
            continue
        feature = int(rng.choice(spread))
        split = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        nodes.append((node, feature, split, len(part)))
        left = part[:, feature] <= split
        stack += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]
    return nodes


def fit_forest(df: DataFrame, features: list[str], key: str = "session_id", trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Trees as rows. Each tree takes the ``sample`` rows with the smallest hash of (key, tree).

    Candidates are first thinned to about four samples per tree by one hash, so the work of
    pairing rows with trees does not grow with the table.
    """
    n = df.count()
    share = min(1.0, 4.0 * trees * sample / max(n, 1))
    rows = df.select(F.col(key).cast("string").alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    thin = rows.filter(C.uniform(F.col("k"), "candidate") < share)
    # a candidate serves as many neighbouring trees, from one its hash picks, as give every tree four samples
    width = min(trees, math.ceil(4.0 * trees * sample / max(n * share, 1)))
    first = F.pmod(F.xxhash64("k"), F.lit(trees))
    tree_ids = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: ((first + j) % trees).cast("int"))
    paired = thin.select("k", "x", F.explode(tree_ids).alias("tree"))
    order = W.partitionBy("tree").orderBy(F.xxhash64("k", "tree"), "k")
    drawn = paired.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample)
    limit = math.ceil(math.log2(max(min(sample, n), 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = np.vstack(pdf.sort_values("rn")["x"].to_numpy())
        nodes = grow_tree(data, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *t) for t in nodes], columns=["tree", "node", "feature", "split", "size"])

    return drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def isolation_scores(df: DataFrame, features: list[str], forest: DataFrame, sample: int, name: str = "raw_score") -> DataFrame:
    """2^(-mean path / c(sample)) per row; the node table (trees x at most 511 rows) rides in the closure."""
    table = forest.toPandas()
    trees = sorted(table["tree"].unique())
    width = int(table["node"].max()) + 1
    feature = np.full((len(trees), width), -1, dtype=np.int32)
    split = np.zeros((len(trees), width))
    size = np.ones((len(trees), width))
    for i, t in enumerate(trees):
        part = table[table["tree"] == t]
        feature[i, part["node"]] = part["feature"]
        split[i, part["node"]] = part["split"]
        size[i, part["node"]] = part["size"]
    norm = float(average_path(sample)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        data = np.vstack(x.to_numpy())
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for i in range(len(trees)):
            node = np.zeros(len(data), dtype=np.int64)
            depth = np.zeros(len(data))
            while True:
                f = feature[i, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = data[rows, np.maximum(f, 0)] > split[i, node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            total += depth + average_path(size[i, node])
        return pd.Series(np.power(2.0, -total / len(trees) / norm))

    return df.withColumn(name, score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])))


def detect_anomalies(
    df: DataFrame, features: list[str], key: str = "session_id", contamination: float = 0.03,
    trees: int = 100, sample: int = 256, exact: bool = True,
) -> DataFrame:
    """Add anomaly_score = raw score minus its (1 - contamination) quantile; above 0 is an outlier."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    size = min(sample, df.count())
    forest = fit_forest(filled, features, key, trees, size)
    scored = isolation_scores(df, features, forest, size)
    offset = quantiles(scored, ["raw_score"], [1.0 - contamination], exact=exact)["raw_score"][0]
    return scored.withColumn("anomaly_score", F.col("raw_score") - F.lit(offset)).drop("raw_score")


def anomaly_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("anomaly_score") > 0).alias("outlier_count"),
        F.min("anomaly_score").alias("anomaly_score_min"),
        F.avg("anomaly_score").alias("anomaly_score_mean"),
        F.max("anomaly_score").alias("anomaly_score_max"),
    )
