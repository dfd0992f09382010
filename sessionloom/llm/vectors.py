"""Embedding near-duplicates by p-stable hashing, checked by exact cosines.

Unit vectors are projected on Gaussian directions, shifted and cut into steps of ``STEP``; ``K`` steps make a bucket of a table, and
there are enough tables that a pair at the threshold shares a bucket with probability ``RECALL``. K grows with the
logarithm of the number of vectors, so chance neighbours per vector stay few at any size. Buckets are checked in blocks of
bounded size; a pair is counted in the first table it meets in, and a block returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.graph import components
from sessionloom.session import materialise, ship_by_value

ship_by_value(__name__)

STEP = 2.0
RECALL = 0.98
#: Chance neighbours per vector and table.
CHANCE = 1 / 16
#: Vectors of one side of a block.
BLOCK = 512


def meeting(distance: float, step: float = STEP) -> float:
    """Probability that two vectors at a Euclidean distance fall into the same step of one projection."""
    r = step / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Steps per bucket and number of tables for n vectors."""
    near, far = meeting(math.sqrt(2 - 2 * cosine)), meeting(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2, n) / CHANCE) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def _units(batches):
    for batch in batches:
        units, dims = [], []
        for row in batch.column("vector"):
            values = row.values if row.is_valid else None
            x = None if values is None or values.null_count else np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
                units.append(None)
                dims.append(0)
                continue
            x = x / top
            units.append((x / np.sqrt((x * x).sum())).tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "dim", "unit"])


def _buckets(batches, k, tables, seed):
    made = {}
    for batch in batches:
        dims, units = np.asarray(batch.column("dim")), batch.column("unit").to_pylist()
        keys = np.zeros((len(units), tables), dtype=np.int64)
        for dim in np.unique(dims).tolist():
            if dim not in made:
                draw = np.random.RandomState(seed + dim)
                weight = draw.randint(-(1 << 62), 1 << 62, (k, tables), dtype=np.int64) | 1
                made = {dim: (draw.normal(size=(dim, k * tables)), draw.uniform(0, STEP, k * tables), weight, draw.randint(0, 1 << 62, tables, dtype=np.int64))}
            directions, shift, weight, start = made[dim]
            for at in np.array_split(np.flatnonzero(dims == dim), max(1, (dims == dim).sum() // 1000)):
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), dim)
                steps = np.floor((x @ directions + shift) / STEP).astype(np.int64).reshape(len(at), k, tables)
                keys[at] = (steps * weight).sum(1) + start
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))], ["row", "keys"]
        )


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component in a small graph."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new[label]


def _checked(block: pa.Table, cosine: float):
    """Counts and forest of one block (members of two sides i and j of a bucket, or of one side)."""
    row, side = np.asarray(block["row"]), np.asarray(block["side"])
    i, j, table = (block[c][0].as_py() for c in ("i", "j", "place"))
    dim = block["dim"][0].as_py()
    units = np.frombuffer(b"".join(block["unit"].to_pylist()), np.float64).reshape(len(row), dim)
    order = np.argsort(row, kind="stable")
    row, side, units = row[order], side[order], units[order]
    a, b = np.nonzero(np.triu(units @ units.T >= cosine, 1))
    if i != j:
        cross = side[a] != side[b]
        a, b = a[cross], b[cross]
    if not len(a):
        return None
    keys = np.array(block["keys"].combine_chunks().flatten() if table else [0] * len(row)).reshape(len(row), -1)[order]
    root = _forest(len(row), a, b)
    for t in range(table):
        fresh = keys[a, t] != keys[b, t]
        a, b = a[fresh], b[fresh]
    links = np.bincount(a, minlength=len(row)) + np.bincount(b, minlength=len(row))
    out = np.flatnonzero((links > 0) | (root != np.arange(len(row))))
    return row[out], links[out], row[root[out]]


def _blocks(batches, cosine):
    """Sorted rows, one block after another; a block's rows are held together, BLOCK of a side on average."""
    held = None

    def done(table):
        return _checked(table, cosine)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key, i, j = (np.asarray(held[c]) for c in ("key", "i", "j"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = [done(held.slice(a, b - a)) for a, b in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist())] if len(cuts) else []
        held = held.slice(int(cuts[-1])).combine_chunks() if len(cuts) else held
        found = [f for f in found if f]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["row", "links", "root"])
    if held is not None and held.num_rows and (last := done(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["row", "links", "root"])


def near_vectors(df: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """One row per row of ``df`` (``vec_id``, ``embedding``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing and are their own component; so do
    vectors of different lengths among each other. Repeated rows are vectors of their own and link. A null vec_id takes part, is never the
    smallest id, and is not kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    units = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).mapInArrow(
        _units, "vec_id long, dim int, unit binary"
    )
    # The written table fixes the row numbers that stand for its rows from here on.
    vectors = materialise(units.withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = vectors.where("unit IS NOT NULL")
    k, tables = plan(good.count(), cosine)
    keys = materialise(good.select("row", "dim", "unit").mapInArrow(lambda b: _buckets(b, k, tables, seed), "row long, keys array<long>"), "vector-keys")
    members = keys.select("row", F.posexplode("keys").alias("place", "key"))
    full = materialise(members.groupBy("place", "key").agg(F.count("*").alias("size")).where("size > 1"), "vector-buckets")
    sides = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("row"), sides).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    dealt = (
        members.join(full, ["place", "key"])
        .select("row", "place", "key", sides.alias("sides"), side.alias("side"))
        .select("row", "place", "key", "side", other.alias("other"))
        .select("row", "place", "key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    block = dealt.join(good.select("row", "dim", "unit"), "row").join(keys, "row").select("key", "i", "j", "place", "row", "side", "dim", "unit", "keys")
    dealt_out = block.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialise(dealt_out.mapInArrow(lambda b: _blocks(b, cosine), "row long, links long, root long"), "vector-links")
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("row"), "label")
    named = materialise(
        vectors.select("row", "vec_id").join(links, "row", "left").join(labels, "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "row").alias("label")),
        "vector-named",
    )
    least = materialise(named.groupBy("label").agg(F.min("vec_id").alias("component_id")), "vector-components")
    return named.join(least, "label").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op8_stable_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
