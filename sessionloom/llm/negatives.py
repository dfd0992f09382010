"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. The members of a cluster lie within an angle b of its centre, so a row x at angle t from the centre scores at most
|a| * |x| * cos(max(0, t - b)) with a member a. Rows are sorted by that bound once per cluster; every member walks the list
from the top and leaves when the bound of the next row is below what it still needs, which is certified, not guessed: results are exact.

Rows are dealt into blocks and anchors into chunks by hash, and a task holds one block and one chunk. A first walk finds each anchor's nearest rows of
its own label, a second one the rows of other labels inside each positive's window. Tasks return
a few rows per anchor; block and chunk sizes grow with the square root of the table, so both sides are copied about equally often.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.session import materialise, ship_by_value

ship_by_value(__name__)

#: Positives of an anchor, and negatives of a positive.
POSITIVES = 5
NEGATIVES = 5
#: Anchors the centres are fitted on, at most.
SAMPLE = 4096
MOST_CENTRES = 1024
#: Rows of a list that are scored at once.
STRIDE = 1024


def _quantised(batches):
    for batch in batches:
        rows = []
        for at, cell in enumerate(batch.column("vector")):
            values = cell.values if cell.is_valid else None
            if values is None or values.null_count:
                continue
            x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                q = np.floor(256 * x)
            top = float(np.abs(q).max()) if len(q) else 0.0
            if top >= 1 << 31 or top * top * len(q) >= 1 << 62:  # its scores would not fit 64 bits
                continue
            rows.append((at, len(q), q.astype(np.int16 if top < 1 << 15 else np.int32).tobytes(), math.sqrt(float(q @ q)), int(top)))
        at, dim, q, norm, top = zip(*rows) if rows else ((), (), (), (), ())
        kept = batch.select(["vec_id", "label"]).take(pa.array(at, pa.int32()))
        made = [pa.array(dim, pa.int32()), pa.array(q, pa.binary()), pa.array(norm, pa.float64()), pa.array(top, pa.int64())]
        yield pa.RecordBatch.from_arrays([*kept.columns, *made], ["vec_id", "label", "dim", "q", "norm", "top"])


def _matrix(q: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.int32) for v in q]).astype(np.float64).reshape(len(q), dim)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Directions of k clusters of the rows of x."""
    x = _units(x)
    held = x[np.random.RandomState(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ held.T).argmax(1)
        held = _units(np.stack([x[own == c].sum(0) if (own == c).any() else held[c] for c in range(len(held))]))
    return held


def _assigned(batches, held):
    for batch in batches:
        dims, q = np.asarray(batch.column("dim")), batch.column("q").to_pylist()
        cluster = np.zeros(len(dims), dtype=np.int32)
        for dim in set(dims.tolist()) & set(held):
            at = np.flatnonzero(dims == dim)
            cluster[at] = (_units(_matrix([q[i] for i in at], dim)) @ held[dim].T).argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cluster)], ["row", "cluster"])


def _first(member, score, name, row, k: int):
    """The k first entries of each member: higher scores, then smaller ids, then rows."""
    order = np.lexsort((row, name, -score, member))
    member = member[order]
    place = np.arange(len(member)) - np.searchsorted(member, member)
    return order[place < k]


class _Best:
    """The k best rows per member found so far, inside [low, high]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.found = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, members, scores, usable, names, rows):
        m, at = np.nonzero(usable & (scores >= self.low[members, None]) & (scores <= self.high[members, None]))
        if not len(m):
            return
        new = [members[m], scores[m, at].astype(np.int64), names[at], rows[at]]
        all_ = [np.concatenate(c) for c in zip(self.found, new)]
        keep = _first(*all_, self.k)
        self.found = [c[keep] for c in all_]
        full = np.bincount(self.found[0], minlength=len(self.low)) >= self.k
        last = np.searchsorted(self.found[0], np.flatnonzero(full), "right") - 1
        self.low[full] = np.maximum(self.low[full], self.found[1][last])


def _walk(anchors: pa.Table, rows: pa.Table, negative: bool):
    """Best rows of one block for the anchors of one chunk: anchor, place of the positive, score, id and row."""
    out = []
    dims = np.asarray(rows["dim"])
    shape = np.stack([np.asarray(anchors["dim"]), np.asarray(anchors["cluster"])], 1)
    for dim, cluster in sorted(set(map(tuple, shape.tolist()))):
        at = np.flatnonzero(dims == dim)
        if not len(at):
            continue
        group = anchors.filter(pa.array((shape == [dim, cluster]).all(1)))
        block = rows.take(pa.array(at))
        q, x = (_matrix(t["q"].to_pylist(), dim) for t in (group, block))
        norm, length = np.asarray(group["norm"]), np.asarray(block["norm"])
        centre = _units(_units(q).sum(0, keepdims=True))
        spread = np.arccos(np.clip(_units(q) @ centre.T, -1, 1)).max()
        angle = np.arccos(np.clip(_units(x) @ centre.T, -1, 1)).ravel()
        bound = length * (np.cos(np.maximum(0, angle - spread)) + 1e-6)
        order = np.argsort(-bound, kind="stable")
        x, bound, block = x[order], bound[order], block.take(pa.array(order))
        if int(max(np.asarray(group["top"]))) * int(max(np.asarray(block["top"]))) * max(1, dim) >= 1 << 53:
            q, x = q.astype(np.int64), x.astype(np.int64)
        ids, names, labels = (np.asarray(block[c]) for c in ("row", "vec_id", "label"))
        own, mine = np.asarray(group["row"]), np.asarray(group["label"])
        m = len(own)
        if negative:
            # scores of positives per anchor; windows of missing and negative positives are empty
            p = np.full((m, POSITIVES), -1, dtype=np.int64)
            for i, scores in enumerate(group["positives"].to_pylist()):
                p[i, : len(scores)] = scores
            goals = [_Best(np.where(p[:, j] >= 0, -(-4 * p[:, j] // 5), 1), np.where(p[:, j] >= 0, p[:, j], 0), NEGATIVES) for j in range(POSITIVES)]
        else:
            limit = np.iinfo(np.int64)
            goals = [_Best(np.full(m, limit.min), np.full(m, limit.max), POSITIVES)]
        active = np.arange(m)
        for start in range(0, len(x), STRIDE):
            # a goal that is still open needs rows of at least its lower limit
            need = np.min([np.where(g.low <= g.high, g.low, np.iinfo(np.int64).max) for g in goals], axis=0)
            active = active[norm[active] * bound[start] + 1 >= need[active]]
            if not len(active):
                break
            end = start + STRIDE
            scores = q[active] @ x[start:end].T
            if scores.dtype != np.int64:
                scores = scores.astype(np.int64)
            alike = mine[active, None] == labels[None, start:end]
            usable = ~alike if negative else alike & (own[active, None] != ids[None, start:end])
            for g in goals:
                if not negative and scores.shape[1] > POSITIVES:
                    # at first every row is above the limit: only each member's own best of this stretch can count
                    held = np.where(usable, scores, np.iinfo(np.int64).min)
                    least = np.partition(held, -POSITIVES, axis=1)[:, -POSITIVES]
                    g.add(active, scores, usable & (scores >= least[:, None]), names[start:end], ids[start:end])
                else:
                    g.add(active, scores, usable, names[start:end], ids[start:end])
        for j, g in enumerate(goals):
            member, score, name, row = g.found
            if len(member):
                out.append((own[member], np.full(len(member), j, np.int32), score, name, row))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3]
    return pa.table([pa.array(c) for c in columns], ["anchor", "place", "score", "vec_id", "row"])


FOUND = "anchor long, place int, score long, vec_id long, row long"


def hard_negatives(df: DataFrame, every: int = 100) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` (columns ``vec_id``, ``embedding``, ``label`` of ``df``).

    Anchors are the rows whose id is divisible by ``every``. Rows with a null id, label or vector, or a null or non-finite component take no part,
    nor do rows whose scores would not fit 64 bits. Vectors of different lengths are not compared. Rows that share an id are rows
    of their own; equal scores of equal ids follow the order of reading. An anchor without positives, and a positive without rows in its window, give no rows; nor
    does an empty table. Other columns are ignored.
    """
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    given = df.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    given = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    made = given.mapInArrow(_quantised, "vec_id long, label long, dim int, q binary, norm double, top long")
    # the written table fixes the row numbers that stand for its rows from here on
    rows = materialise(made.withColumn("row", F.monotonically_increasing_id()), "negative-rows")
    chosen = rows.where(F.col("vec_id") % every == 0)
    n, anchors = rows.count(), chosen.count()
    side = max(1, 16 * math.isqrt(n))
    blocks, k = max(1, -(-n // side)), min(MOST_CENTRES, max(1, math.isqrt(anchors) // 2))
    sample = chosen.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "q").collect()
    by_dim: dict[int, list[bytes]] = {}
    for dim, q in sample:
        by_dim.setdefault(dim, []).append(bytes(q))
    held = {dim: centres(_matrix(q, dim), k) for dim, q in by_dim.items()}
    dealt = chosen.select("row", "dim", "q").mapInArrow(lambda b: _assigned(b, held), "row long, cluster int")
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("members"))
    cell = F.pmod(F.xxhash64("row"), F.ceil(F.col("members") / side))
    chunk = F.pmod(F.xxhash64("cluster", cell), F.lit(max(1, -(-anchors // side)))).cast("int")
    members = materialise(chosen.join(dealt.join(sizes, "cluster"), "row").select("row", "vec_id", "label", "dim", "q", "norm", "top", "cluster", chunk.alias("chunk")), "negative-anchors")
    chunks = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-anchors // side)) - 1)))
    listed = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), chunks.alias("chunk"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def walked(asked: DataFrame, negative: bool) -> DataFrame:
        left = asked.select("*", every_block.alias("block")).groupBy("block", "chunk")
        found = left.cogroup(listed.groupBy("block", "chunk")).applyInArrow(lambda a, b: _walk(a, b, negative), FOUND)
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (NEGATIVES if negative else POSITIVES))

    near = materialise(walked(members, False), "negative-positives")
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))
    asked = members.join(scores.select(F.col("anchor").alias("row"), F.col("found.score").alias("positives")), "row")
    hard = walked(asked, True)
    named = near.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = members.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "place"])
    return out.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_shared_list_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth embedding."""
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))
