"""Approximate nearest neighbours by robust-pruned directed graphs, one graph per shard.

A shard is a random part of the distinct vectors. Its graph starts at one node and takes the others in batches that double: a greedy
beam search for the new node proposes neighbours, and of these, nearest first, one is kept if no neighbour kept before is ``ALPHA`` times
nearer to it than the node is; edges back are added and pruned in the same way. A second round over the first half of the nodes
improves the edges of the early, small graph. Queries are beam searches in every shard; their best rows are merged.

Largest inner products become nearest points by one more coordinate, sqrt(M^2 - |x|^2) for rows (M: largest norm) and 0 for queries.
Equal vectors are one node that carries its smallest ids, as many as a result can hold. Searches of a batch are one set of numpy
operations. Nodes of a shard grow with the square root of their number, so that building (rows) and searching (queries times shards) stay in step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.session import materialise, ship_by_value

ship_by_value(__name__)

DEGREE = 24
ALPHA = 1.2
#: Nodes a search keeps while building, and while answering.
BUILD_BEAM = 40
SEARCH_BEAM = 64
#: Beam nodes whose edges are followed at once.
STEP = 4
#: Searches that run together.
TOGETHER = 256
#: Nodes of a shard: this times the square root of all, 2**18 at most.
SHARD = 16
MOST_NODES = 1 << 18


def _valid(batches):
    for batch in batches:
        at, units, dims, norms = [], [], [], []
        for i, cell in enumerate(batch.column("vector")):
            values = cell.values if cell.is_valid else None
            if values is None or values.null_count or not len(values):
                continue
            x = np.asarray(values.to_numpy(zero_copy_only=False))
            if not np.isfinite(x).all() or not (top := np.abs(x).max()):
                continue
            at.append(i)
            units.append(x.tobytes())
            dims.append(len(x))
            wide = x.astype(np.float64) / float(top)
            norms.append(math.sqrt(float(wide @ wide)) * float(top))
        made = [pa.array(units, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at, pa.int64())), *made], ["vec_id", "vector", "dim", "norm"])


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    width = len(vectors[0]) // dim
    return np.frombuffer(b"".join(vectors), np.float32 if width == 4 else np.float64).reshape(len(vectors), dim).astype(np.float64)


def lifted(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Points whose distances order the inner products of queries and rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        if query:
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            more = np.zeros((len(x), 1))
        else:
            x = x / largest
            more = np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
    return np.concatenate([x, more], 1).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes met from ``start`` (-1 where fewer were met) and their squared distances, nearest first."""
    n, size = len(queries), points.shape[1]
    ids = np.full((n, beam), -1, dtype=np.int64)
    far = np.full((n, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((n, beam), dtype=bool)
    ids[:, 0], far[:, 0], open_[:, 0] = start, ((queries - points[start]) ** 2).sum(1), True
    active = np.arange(n)
    while len(active):
        a_ids, a_far, a_open = ids[active], far[active], open_[active]
        rank = np.where(a_open, np.arange(beam), beam)
        pick = np.sort(rank, 1)[:, :STEP]
        chosen = pick < beam
        place = np.minimum(pick, beam - 1)
        nodes = np.where(chosen, np.take_along_axis(a_ids, place, 1), -1)
        line = np.broadcast_to(np.arange(len(active))[:, None], pick.shape)[chosen]
        a_open[line, place[chosen]] = False
        near = np.where((nodes >= 0)[:, :, None], graph[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        # one of each neighbour, and none that the beam holds
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        row, col = np.nonzero(near >= 0)
        found = near[row, col]
        known = (a_ids[row] == found[:, None]).any(1)
        row, col, found = row[~known], col[~known], found[~known]
        d = np.full(near.shape, np.inf, dtype=np.float32)
        gap = points[found] - queries[active[row]]
        d[row, col] = np.einsum("ij,ij->i", gap, gap)
        every_far, every_id = np.concatenate([a_far, d], 1), np.concatenate([a_ids, near], 1)
        every_open = np.concatenate([a_open, np.isfinite(d)], 1)
        order = np.argpartition(every_far, beam - 1, axis=1)[:, :beam] if every_far.shape[1] > beam else np.arange(beam)[None].repeat(len(active), 0)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(every_far, order, 1), 1, kind="stable"), 1)
        far[active], ids[active], open_[active] = (np.take_along_axis(v, order, 1) for v in (every_far, every_id, every_open))
        ids[active] = np.where(np.isfinite(far[active]), ids[active], -1)
        active = active[(open_[active] & (ids[active] >= 0)).any(1)]
    return ids, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse edges for each node out of its candidates (rows of ``ids``, -1: none): ``degree`` columns, -1 where there are fewer."""
    ids = np.sort(np.where(ids == nodes[:, None], -1, ids), 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    own = points[np.maximum(ids, 0)]
    gap = own - points[nodes][:, None, :]
    far = np.where(ids >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    order = np.argsort(far, 1, kind="stable")
    ids, far, own = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(own, order[:, :, None], 1)
    squares = np.einsum("ijk,ijk->ij", own, own)
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    live = np.isfinite(far)
    line = np.arange(len(nodes))
    for j in range(degree):
        some = live.any(1)
        if not some.any():
            break
        first = live.argmax(1)
        out[:, j] = np.where(some, ids[line, first], -1)
        kept = own[line, first]
        between = squares + squares[line, first][:, None] - 2 * np.einsum("ijk,ik->ij", own, kept)
        live &= ~(alpha * alpha * np.maximum(between, 0) <= far)
        live[line, first] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Out-edges of every node (-1: none) and the node that searches start from.

    A list of edges back may grow to 5/3 of the degree before it is pruned, which saves pruning it at every new edge.
    """
    n, width = len(points), degree * 5 // 3
    graph = np.full((n, width), -1, dtype=np.int64)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[start], np.delete(np.arange(n), start)])

    def pruned(nodes, ids):
        graph[nodes] = -1
        graph[nodes, :degree] = robust_prune(points, nodes, ids, degree, alpha)

    def insert(nodes):
        met, _ = beam_search(points, graph, start, points[nodes], beam)
        pruned(nodes, np.concatenate([met, graph[nodes]], 1))
        sources, targets = np.repeat(nodes, width), graph[nodes].ravel()
        new = targets >= 0
        new[new] = ~(graph[targets[new]] == sources[new][:, None]).any(1)
        sources, targets = sources[new], targets[new]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        held, first, counts = np.unique(targets, return_index=True, return_counts=True)
        have = (graph[held] >= 0).sum(1)
        fits = np.repeat(have + counts <= width, counts)
        place = np.repeat(have - first, counts) + np.arange(len(targets))
        graph[targets[fits], place[fits]] = sources[fits]
        # nodes with similar numbers of new edges are pruned together, so that one hub does not widen every row
        over = np.flatnonzero(have + counts > width)
        over = over[np.argsort(counts[over], kind="stable")]
        for some in np.array_split(over, -(-len(over) // TOGETHER)) if len(over) else []:
            more = np.full((len(some), int(counts[some].max())), -1, dtype=np.int64)
            inside = np.arange(more.shape[1]) < counts[some][:, None]
            more[inside] = sources[(first[some][:, None] + np.arange(more.shape[1]))[inside]]
            pruned(held[some], np.concatenate([graph[held[some]], more], 1))

    at, size = 1, 1
    while at < n:
        insert(order[at : at + size])
        at, size = at + size, min(TOGETHER, 2 * size)
    # once more for the nodes that met a graph of less than half the size
    for again in range(0, n // 2, TOGETHER):
        insert(order[again : min(n // 2, again + TOGETHER)])
    return connected(points, graph, start, beam), start


def connected(points: np.ndarray, graph: np.ndarray, start: int, beam: int) -> np.ndarray:
    """The graph with an edge to every node that could not be reached, from the nearest reached one with room (one more column if none has)."""
    while True:
        seen = np.zeros(len(graph), dtype=bool)
        front = np.array([start])
        while len(front):
            seen[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~seen[np.maximum(front, 0)]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        met, _ = beam_search(points, graph, start, points[lost[:TOGETHER]], beam)
        room = (graph < 0).any(1)
        for node, near in zip(lost[:TOGETHER].tolist(), met):
            near = near[near >= 0]
            free = near[room[near]]
            if not len(free):
                graph = np.concatenate([graph, np.full((len(graph), 1), -1, dtype=np.int64)], 1)
                room[:] = True
                free = near
            graph[free[0], (graph[free[0]] >= 0).sum()] = node
            room[free[0]] = (graph[free[0]] < 0).any()


def _indexed(nodes: pa.Table, largest: float) -> pa.Table:
    """The graph of one shard; equal inputs give equal graphs."""
    nodes = nodes.sort_by([("mix", "ascending"), ("vector", "ascending")])
    dim = nodes["dim"][0].as_py()
    graph, start = build_graph(lifted(_matrix(nodes["vector"].to_pylist(), dim), largest, False))
    n, degree = graph.shape
    edges = pa.ListArray.from_arrays(pa.array(np.arange(0, n * degree + 1, degree, dtype=np.int32)), pa.array(graph.ravel().astype(np.int32)))
    columns = [nodes["shard"], nodes["dim"], pa.array(np.arange(n, dtype=np.int32)), nodes["vector"], nodes["ids"], edges, pa.array(np.arange(n) == start)]
    return pa.table(columns, ["shard", "dim", "node", "vector", "ids", "edges", "start"])


def _searched(queries: pa.Table, index: pa.Table, largest: float, k: int, beam: int) -> pa.Table:
    """Best rows of one shard for every query sent to it."""
    query, ids, scores = [], [], []
    if len(index) and len(queries):
        index = index.sort_by("node")
        dim = index["dim"][0].as_py()
        rows = _matrix(index["vector"].to_pylist(), dim)
        points, graph = lifted(rows, largest, False), np.asarray(index["edges"].combine_chunks().flatten()).reshape(len(rows), -1).astype(np.int64)
        start = int(np.flatnonzero(np.asarray(index["start"]))[0])
        names = index["ids"].combine_chunks()
        at, flat = np.asarray(names.offsets), np.asarray(names.flatten())
        at = at - at[0]
        asked = _matrix(queries["vector"].to_pylist(), dim)
        number, own = np.asarray(queries["query"]), np.asarray(queries["vec_id"])
        node_bytes, asked_bytes = index["vector"].to_pylist(), queries["vector"].to_pylist()
        for lo in range(0, len(asked), TOGETHER):
            some = asked[lo : lo + TOGETHER]
            met, _ = beam_search(points, graph, start, lifted(some, largest, True), max(beam, k + 1))
            owner, col = np.nonzero(met >= 0)
            node = met[owner, col]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.einsum("ij,ij->i", rows[node], some[owner])
            # every id of every node met, the query's own row (once) left out
            many = at[node + 1] - at[node]
            line, score = np.repeat(owner, many), np.repeat(score, many)
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            named = flat[np.repeat(at[node], many) + inner]
            same = np.repeat(np.array([node_bytes[i] == asked_bytes[lo + j] for i, j in zip(node.tolist(), owner.tolist())], dtype=bool), many)
            mine = np.flatnonzero(same & (named == own[lo + line]))
            drop = mine[np.unique(line[mine], return_index=True)[1]]
            keep = np.ones(len(line), dtype=bool)
            keep[drop] = False
            line, score, named = line[keep], score[keep], named[keep]
            order = np.lexsort((named, -score, line))
            line, score, named = line[order], score[order], named[order]
            first = np.arange(len(line)) - np.searchsorted(line, line) < k
            query.append(number[lo + line[first]])
            ids.append(named[first])
            scores.append(score[first])
    made = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((query, np.int64), (ids, np.int64), (scores, np.float64))]
    return pa.table([pa.array(c) for c in made], ["query", "vec_id", "score"])


def vectors_of(df: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (its bytes), ``dim``, ``norm`` of the rows that take part."""
    narrow = df.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding").cast("array<float>" if narrow else "array<double>")
    given = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return given.mapInArrow(_valid, "vec_id long, vector binary, dim int, norm double")


def build_index(vectors: DataFrame, k: int = 20) -> tuple[DataFrame, float]:
    """The written graphs of all shards (``shard``, ``dim``, ``node``, ``vector``, ``ids``, ``edges``, ``start``) and the largest norm.

    Every row is in the index: equal vectors are one node, of whose ids the k + 1 smallest are kept, as no result can hold more.
    """
    order = Window.partitionBy("vector", "dim").orderBy("vec_id")
    least = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = least.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("norm").alias("norm"))
    nodes = materialise(nodes.withColumn("mix", F.xxhash64("vector")), "graph-nodes")
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
    largest = nodes.agg(F.max("norm")).first()[0] or 1.0
    size = F.least(F.lit(MOST_NODES), F.ceil(SHARD * F.sqrt("n")))
    shard = F.pmod(F.col("mix"), F.ceil(F.col("n") / size)).cast("int")
    dealt = nodes.join(sizes.drop("norm"), "dim").select("dim", shard.alias("shard"), "vector", "ids", "mix")
    dealt = dealt.repartition(spread_over(sizes.agg(F.sum(F.ceil(F.col("n") / size))).first()[0]), "dim", "shard")
    schema = "shard int, dim int, node int, vector binary, ids array<long>, edges array<int>, start boolean"
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(lambda t: _indexed(t, largest), schema), "graph-index"), largest


def spread_over(shards: int | None) -> int:
    """Partitions for groups of shards: a shard is minutes of work on little data, so small partitions must not be put together."""
    return 4 * int(shards or 1)


def search(index: DataFrame, largest: float, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query``, ``rank``, ``vec_id``, ``score``: each query's best rows (``query``, ``vec_id``, ``vector``, ``dim`` of ``queries``)."""
    shards = index.select("dim", F.col("shard").alias("to")).distinct()
    n = spread_over(shards.count())
    sent = queries.join(shards, "dim").select("query", "vec_id", "vector", F.col("dim").alias("dim"), F.col("to").alias("shard")).repartition(n, "dim", "shard")
    found = sent.groupBy("dim", "shard").cogroup(index.repartition(n, "dim", "shard").groupBy("dim", "shard")).applyInArrow(
        lambda a, b: _searched(a, b, largest, k, beam), "query long, vec_id long, score double"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k rows of largest inner product found for each row whose id is divisible by ``every``.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without id, take no part; vectors of different
    lengths do not meet. Repeated rows are candidates of their own, a query leaves out one row with its id and vector. Equal scores follow the smaller id.
    A query with fewer than k candidates gets all that its searches met. An empty table gives no rows; other columns are ignored.
    """
    vectors = materialise(vectors_of(df), "graph-vectors")
    index, largest = build_index(vectors, k)
    asked = materialise(
        vectors.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), "vec_id", "vector", "dim"), "graph-queries"
    )
    found = search(index, largest, asked, k).join(asked.select("query", F.col("vec_id").alias("query_id")), "query")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_pruned_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))
