"""Order statistics without a global sort.

A global ``row_number`` or ``percentile`` pulls a whole column into one task. The
functions here narrow the searched value range with one small aggregate per round until
few values remain, so each round is a scan with map-side combine and only scalars reach
the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions.columns import stable_fraction
from sessionloom.session import ship_by_value

ship_by_value(__name__)

GRID = 200
RANGE_LIMIT = 200_000


def to_long(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(g, v) rows: one per non-null value; g names the column, or ``group<TAB>column``."""
    group = [F.col(by).cast("string").alias("grp")] if by else [F.lit("").alias("grp")]
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    present = F.col("v").isNotNull() & ~F.isnan("v") & F.col("grp").isNotNull()
    long = df.select(*group, F.inline(cells)).filter(present)
    return long.select(F.concat_ws("\t", "grp", "c").alias("g"), "v")


def order_statistics(
    long: DataFrame, ranks: dict[str, list[int]] | None = None, rank_of=None, limit: int = RANGE_LIMIT, keep: bool = True
) -> tuple[dict[tuple[str, int], tuple[float, int, int]], dict[str, int]]:
    """Exact values at 0-based ranks per group of a (g, v) frame.

    Give ``ranks`` per group, or ``rank_of(n) -> ranks`` when they depend on the group
    size. Returns {(g, rank): (value, rows below the value, rows equal to it)} and the
    group sizes. The groups must be few (columns x classes): their ranges are held on
    the driver. ``keep`` holds the narrow (g, v) rows on executor disk between the rounds,
    so that what produced them runs once; lost blocks are recomputed.
    """
    if keep:
        long = long.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return order_statistics(long, ranks, rank_of, limit, keep=False)
        finally:
            long.unpersist()
    spark = long.sparkSession
    v = F.col("v")
    counted = long.groupBy("g").agg(
        F.count("*").alias("n"), F.count_if(v == -math.inf).alias("low"), F.count_if(v == math.inf).alias("high")
    ).collect()
    sizes = {r["g"]: r["n"] for r in counted}
    asked = {g: sorted(set(ranks.get(g, []) if ranks is not None else rank_of(n))) for g, n in sizes.items()}
    # infinite values are settled by their counts; what is narrowed below is finite, so every round shrinks its ranges
    ends: dict[tuple[str, int], tuple[float, int, int]] = {}
    wanted, below_all = {}, {}
    for r in counted:
        g, n, low, high = r["g"], r["n"], r["low"], r["high"]
        for rank in asked[g]:
            if rank < low:
                ends[(g, rank)] = (-math.inf, 0, low)
            elif rank >= n - high:
                ends[(g, rank)] = (math.inf, n - high, high)
        wanted[g] = [rank - low for rank in asked[g] if low <= rank < n - high]
        below_all[g] = low
    long = long.filter(F.abs(v) < math.inf)
    # open ranges: (group, low, high) -> ranks still sought inside it
    ranges: dict[tuple[str, float, float], list[int]] = {
        (g, -math.inf, math.inf): r for g, r in wanted.items() if r
    }
    finite = {r["g"]: r["n"] - r["low"] - r["high"] for r in counted}
    inside = {key: finite[key[0]] for key in ranges}
    found: dict[tuple[str, int], tuple[float, int, int]] = {}

    while any(n > limit for n in inside.values()):
        wide = {k: r for k, r in ranges.items() if inside[k] > limit}
        grid = [i / GRID for i in range(GRID + 1)]
        stats = (
            _within(spark, long, wide)
            .groupBy("id")
            .agg(
                F.percentile_approx(F.when(F.col("side") == 0, F.col("v")), grid, GRID * 50).alias("grid"),
            )
            .collect()
        )
        keys = list(wide)
        narrowed: dict[tuple[str, float, float], list[int]] = defaultdict(list)
        for row in stats:
            g, low, high = keys[row["id"]]
            cuts = [low, *sorted(set(row["grid"])), high]
            for a, b in zip(cuts, cuts[1:]):
                narrowed[(g, a, b)] = []
        # the group's other open ranges keep their edges, then everything is counted afresh
        touched = {k[0] for k in wide}
        for k in ranges:
            if k[0] in touched and k not in wide:
                narrowed[k] = []
        counts = _cell_counts(spark, long, list(narrowed))
        ranges = {k: r for k, r in ranges.items() if k[0] not in touched}
        inside = {k: inside[k] for k in ranges}
        for g, cells in counts.items():
            start = 0
            for kind, a, b, n in cells:
                hits = [r for r in wanted[g] if start <= r < start + n]
                if hits and kind == "point":
                    for r in hits:
                        found[(g, r)] = (a, start, n)
                elif hits:
                    ranges[(g, a, b)] = hits
                    inside[(g, a, b)] = n
                start += n

    if ranges:
        keys = list(ranges)
        rows = _within(spark, long, ranges)
        counts = rows.groupBy("id", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
        below = F.sum("n").over(W.partitionBy("id").orderBy("side", "v").rowsBetween(W.unboundedPreceding, -1))
        running = counts.withColumn("below", F.coalesce(below, F.lit(0))).filter("side = 0")
        sought = spark.createDataFrame(
            [(i, int(r)) for i, k in enumerate(keys) for r in ranges[k]], "id int, rank long"
        )
        hits = running.join(F.broadcast(sought), "id").filter("below <= rank and rank < below + n")
        for row in hits.select("id", "rank", "v", "below", "n").collect():
            found[(keys[row["id"]][0], row["rank"])] = (row["v"], row["below"], row["n"])
    shifted = {(g, r + below_all[g]): (value, below + below_all[g], n) for (g, r), (value, below, n) in found.items()}
    return {**shifted, **ends}, sizes


def _within(spark, long: DataFrame, ranges) -> DataFrame:
    """Rows of ``long`` joined to the (few) open ranges; side -1 below, 0 inside, above dropped."""
    table = spark.createDataFrame(
        [(i, g, low, high) for i, (g, low, high) in enumerate(ranges)], "id int, g string, low double, high double"
    )
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    # an unbounded end also takes the infinite values
    side = F.when((v <= low) & (low > -math.inf), -1).when((v < high) | (high == math.inf), 0)
    return long.join(F.broadcast(table), "g").withColumn("side", side).filter("side is not null")


def _placed(batches, lines: dict[str, np.ndarray]):
    """A task's rows per group and slot: 2*i for the open cell below edge i, 2*i+1 for the edge itself."""
    total = {g: np.zeros(2 * len(e) + 1, dtype=np.int64) for g, e in lines.items()}
    for batch in batches:
        coded, v = batch.column("g").dictionary_encode(), np.asarray(batch.column("v"))
        code = np.asarray(coded.indices)
        for i, g in enumerate(coded.dictionary.to_pylist()):
            if g in lines:
                e, x = lines[g], v[code == i]
                slot = np.searchsorted(e, x, "left") + np.searchsorted(e, x, "right")
                total[g] += np.bincount(slot, minlength=len(total[g]))
    cells = [(g, int(i), int(n[i])) for g, n in total.items() for i in np.flatnonzero(n)]
    if cells:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.string(), pa.int32(), pa.int64()))], ["g", "slot", "n"])


def _cell_counts(spark, long: DataFrame, cells) -> dict[str, list[tuple[str, float, float, int]]]:
    """Row counts of the open cells and of their edge values, in value order per group."""
    edges: dict[str, list[float]] = defaultdict(set)
    for g, low, high in cells:
        edges[g].update(e for e in (low, high) if not math.isinf(e))  # the values themselves are finite
    lines = {g: np.array(sorted(e)) for g, e in edges.items()}
    counted = long.select("g", "v").mapInArrow(lambda b: _placed(b, lines), "g string, slot int, n long")
    rows = counted.groupBy("g", "slot").agg(F.sum("n").alias("n")).collect()
    hist = {(r["g"], r["slot"]): r["n"] for r in rows}
    out = {}
    for g, e in edges.items():
        points = [-math.inf, *sorted(e), math.inf]
        line = []
        for i in range(len(points) - 1):
            line.append(("cell", points[i], points[i + 1], hist.get((g, 2 * i), 0)))
            if i < len(points) - 2:
                line.append(("point", points[i + 1], points[i + 1], hist.get((g, 2 * i + 1), 0)))
        out[g] = line
    return out


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: str | None = None, exact: bool = True
) -> dict:
    """Linear-interpolation quantiles: {column: [..]} or {group: {column: [..]}}.

    ``exact=False`` takes one pass of ``percentile_approx`` instead.
    """
    out: dict = defaultdict(dict) if by else {}
    if not exact:
        aggs = [F.percentile_approx(c, probs, 100_000).alias(c) for c in columns]
        rows = df.groupBy(F.col(by).cast("string").alias("grp")).agg(*aggs).collect() if by else df.agg(*aggs).collect()
        for row in rows:
            values = {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
            if by:
                out[row["grp"]] = values
            else:
                return values
        return dict(out)

    def rank_of(n):
        return [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    found, sizes = order_statistics(to_long(df, columns, by), rank_of=rank_of)
    for g, n in sizes.items():
        group, column = g.split("\t") if "\t" in g else ("", g)
        values = []
        for p in probs:
            at = (n - 1) * p
            low, high = found[(g, math.floor(at))][0], found[(g, math.ceil(at))][0]
            values.append(low + (high - low) * (at - math.floor(at)))
        if by:
            out[group][column] = values
        else:
            out[column] = values
    if not by:
        for column in columns:
            out.setdefault(column, [None] * len(probs))
    return dict(out)


Cut = tuple[float, float, str]


def rank_cuts(base: DataFrame, ranks: dict[str, list[int]] | None = None, rank_of=None) -> dict[str, list[Cut | None]]:
    """The (value, hash, key) triples at 1-based ranks of the order (value, hash(key), key), per group.

    ``base`` has columns g (group), v (value) and k (key); give ``ranks`` per group or
    ``rank_of(n) -> ranks``. Ties on the value are ordered by the key's hash, so a value
    shared by a third of the rows is cut as evenly as any other. NULL values are not ranked.
    All groups share the same few passes.
    """
    base = base.filter("v is not null and not isnan(v)").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rank_cuts(base, ranks, rank_of)
    finally:
        base.unpersist()


def _rank_cuts(base: DataFrame, ranks, rank_of) -> dict[str, list[Cut | None]]:
    spark = base.sparkSession
    if rank_of is None:
        lower = {g: [r - 1 for r in rs if r >= 1] for g, rs in ranks.items()}
        found, sizes = order_statistics(base.select("g", "v"), ranks=lower, keep=False)
        asked = ranks
    else:
        inside = lambda n: [r - 1 for r in rank_of(n) if 1 <= r <= n]
        found, sizes = order_statistics(base.select("g", "v"), rank_of=inside, keep=False)
        asked = {g: rank_of(n) for g, n in sizes.items()}
    # per tied value: which positions inside the tie are sought
    inner: dict[str, list[int]] = defaultdict(list)
    place = {}
    for (g, r), (v, below, _) in found.items():
        tie = f"{g}\t{v!r}"
        inner[tie].append(r - below)
        place[(g, r + 1)] = (v, tie, r - below)
    out: dict[str, list[Cut | None]] = {g: [None] * len(rs) for g, rs in asked.items()}
    if not place:
        return out
    values = spark.createDataFrame(
        sorted({(g, v, tie) for (g, _), (v, tie, _) in place.items()}), "g string, v double, tie string"
    )
    hashed = base.join(F.broadcast(values), ["g", "v"]).select(F.col("tie").alias("g"), "k", stable_fraction(F.col("k")).alias("h"))
    cuts, _ = order_statistics(hashed.select("g", F.col("h").alias("v")), ranks=dict(inner), keep=False)
    # keys sharing one 48-bit hash are ordered by key; a repeated key counts its rows
    spots = sorted({(g, h, within - below) for (g, within), (h, below, _) in cuts.items()})
    sought = spark.createDataFrame(spots, "g string, h double, at long")
    named = hashed.join(F.broadcast(sought.select("g", "h").distinct()), ["g", "h"]).groupBy("g", "h", "k").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("g", "h").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    hits = named.withColumn("upto", upto).join(F.broadcast(sought), ["g", "h"]).filter("upto - n <= at and at < upto")
    shared = {(row["g"], row["h"], row["at"]): row["k"] for row in hits.select("g", "h", "at", "k").collect()}
    for g, rs in asked.items():
        for i, r in enumerate(rs):
            if (g, r) in place:
                v, tie, within = place[(g, r)]
                h, below, _ = cuts[(tie, within)]
                out[g][i] = (v, h, shared[(tie, h, within - below)])
    return out


def at_or_before(value: Column, key: Column, cut: tuple[float, float, str] | None, hashed: Column | None = None) -> Column:
    """Row test against a ``rank_cuts`` triple; a missing cut admits nothing."""
    if cut is None:
        return F.lit(False)
    v, h, k = cut
    hashed = stable_fraction(key.cast("string")) if hashed is None else hashed
    tie = (hashed < h) | ((hashed == h) & (key.cast("string") <= k))
    x = value.cast("double")
    return F.coalesce((x < v) | ((x == v) & tie), F.lit(False))


def rank_slots(df: DataFrame, values: dict[str, str], key: str, rank_of, by: str | None = None) -> DataFrame:
    """Add the slot of each row between ascending rank cuts: 0 up to the first cut, and so on.

    ``values`` maps each ranked column to its slot name; ``by`` ranks inside classes (few).
    Slots come from literal cut values, so no row is shuffled. A NULL value gets no slot.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in values])
    base = df.select(group.alias("grp"), F.col(key).cast("string").alias("k"), F.inline(cells))
    base = base.filter("grp is not null").select(F.concat_ws("\t", "grp", "c").alias("g"), "v", "k")
    cuts = rank_cuts(base, rank_of=rank_of)
    slots = {}
    for c, name in values.items():
        arms = []
        for g, triples in cuts.items():
            grp, column = g.split("\t")
            if column == c:
                tests = " ".join(f"WHEN {_cut_sql(c, key, cut)} THEN {i}" for i, cut in enumerate(triples) if cut)
                inner = f"CASE {tests} ELSE {len(triples)} END" if tests else str(len(triples))
                arms.append(f"WHEN `{c}` IS NOT NULL AND {f'CAST(`{by}` AS STRING) = {_quoted(grp)}' if by else 'true'} THEN {inner}")
        slots[name] = F.expr(f"CASE {' '.join(arms)} END") if arms else F.lit(None).cast("int")
    return df.withColumn("_hk", stable_fraction(F.col(key).cast("string"))).withColumns(slots).drop("_hk")


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _cut_sql(column: str, key: str, cut: Cut) -> str:
    """``at_or_before`` as text: hundreds of cuts parse faster than they chain through columns."""
    v, h, k = cut
    x, edge, hash_edge = f"CAST(`{column}` AS DOUBLE)", f"CAST('{v!r}' AS DOUBLE)", f"CAST('{h!r}' AS DOUBLE)"
    return f"({x} < {edge} OR ({x} = {edge} AND (_hk < {hash_edge} OR (_hk = {hash_edge} AND CAST(`{key}` AS STRING) <= {_quoted(k)}))))"


def flag_by_hash(
    df: DataFrame, strata: list[str], quota: DataFrame, key: str, salt: str, buckets: int | None = None,
    take: str = "take", name: str = "taken", keep_rest: bool = True,
) -> DataFrame:
    """Mark the ``take`` rows with the smallest keyed hash in every stratum.

    ``quota`` holds one row per stratum. A histogram of hash buckets tells which buckets
    are taken whole; only the one bucket per stratum that the quota cuts through is ranked,
    so no stratum is ever sorted in one task. The number of buckets follows the row count.
    """
    buckets = buckets or max(16384, df.count() // 50_000)
    keyed = df.withColumn("_h", stable_fraction(F.concat(F.col(key).cast("string"), F.lit("|" + salt))))
    keyed = keyed.withColumn("_b", F.floor(F.col("_h") * buckets).cast("int"))
    hist = keyed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    plan = (
        hist.withColumn("_before", F.coalesce(upto, F.lit(0)))
        .join(quota.select(*strata, F.col(take).alias("_take")), strata)
        .filter("_before < _take")
        .select(*strata, "_b", (F.col("_take") - F.col("_before")).alias("_need"), "_n")
    )
    joined = keyed.join(plan, [*strata, "_b"], "left" if keep_rest else "inner")
    cut_through = F.coalesce(F.col("_need") < F.col("_n"), F.lit(False))
    settled = joined.filter(~cut_through).withColumn(name, F.col("_need").isNotNull())
    order = W.partitionBy(*strata, "_b").orderBy("_h", key)
    edge = joined.filter(cut_through).withColumn(name, F.row_number().over(order) <= F.col("_need"))
    return settled.unionByName(edge).select(*df.columns, name)


def take_by_hash(df: DataFrame, strata: list[str], quota: DataFrame, key: str, salt: str, **options) -> DataFrame:
    """The rows ``flag_by_hash`` marks."""
    return flag_by_hash(df, strata, quota, key, salt, keep_rest=False, **options).filter("taken").drop("taken")
