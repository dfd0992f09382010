"""Ordered computations over keys of any size.

A window partitioned by a hot key sorts that key's rows in one task. Here the rows of a
key are cut into chunks along the order; the window runs inside (key, chunk), one summary
row per chunk is chained over the key, and the two are joined back.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions.columns import stable_fraction

#: Rows that one cell of an ordered computation holds on average.
CELL_ROWS = 2_000_000
#: Keys with more rows are cut into chunks, all others are ordered whole.
HOT_ROWS = 1_000_000
#: Rows of whole keys that lie in one partition on average.
PART_ROWS = 200_000
#: Hash slots in which rows are counted before keys are.
KEY_SLOTS = 1 << 16


def time_gaps(
    df: DataFrame, keys: list[str], time: str, tie: str, limit_us: int | None = None, chunk_seconds: int = 60
) -> DataFrame:
    """One row per distinct (keys, time): gap to the previous instant and gap-session index.

    Copies of an instant collapse before the shuffle (their gap is zero by definition), so
    a chunk holds at most ``chunk_seconds`` worth of distinct instants of one key, however
    hot the key. Columns: keys, time, first_tie, gap_us (NULL at the first instant) and,
    with ``limit_us``, session_index counted from 1.
    """
    limit = limit_us if limit_us is not None else (1 << 62)
    instants = (
        df.groupBy(*keys, time)
        .agg(F.min(tie).alias("first_tie"))
        .withColumn("_us", F.unix_micros(time))
        .withColumn("_chunk", F.floor(F.col("_us") / (chunk_seconds * 1_000_000)))
    )
    inner = W.partitionBy(*keys, "_chunk").orderBy("_us")
    local = instants.withColumn("_step", F.col("_us") - F.lag("_us").over(inner)).withColumn(
        "_starts",
        F.sum(F.when(F.col("_step") > limit, 1).otherwise(0)).over(inner.rowsBetween(W.unboundedPreceding, 0)),
    )
    chain = W.partitionBy(*keys).orderBy("_chunk")
    heads = (
        local.groupBy(*keys, "_chunk")
        .agg(
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.max("_starts").alias("_inner"),
            F.min("first_tie").alias("_tie"),
        )
        .withColumn("_head_gap", F.col("_first") - F.lag("_last").over(chain))
        .withColumn("_opens", F.when(F.col("_head_gap") <= limit, 0).otherwise(1))
        .withColumn(
            "_base",
            F.sum(F.col("_opens") + F.col("_inner")).over(chain.rowsBetween(W.unboundedPreceding, 0)) - F.col("_inner"),
        )
        .select(*keys, "_chunk", "_head_gap", "_base", "_tie")
    )
    # reading _tie (never above first_tie) keeps the columns of both branches equal, so
    # Spark reuses one shuffle of the instants for the summary and for the detail
    out = local.join(heads, [*keys, "_chunk"]).select(
        *keys,
        time,
        F.greatest("first_tie", "_tie").alias("first_tie"),
        F.coalesce("_step", "_head_gap").alias("gap_us"),
        (F.col("_base") + F.col("_starts")).alias("session_index"),
    )
    return out if limit_us is not None else out.drop("session_index")


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> tuple[DataFrame | None, int]:
    """Keys with more than ``limit`` rows as a small table (None if there is none) and the number of rows; at most rows / ``limit`` keys reach the driver.

    Rows are counted by ``KEY_SLOTS`` hash slots first, which a task adds up to a few bytes; keys are counted only where a slot has more than ``limit`` rows.
    """
    slotted = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(KEY_SLOTS)).alias("_slot"))
    full = slotted.groupBy("_slot").agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("n"), F.collect_list(F.when(F.col("_n") > limit, F.col("_slot"))).alias("slots")).first()
    if not full["slots"]:
        return None, full["n"] or 0
    counted = slotted.where(F.col("_slot").isin(full["slots"])).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counted.where(F.col("_n") > limit).drop("_n")
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None, full["n"]


def parts_of(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows dealt by keys that a task can order whole."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(-(-rows // PART_ROWS), min(cores, -(-rows // 10_000)), 1)


def whole_gaps(df: DataFrame, keys: list[str], time: str, tie: str, limit_us: int, rows: int) -> DataFrame:
    """The rows with first_tie, gap_us and session_index of ``time_gaps``, for keys that a task can order whole.

    One shuffle by key serves all windows, and whatever is grouped by these keys and more afterwards. Its partitions follow the number of
    ``rows``: later steps widen the rows, so partitions of few compressed bytes must not be put together.
    """
    dealt = df.repartition(parts_of(df, rows), *keys).withColumn("_us", F.unix_micros(time))
    order = W.partitionBy(*keys).orderBy("_us")
    gap = F.col("_us") - F.max("_us").over(order.rangeBetween(W.unboundedPreceding, -1))
    back = F.lag("_us").over(order)
    marked = dealt.withColumns({"gap_us": gap, "_head": back.isNull() | (back < F.col("_us"))})
    # an instant opens one session, however many rows it has
    opens = F.col("_head") & (F.col("gap_us").isNull() | (F.col("gap_us") > limit_us))
    out = marked.withColumn("session_index", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    return out.withColumn("first_tie", F.min(tie).over(W.partitionBy(*keys, "_us"))).drop("_us", "_head")


def ordered_points(
    df: DataFrame, key: str, index: str, tie: str | list[str], x: str, y: str, chunk_rows: int = 65536, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Movement rows with the two previous points, ordinal, trace length and bounds.

    Adds i1, x1, y1 and x2, y2 (previous and second previous point, NULL before the first), ordinal (from 1), n, x_min, x_max,
    y_min, y_max. Rows without key or index are dropped. Traces of up to ``hot_rows`` rows are ordered whole after one shuffle, which serves what is grouped by
    the key afterwards; longer ones go through chunks. Everything stays in primitive columns, so windows and aggregates run in generated code.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(index).isNotNull())
    hot, n = hot_keys(rows, [key], hot_rows)
    if hot is None:
        return whole_points(rows, key, index, tie, x, y, n)
    many = chunked_points(rows.join(F.broadcast(hot), key, "left_semi"), key, index, tie, x, y, chunk_rows)
    return whole_points(rows.join(F.broadcast(hot), key, "left_anti"), key, index, tie, x, y, n).unionByName(many)


def whole_points(df: DataFrame, key: str, index: str, tie: str | list[str], x: str, y: str, rows: int) -> DataFrame:
    """``ordered_points`` of traces that a task can order whole."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    dealt = df.repartition(parts_of(df, rows), key).withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    order, whole = W.partitionBy(key).orderBy(index, *ties), W.partitionBy(key)
    return dealt.select(
        *df.columns,
        F.lag(index).over(order).alias("i1"),
        *[F.lag(f"_{c}", d).over(order).alias(f"{c}{d}") for d in (1, 2) for c in "xy"],
        F.row_number().over(order).cast("long").alias("ordinal"),
        F.count("*").over(whole).alias("n"),
        *[f(f"_{c}").over(whole).alias(f"{c}_{name}") for c in "xy" for name, f in (("min", F.min), ("max", F.max))],
    )


def chunked_points(df: DataFrame, key: str, index: str, tie: str | list[str], x: str, y: str, chunk_rows: int = 65536) -> DataFrame:
    """``ordered_points`` of traces of any size. The chunk is the index divided by ``chunk_rows``."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    rows = df.withColumns(
        {
            "_chunk": F.floor(F.col(index) / chunk_rows),
            "_x": F.col(x).cast("double"),
            "_y": F.col(y).cast("double"),
        }
    )
    inner = W.partitionBy(key, "_chunk").orderBy(index, *ties)
    local = rows.withColumns(
        {
            "_rn": F.row_number().over(inner),
            "_next": F.lead(F.lit(1)).over(inner),
            "_li1": F.lag(index, 1).over(inner),
            **{f"_l{c}{d}": F.lag(f"_{c}", d).over(inner) for c in "xy" for d in (1, 2)},
        }
    )
    last = lambda c: F.max(F.when(F.col("_next").isNull(), F.col(c)))
    chain = W.partitionBy(key).orderBy("_chunk")
    whole = W.partitionBy(key)
    summary = local.groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"),
        last(index).alias("_ti"),
        *[last(f"_{c}").alias(f"_t{c}") for c in "xy"],
        *[last(f"_l{c}1").alias(f"_u{c}") for c in "xy"],
        *[f(f"_{c}").alias(f"_{name}{c}") for c in "xy" for name, f in (("lo", F.min), ("hi", F.max))],
    )
    heads = summary.select(
        key,
        "_chunk",
        F.lag("_ti", 1).over(chain).alias("_hi1"),
        *[F.lag(f"_t{c}", 1).over(chain).alias(f"_h{c}1") for c in "xy"],
        # a one-row chunk has no second last row of its own: take the last of the chunk before
        *[F.coalesce(F.lag(f"_u{c}", 1).over(chain), F.lag(f"_t{c}", 2).over(chain)).alias(f"_h{c}2") for c in "xy"],
        (F.sum("_n").over(chain.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("n"),
        *[f(f"_{name[:2]}{c}").over(whole).alias(f"{c}_{name[2:]}") for c in "xy" for name, f in (("lomin", F.min), ("himax", F.max))],
    )
    joined = local.join(heads, [key, "_chunk"])
    second = lambda c: F.coalesce(
        f"_l{c}2", F.when(F.col("_rn") > 1, F.col(f"_h{c}1")).otherwise(F.col(f"_h{c}2"))
    )
    return joined.select(
        *df.columns,
        F.coalesce("_li1", "_hi1").alias("i1"),
        *[F.coalesce(f"_l{c}1", f"_h{c}1").alias(f"{c}1") for c in "xy"],
        *[second(c).alias(f"{c}2") for c in "xy"],
        (F.col("_before") + F.col("_rn")).alias("ordinal"),
        "n",
        "x_min",
        "x_max",
        "y_min",
        "y_max",
    )


def order_chunks(df: DataFrame, value: str, key: str | None = None, cells: int | None = None, ties: int | None = None) -> DataFrame:
    """Add ``_chunk``, an order-preserving cell number of (value, hash(key)).

    Cell edges come from one ``percentile_approx`` pass; their number follows the row count. A value frequent
    enough to be an edge gets a cell of its own, cut further by the key hash, so that ties cannot pile up.
    NULL and NaN share a cell after all others, cut by the key hash too.
    """
    plain = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    if cells is None or ties is None:
        rows = df.count()
        cells, ties = cells or max(256, rows // CELL_ROWS), ties or max(1024, rows // CELL_ROWS)
    grid = [i / cells for i in range(1, cells)]
    edges = df.agg(F.percentile_approx(F.when(F.abs(plain) < float("inf"), plain), grid, cells * 50)).first()[0] or [0.0]
    edges = sorted({float(e) + 0.0 for e in edges})
    splits = [-float("inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol="_cell", handleInvalid="keep")
    placed = cut.transform(df.withColumns({"_none": plain.isNull(), "_v": F.coalesce(plain, F.lit(0.0))}))
    floor_edge = F.element_at(F.array(*[F.lit(e) for e in [-float("inf"), *edges]]), (F.col("_cell") + 1).cast("int"))
    on_edge = F.col("_none") | (F.col("_v") == floor_edge)
    place = F.when(F.col("_none"), float(len(splits))).otherwise(F.col("_cell"))
    cell = (place * 2 + F.when(on_edge, 0).otherwise(1)).cast("long")
    if key is None:
        return placed.withColumn("_chunk", cell).drop("_v", "_cell", "_none")
    sub = F.when(on_edge, F.floor(stable_fraction(F.col(key).cast("string")) * ties)).otherwise(0)
    return placed.withColumn("_chunk", cell * ties + sub).drop("_v", "_cell", "_none")


def running_total(df: DataFrame, groups: list[str], order: list, weights: dict[str, str]) -> DataFrame:
    """Inclusive running sums along ``order`` of a frame that carries an order-preserving ``_chunk``.

    ``weights`` maps output name to summed column; ``<name>_total`` is the group total.
    """
    inner = W.partitionBy(*groups, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    chain = W.partitionBy(*groups).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*groups)
    heads = df.groupBy(*groups, "_chunk").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in weights.items()])
    heads = heads.select(
        *groups,
        "_chunk",
        *[(F.sum(f"_s_{o}").over(chain) - F.col(f"_s_{o}")).alias(f"_b_{o}") for o in weights],
        *[F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in weights],
    )
    local = df.withColumns({f"_r_{o}": F.sum(c).over(inner) for o, c in weights.items()})
    out = local.join(heads, [*groups, "_chunk"])
    out = out.withColumns({o: F.col(f"_b_{o}") + F.col(f"_r_{o}") for o in weights})
    return out.drop("_chunk", *[f"_b_{o}" for o in weights], *[f"_r_{o}" for o in weights])


def ranked(df: DataFrame, value: str, key: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """1-based rank over (value, hash(key), key) for every row, balanced under ties; NULL and NaN rank last."""
    plain = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    signed = -plain if descending else plain
    base = df.withColumns({"_sv": signed, "_one": F.lit(1), "_hk": stable_fraction(F.col(key).cast("string")), "_all": F.lit(0)})
    chunked = order_chunks(base, "_sv", key)
    out = running_total(chunked, ["_all"], ["_sv", "_hk", key], {name: "_one"})
    return out.drop("_sv", "_one", "_hk", "_all", f"{name}_total")
