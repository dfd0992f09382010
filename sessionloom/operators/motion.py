"""Pointer traces: motion statistics, segmentation, alignment, motion-only sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import columns as C
from sessionloom.operators.structure import align_schema
from sessionloom.plans.chunks import order_chunks, ordered_points, ranked, running_total
from sessionloom.plans.cuts import at_or_before, rank_cuts
from sessionloom.session import materialise


TIES = ["tie"]


def motion_features(moves: DataFrame, key: str = "session_id", tie: str | list[str] = TIES) -> DataFrame:
    """Eight motion statistics per trace; a trace of one point gives zeros.

    Headings are not wrapped: crossing +-pi counts as a turn of about 2 pi. The first
    acceleration is 0. Deviations are population ones; movement_std pools dx and dy.
    """
    points = ordered_points(moves, key, "movement_index", tie, "x_coordinate", "y_coordinate")
    x, y = F.col("x_coordinate").cast("double"), F.col("y_coordinate").cast("double")
    dx, dy = x - F.col("x1"), y - F.col("y1")
    dx1, dy1 = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    steps = points.withColumns({"dx": dx, "dy": dy, "dist": F.hypot(dx, dy), "dist1": F.hypot(dx1, dy1)})
    turn = F.abs(F.atan2(dy, dx) - F.atan2(dy1, dx1))
    steps = steps.withColumns(
        {
            "turn": turn,
            "accel": F.when(F.col("dist").isNotNull(), F.coalesce(F.col("dist") - F.col("dist1"), F.lit(0.0))),
            "bend": turn / F.greatest("dist", F.lit(1.0)),
            "bx": C.equal_width_bin(x, F.col("x_min"), F.col("x_max"), 16),
            "by": C.equal_width_bin(y, F.col("y_min"), F.col("y_max"), 16),
        }
    )
    bins = [
        F.count_if(F.col(f"b{a}") == k).alias(f"_{a}{k}") for a in "xy" for k in range(16)
    ]
    zero = F.lit(0.0)
    pooled = F.sqrt(
        (F.var_pop("dx") + F.var_pop("dy")) / 2 + F.pow((F.avg("dx") - F.avg("dy")) / 2, 2)
    )
    agg = steps.groupBy(key).agg(
        F.count("*").alias("total_movements"),
        F.coalesce(F.avg("dist"), zero).alias("mouse_speed_mean"),
        F.coalesce(F.stddev_pop("dist"), zero).alias("mouse_speed_std"),
        F.coalesce(F.sum("dist"), zero).alias("mouse_path_length"),
        F.count_if(F.col("turn") > math.pi / 4).alias("direction_change_count"),
        F.coalesce(pooled, zero).alias("movement_std"),
        F.coalesce(F.stddev_pop("accel"), zero).alias("mouse_acceleration_std"),
        F.coalesce(F.avg("bend"), zero).alias("movement_curvature"),
        *bins,
    )
    entropies = [C.bin_entropy([F.col(f"_{a}{k}") for k in range(16)]) for a in "xy"]
    coordinate = F.when(F.col("total_movements") > 1, (entropies[0] + entropies[1]) / 2.0).otherwise(0.0)
    return agg.withColumn("coordinate_entropy", coordinate).drop(*[f"_{a}{k}" for a in "xy" for k in range(16)])


def largest_remainder(df: DataFrame, weight: str, total: int, key: str, name: str = "share") -> DataFrame:
    """Integer apportionment of ``total`` by weight; leftover units go to the largest fractions.

    Equal fractions are ordered by the key's hash. The cut through the fractions is an
    order statistic, so no global sort is needed and any number of rows works.
    """
    weight_sum = df.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if not weight_sum or total <= 0:
        return df.withColumn(name, F.lit(0).cast("long"))
    raw = F.col(weight).cast("double") / F.lit(float(weight_sum)) * F.lit(total)
    # fractions equal up to rounding noise must tie, so they are compared at 9 decimals
    based = df.withColumns({"_floor": F.floor(raw), "_frac": -F.round(raw - F.floor(raw), 9)})
    left = total - int(based.agg(F.sum("_floor")).first()[0])
    base = based.select(F.lit("all").alias("g"), F.col("_frac").alias("v"), F.col(key).cast("string").alias("k"))
    cut = rank_cuts(base, ranks={"all": [left]})["all"][0] if left > 0 else None
    extra = at_or_before(F.col("_frac"), F.col(key), cut).cast("long") if cut else F.lit(0)
    return based.withColumn(name, F.col("_floor") + extra).drop("_floor", "_frac")


def segment_traces(moves: DataFrame, target: int, prefix: str, tie: str | list[str] = TIES) -> DataFrame:
    """Split traces into about ``target`` pseudo-sessions of near-equal contiguous parts.

    Every trace keeps one segment; the rest are apportioned by trace length.
    """
    sizes = moves.groupBy("session_id").agg(F.count("*").alias("trace_n"))
    traces = sizes.count()
    extra = largest_remainder(sizes, "trace_n", max(0, target - traces), "session_id", "_extra")
    plan = extra.select("session_id", (F.col("_extra") + 1).alias("_k"))
    points = ordered_points(moves, "session_id", "movement_index", tie, "x_coordinate", "y_coordinate")
    rows = points.join(plan, "session_id")
    n, k, i = F.col("n"), F.col("_k"), F.col("ordinal") - 1
    q, r = F.floor(n / k), n % k
    long_part = r * (q + 1)
    segment = F.when(i < long_part, F.floor(i / (q + 1))).otherwise(
        r + F.floor((i - long_part) / F.greatest(q, F.lit(1)))
    )
    start = F.when(F.col("_seg") < r, F.col("_seg") * (q + 1)).otherwise(long_part + (F.col("_seg") - r) * q)
    rows = rows.withColumn("_seg", segment.cast("long"))
    return rows.select(
        F.concat_ws("_", F.lit(prefix), F.col("session_id"), F.format_string("%02d", F.col("_seg") + 1)).alias("session_id"),
        F.col("session_id").alias("original_session_id"),
        (i - start).cast("long").alias("movement_index"),
        *[c for c in moves.columns if c not in ("session_id", "movement_index")],
    )


def busy_order(sessions: DataFrame) -> DataFrame:
    """(session_id, _busy): sessions of one (movements, requests) pair share the number of sessions ahead of them.

    The two columns are sort keys of their own, largest first, NULL last; the running count is over distinct pairs.
    """
    keys = ["total_movements", "total_requests"]
    pairs = sessions.groupBy(*keys).agg(F.count("*").alias("_n")).withColumns({"_all": F.lit(0), "_down": -F.col("total_movements").cast("double")})
    upto = running_total(order_chunks(pairs, "_down"), ["_all"], [F.desc_nulls_last(c) for c in keys], {"_busy": "_n"})
    table = upto.select(*[F.col(c).alias("p_" + c) for c in keys], "_busy")
    same = sessions["total_movements"].eqNullSafe(table["p_total_movements"]) & sessions["total_requests"].eqNullSafe(table["p_total_requests"])
    return sessions.join(table, same).select("session_id", "_busy")


def rank_matched_ids(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """(segment id, session id): k-th longest segment takes the k-th busiest session's id, else NULL."""
    sizes = segments.groupBy("session_id").agg(F.count("*").alias("_n"))
    left = ranked(sizes, "_n", "session_id", descending=True).select(F.col("session_id").alias("segment_id"), "rank")
    right = ranked(busy_order(sessions), "_busy", "session_id").select("session_id", "rank")
    return left.join(right, "rank", "left").select("segment_id", "session_id")


def align_traces_to_sessions(moves: DataFrame, sessions: DataFrame, prefix: str = "adv", tie: str | list[str] = TIES) -> DataFrame:
    """Segment long traces to the number of sessions and re-key them to the session ids."""
    segments = segment_traces(moves, sessions.count(), prefix, tie)
    ids = rank_matched_ids(segments, sessions)
    renamed = segments.withColumnRenamed("session_id", "segment_id")
    return renamed.join(ids, "segment_id", "left").select("session_id", *[c for c in renamed.columns if c != "segment_id"])


def sessions_from_traces(
    moves: DataFrame,
    request_total: int = 57_454,
    base_start: str = "2019-10-30 00:00:00",
    tie: str | list[str] = TIES,
    align: bool = True,
) -> DataFrame:
    """Session rows for traces that came without request logs.

    Requests are apportioned by the square root of the trace length (at least 20 each);
    duration, intervals and the start (7 minutes apart in id order) follow from motion.
    """
    # apportioning scans the motion table several times
    motion = materialise(motion_features(moves, tie=tie), "motion")
    motion = largest_remainder(
        motion.withColumn("_w", F.sqrt("total_movements")), "_w", request_total, "session_id", "_share"
    ).drop("_w")
    motion = id_ordinals(motion)
    requests = F.greatest(F.col("_share"), F.lit(20))
    speed = F.greatest("mouse_speed_mean", F.lit(1.0))
    out = motion.withColumns(
        {
            "total_requests": requests,
            "session_duration_sec": C.clip(F.col("total_movements") / speed * 18.0, 45.0, 1600.0),
        }
    )
    duration, entropy = F.col("session_duration_sec"), F.col("coordinate_entropy")
    mean = duration / F.greatest(F.col("total_requests") - 1, F.lit(1))
    std = F.greatest(F.lit(0.05), mean * (0.18 + 0.07 * F.col("movement_std") / speed))
    start = F.to_timestamp(F.lit(base_start)) + F.make_interval(mins=(F.col("_ordinal") * 7).cast("int"))
    out = out.withColumns({"request_interval_mean": mean, "request_interval_std": std, "session_start": start})
    out = out.withColumn("session_end", C.add_seconds(F.col("session_start"), duration))
    out = out.withColumns(
        {
            "label": F.lit(1),
            "bot_type": F.lit("moderate_bot"),
            "data_source": F.lit("legacy_moderate"),
            "data_source_detail": F.lit("behavioral_only_reconstruction"),
            "candidate_human": F.lit(False),
            "activity_date": C.activity_date(F.col("session_start")),
            "time_range": C.time_range(F.col("session_start"), F.col("session_end")),
            "click_interval_entropy": entropy / 2.5,
            "request_interval_entropy": entropy / 2.5,
            "session_idle_ratio": C.clip(F.col("request_interval_std") / F.greatest(duration, F.lit(1.0)), 0.0, 1.0),
            "requests_per_minute": C.per_minute(F.col("total_requests"), duration),
            "clicks_per_minute": C.per_minute(F.col("total_movements"), duration),
            "click_interval_mean": F.col("request_interval_mean"),
            "click_interval_std": F.col("request_interval_std"),
            "click_count": F.col("total_requests"),
            "install_count": F.lit(0).cast("long"),
            "successful_requests": F.lit(0).cast("long"),
            "success_rate": F.lit(0.0),
            "device_entropy": F.lit(0.0),
            "channel_entropy": entropy / 3.5,
            "app_entropy": entropy / 4.0,
            "logs_count": F.col("total_requests"),
        }
    ).drop("_share", "_ordinal")
    return align_schema(out) if align else out


def id_ordinals(df: DataFrame, key: str = "session_id", name: str = "_ordinal") -> DataFrame:
    """0-based position of every row in key order: cells in order first, then inside a cell.

    The table is range-partitioned by key and written once, so that the cell number is data and
    cannot change when a task runs again.
    """
    base = materialise(df.repartitionByRange(key).withColumn("_chunk", F.spark_partition_id()), "ordinals")
    out = running_total(base.withColumns({"_one": F.lit(1), "_all": F.lit(0)}), ["_all"], [key], {name: "_one"})
    return out.withColumn(name, F.col(name) - 1).drop("_one", "_all", f"{name}_total")
