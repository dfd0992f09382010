"""Streaming sessions, rate windows and deduplication.

The batch operators are the specification: closed sessions of a replay equal the batch
sessions, a pause of exactly the gap stays inside a session in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import columns as C
from sessionloom.session import ship_by_value, work_folder

ship_by_value(__name__)
EPSILON = C.ENTROPY_EPSILON


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def session_windows(clicks: DataFrame, keys: list[str], gap: str = "30 minutes", delay: str = "10 minutes", time: str = "click_time") -> DataFrame:
    """Gap sessions with count, installs, start and end.

    The window ends a gap after the last event, so the duration is max - min of the times.
    """
    return (
        clicks.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, gap).alias("w"))
        .agg(
            F.count("*").alias("click_count"),
            F.sum("is_attributed").alias("install_count"),
            F.min(time).alias("session_start"),
            F.max(time).alias("session_end"),
        )
        .drop("w")
    )


def session_window_features(clicks: DataFrame, keys: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session windows with the features that decompose: duration, rates, mean interval, success rate."""
    w = session_windows(clicks, keys, gap, delay)
    span = C.seconds_between(F.col("session_end"), F.col("session_start"))
    out = w.withColumn("session_duration_sec", C.clip(span, low=1.0))
    n, seconds = F.col("click_count"), F.col("session_duration_sec")
    return out.withColumns(
        {
            "click_interval_mean": span / n,
            "requests_per_minute": C.per_minute(n, seconds),
            "success_rate": C.success_rate(F.col("install_count"), n),
        }
    )


def rate_windows(clicks: DataFrame, keys: list[str], width: str = "1 minute", slide: str | None = None, delay: str = "10 minutes", time: str = "click_time") -> DataFrame:
    """Clicks per key in tumbling (or sliding) windows, with the per-minute rate."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = clicks.withWatermark(time, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    minutes = C.seconds_between(F.col("w.end"), F.col("w.start")) / 60.0
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", (F.col("n") / minutes).alias("per_minute"))


def first_per_key_stream(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One row per key while its first event is within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


INTERVAL_OUTPUT = (
    "session_start timestamp, session_end timestamp, click_count long, click_interval_mean double, "
    "click_interval_std double, click_interval_entropy double"
)
INTERVAL_STATE = "folded long, pending array<long>, start long, last long, n long, gaps array<long>, counts array<long>"


def interval_statistics(gaps: np.ndarray, counts: np.ndarray) -> tuple[float, float | None, float]:
    """Mean, sample deviation and 10-bin entropy of weighted intervals in microseconds."""
    n = counts.sum()
    mean = float((gaps * counts).sum()) / n
    std = float(np.sqrt((counts * (gaps - mean) ** 2).sum() / (n - 1)) / 1e6) if n > 1 else None
    low, high = gaps.min(), gaps.max()
    slot = np.zeros(len(gaps), dtype=int) if low == high else np.minimum((gaps - low) / (high - low) * 10, 9).astype(int)
    p = np.bincount(slot, weights=counts, minlength=10) / n
    p = p[p > 0]
    return mean / 1e6, std, float(-(p * np.log2(p + EPSILON)).sum())


def session_interval_features(clicks: DataFrame, keys: list[str], gap_us: int, delay: str = "10 minutes", time: str = "click_time") -> DataFrame:
    """Interval deviation and entropy of closed sessions, which no session window can merge.

    State per key: instants not yet behind the watermark (order still open), and for the
    running session its distinct intervals with counts. Instants behind the watermark are
    final, so they are folded in time order and forgotten.
    """
    kinds = {f.name: f.dataType.simpleString() for f in clicks.schema}
    out_schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + INTERVAL_OUTPUT

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        folded, pending, start, last, n, gaps, counts = 0, [], None, None, 0, [], []
        if state.exists:
            folded, pending, start, last, n, gaps, counts = state.get
        tally = dict(zip(gaps, counts))
        pending = list(pending)
        for pdf in batches:
            # instants at or before the last fold are late: their place in the order is gone
            pending.extend(t for t in pdf["us"].tolist() if t > folded)
        mark = state.getCurrentWatermarkMs() * 1000
        rows = []

        def close():
            mean, std, entropy = interval_statistics(np.array(list(tally), dtype=float), np.array(list(tally.values()), dtype=float))
            rows.append((*key, pd.Timestamp(start, unit="us"), pd.Timestamp(last, unit="us"), n, mean, std, entropy))

        pending.sort()
        ready = [t for t in pending if t <= mark]
        pending = pending[len(ready):]
        for t in ready:
            if last is not None and t - last <= gap_us:
                tally[t - last] = tally.get(t - last, 0) + 1
                n += 1
            else:
                if last is not None:
                    close()
                start, n, tally = t, 1, {0: 1}
            last = t
        if last is not None and last + gap_us < mark:
            close()
            start, last, n, tally = None, None, 0, {}
        if pending or last is not None:
            state.update((max(folded, mark), pending, start, last, n, list(tally), list(tally.values())))
            due = pending[0] if pending else last + gap_us
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        names = [*keys, "session_start", "session_end", "click_count", "click_interval_mean", "click_interval_std", "click_interval_entropy"]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    marked = clicks.withWatermark(time, delay).select(*keys, time, F.unix_micros(time).alias("us"))
    return marked.groupBy(*keys).applyInPandasWithState(step, out_schema, INTERVAL_STATE, "append", "EventTimeTimeout")


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Drain the available input into a Parquet table in the shared work folder and read it back.

    ``complete`` results replace the table on every batch; ``append`` uses the file sink,
    whose log makes the output exactly-once.
    """
    spark = stream.sparkSession
    target = path or work_folder(spark, purpose)
    state = f"{target}-state"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
