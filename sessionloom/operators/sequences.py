"""Fixed-length sequences as array columns.

Steps beyond the kept length are cut before anything is collected, so one row per session
holds at most ``length`` steps however long the session was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions import columns as C
from sessionloom.plans.chunks import ordered_points
from sessionloom.plans.cuts import take_by_hash
from sessionloom.schema import SEQUENCE_LENGTH, STEP_FEATURES

MOUSE_FEATURES = ["timestamp_delta", "mouse_velocity", "session_progress", "device_entropy", "channel_entropy"]
CLICK_FEATURES = [
    "timestamp_delta", "click_count_window", "session_progress", "click_interval_std", "device_entropy", "channel_entropy",
]


def progress(ordinal: Column, n: Column) -> Column:
    """linspace(0, 1, n) at a 1-based ordinal; a single step is at 0."""
    return F.coalesce(F.try_divide((ordinal - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0))


def mouse_steps(moves: DataFrame, sessions: DataFrame, length: int = SEQUENCE_LENGTH, tie: str | list[str] = "tie") -> DataFrame:
    """First ``length`` steps of traces with at least two points whose session is known."""
    points = ordered_points(moves, "session_id", "movement_index", tie, "x_coordinate", "y_coordinate")
    kept = points.filter((F.col("ordinal") <= length) & (F.col("n") >= 2))
    known = sessions.select("session_id", "label", "device_entropy", "channel_entropy")
    delta = F.coalesce((F.col("movement_index") - F.col("i1")).cast("double"), F.lit(0.0))
    dist = F.coalesce(F.hypot(F.col("x_coordinate") - F.col("x1"), F.col("y_coordinate") - F.col("y1")), F.lit(0.0))
    return kept.join(known, "session_id").select(
        "session_id",
        "label",
        F.lit("mouse-mode").alias("sequence_type"),
        F.col("ordinal").cast("int").alias("step"),
        F.array(
            delta,
            dist / F.greatest(delta + 1.0, F.lit(1.0)),
            progress(F.col("ordinal"), F.col("n")),
            F.col("device_entropy").cast("double"),
            F.col("channel_entropy").cast("double"),
        ).alias("features"),
    )


def click_steps(events: DataFrame, sessions: DataFrame, length: int = SEQUENCE_LENGTH, tie: str = "event_id") -> DataFrame:
    """First ``length`` clicks per known session with pause, rolling count and rolling deviation.

    The row_number filter becomes a map-side group limit; session sizes come from a
    combined count.
    """
    timed = events.dropna(subset=["click_time"]).select("session_id", "click_time", tie)
    sizes = timed.groupBy("session_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("session_id").orderBy("click_time", tie)
    first = timed.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= length)
    known = sessions.select("session_id", "label", "device_entropy", "channel_entropy")
    seq = W.partitionBy("session_id").orderBy("step")
    pause = F.coalesce(C.seconds_between(F.col("click_time"), F.lag("click_time").over(seq)), F.lit(0.0))
    rows = first.withColumn("pause", pause)
    rows = rows.withColumns(
        {
            "rolling_n": F.count("*").over(seq.rowsBetween(-4, 0)).cast("double"),
            "rolling_std": F.coalesce(F.stddev_samp("pause").over(seq.rowsBetween(-4, 0)), F.lit(0.0)),
        }
    )
    return rows.join(sizes, "session_id").join(known, "session_id").select(
        "session_id",
        "label",
        F.lit("click-mode").alias("sequence_type"),
        F.col("step").cast("int").alias("step"),
        F.array(
            F.col("pause"),
            F.col("rolling_n"),
            progress(F.col("step"), F.col("n")),
            F.col("rolling_std"),
            F.col("device_entropy").cast("double"),
            F.col("channel_entropy").cast("double"),
        ).alias("features"),
    )


def gather_steps(steps: DataFrame) -> DataFrame:
    """Long steps to one ordered array of feature arrays per session."""
    rows = F.array_sort(F.collect_list(F.struct("step", "features")))
    return steps.groupBy("session_id", "label", "sequence_type").agg(
        F.transform(rows, lambda r: r["features"]).alias("steps")
    )


def zero_pad(df: DataFrame, length: int, width: int, column: str = "steps") -> DataFrame:
    """Keep the first ``length`` steps and append zero rows up to it."""
    zero = F.array_repeat(F.lit(0.0), width)
    head = F.slice(column, 1, length)
    return df.withColumn(column, F.concat(head, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(column), F.lit(0)))))


def repeat_pad(df: DataFrame, length: int, column: str = "steps") -> DataFrame:
    """Keep the first ``length`` steps and repeat the last one up to it."""
    last = F.element_at(column, -1)
    missing = F.greatest(F.lit(length) - F.size(column), F.lit(0))
    return df.withColumn(column, F.concat(F.slice(column, 1, length), F.array_repeat(last, missing)))


def keep_last_pad(df: DataFrame, length: int, width: int, column: str = "steps") -> DataFrame:
    """Keep the *last* ``length`` steps, zeros after (pre-truncation with post-padding)."""
    start = F.greatest(F.size(column) - length + 1, F.lit(1))
    tail = F.slice(F.col(column), start, F.lit(length))
    zero = F.array_repeat(F.lit(0.0), width)
    return df.withColumn(column, F.concat(tail, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(column), F.lit(0)))))


def mouse_sequences(moves: DataFrame, sessions: DataFrame, length: int = SEQUENCE_LENGTH, tie: str | list[str] = "tie") -> DataFrame:
    return zero_pad(gather_steps(mouse_steps(moves, sessions, length, tie)), length, len(MOUSE_FEATURES))


def click_sequences(events: DataFrame, sessions: DataFrame, length: int = SEQUENCE_LENGTH, tie: str = "event_id") -> DataFrame:
    return zero_pad(gather_steps(click_steps(events, sessions, length, tie)), length, len(CLICK_FEATURES))


def feature_row_sequences(df: DataFrame, features: list[str] | None = None, length: int = 10, order: list[str] | None = None, key: str = "session_id") -> DataFrame:
    """Session feature rows as steps, first ``length`` per session, last row repeated."""
    features = [c for c in (features or STEP_FEATURES) if c in df.columns]
    w = W.partitionBy(key).orderBy(*(order or features))
    rows = df.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= length)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    gathered = F.array_sort(F.collect_list(F.struct("step", vector.alias("features"))))
    seq = rows.groupBy(key).agg(F.transform(gathered, lambda r: r["features"]).alias("steps"))
    return repeat_pad(seq, length)


def key_history_sequences(df: DataFrame, key: str, order: list[str], features: list[str], label: str, length: int = 10) -> DataFrame:
    """Per-key feature and label histories: the last ``length`` rows, zeros after."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= length)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    item = F.struct((-F.col("_back")).alias("o"), vector.alias("f"), F.col(label).cast("double").alias("y"))
    seq = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    out = seq.select(
        key,
        F.transform("_s", lambda r: r["f"]).alias("steps"),
        F.transform("_s", lambda r: F.array(r["y"])).alias("targets"),
    )
    return keep_last_pad(keep_last_pad(out, length, len(features)), length, 1, "targets")


def widen_features(df: DataFrame, width: int, column: str = "steps") -> DataFrame:
    """Zero-fill every step to ``width`` features."""
    return df.withColumn(
        column,
        F.transform(column, lambda s: F.concat(s, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(s), F.lit(0))))),
    )


def combine_modes(*frames: DataFrame, width: int = 6) -> DataFrame:
    """Click-mode and mouse-mode sequences in one frame of equal width."""
    wide = [widen_features(f, width) for f in frames]
    out = wide[0]
    for f in wide[1:]:
        out = out.unionByName(f)
    return out


def sequences_for(sessions: DataFrame, events: DataFrame | None = None, moves: DataFrame | None = None, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Mouse-mode when traces with coordinates are given, otherwise click-mode."""
    if moves is not None and {"x_coordinate", "y_coordinate"} <= set(moves.columns):
        return mouse_sequences(moves, sessions, length)
    if events is None:
        raise ValueError("click-mode sequences need events when coordinates are absent")
    return click_sequences(events, sessions, length)


def fit_step_scaler(df: DataFrame, width: int, column: str = "steps") -> DataFrame:
    """(feature, mean, scale) over all steps, padding included; scale 1 for a constant feature."""
    step = df.select(F.explode(column).alias("s"))
    one = step.agg(
        *[F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("s")[i]).alias(f"d{i}") for i in range(width)],
    )
    cells = [
        F.struct(
            F.lit(i).alias("feature"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"d{i}") > 1e-12, F.col(f"d{i}")).otherwise(1.0).alias("scale"),
        )
        for i in range(width)
    ]
    return one.select(F.inline(F.array(*cells)))


def standardise_steps(df: DataFrame, scaler: DataFrame, column: str = "steps") -> DataFrame:
    """(x - mean) / scale per feature; the scaler is a handful of rows, read as literals."""
    fit = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}

    def scaled(s: Column) -> Column:
        return F.array(*[(s[i] - F.lit(m)) / F.lit(d) for i, (m, d) in sorted(fit.items())])

    return df.withColumn(column, F.transform(column, scaled))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` (a let-binding for array lambdas)."""
    return F.transform(F.array(value), use)[0]


def rolling_entropy(values: Column) -> Column:
    """Histogram entropy of a short array with min(6, max(2, n)) bins."""
    span = F.struct(
        values.alias("v"),
        F.array_min(values).alias("lo"),
        F.array_max(values).alias("hi"),
        F.least(F.lit(6), F.greatest(F.lit(2), F.size(values))).alias("k"),
    )

    def slots(b: Column) -> Column:
        return F.transform(b["v"], lambda v: C.equal_width_bin(v, b["lo"], b["hi"], b["k"]))

    def entropy(found: Column) -> Column:
        share = lambda i: F.size(F.filter(found, lambda s: s == i)) / F.size(found)
        term = lambda p: F.when(p > 0, C.entropy_term(p, F.lit(1.0))).otherwise(0.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda a, i: a + bind(share(i), term))

    return bind(span, lambda b: bind(slots(b), entropy))


def remap_legacy_steps(df: DataFrame, column: str = "steps") -> DataFrame:
    """Legacy steps (x, y, speed, click, scroll, time) to motion steps.

    Output: time difference, speed, heading of the step, click, scroll, rolling entropy of
    the last five speeds. Arrays have fixed length, so everything is a per-row expression.
    """
    speeds = F.transform(column, lambda s: s[2])
    steps = F.col(column)

    def remap(s: Column, i: Column) -> Column:
        prev = F.when(i > 0, F.get(steps, i - 1)).otherwise(s)
        start = F.greatest(i - 3, F.lit(1))
        window = F.slice(F.col("_speeds"), start, i + 2 - start)
        return F.array(s[5] - prev[5], s[2], F.atan2(s[1] - prev[1], s[0] - prev[0]), s[3], s[4], rolling_entropy(window))

    return df.withColumn("_speeds", speeds).withColumn(column, F.transform(column, remap)).drop("_speeds")


def balance_sequences(df: DataFrame, key: str = "session_id") -> DataFrame:
    """Equal class sizes: the minority's size from every class, by keyed hash."""
    sizes = df.groupBy("label").agg(F.count("*").alias("n"))
    target = sizes.agg(F.min("n")).first()[0]
    quota = sizes.select("label", F.lit(target).cast("long").alias("take"))
    return take_by_hash(df, ["label"], quota, key, "sequence")


def explode_steps(df: DataFrame, width: int, column: str = "steps") -> DataFrame:
    """One row per (session, step) with features f0.. ; step from 0."""
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(column).alias("step", "s"))
    return out.select(*rest, "step", *[F.col("s")[i].alias(f"f{i}") for i in range(width)])
