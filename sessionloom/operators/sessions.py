"""Sessions from click events: cutting, temporal features, event features, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sessionloom.functions import columns as C
from sessionloom.plans.chunks import HOT_ROWS, hot_keys, time_gaps, whole_gaps
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import LABELS, SESSION_GAP_MINUTES

CLICK_KEYS = ("ip", "device", "os")


def sessionize(
    clicks: DataFrame,
    keys: tuple[str, ...] = CLICK_KEYS,
    gap_minutes: float = SESSION_GAP_MINUTES,
    time: str = "click_time",
    tie: str = "event_id",
    prefix: str = "td",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Cut each key's clicks where the pause exceeds the gap (a pause of exactly the gap stays).

    Adds session_gap_sec (gap + 1 s at a key's first click), new_session, session_index,
    session_id and interval_us (0 at a session's first click). Rows without key or time
    are dropped. ``tie`` must tell clicks of one key and instant apart. Keys of up to ``hot_rows`` clicks are ordered whole after one shuffle;
    indexes of hotter keys are found on distinct instants and joined back, so such a key is spread over its instants; see ``plans.chunks``.
    """
    limit_us = int(gap_minutes * 60_000_000)
    rows = clicks.dropna(subset=[*keys, time])
    hot, n = hot_keys(rows, list(keys), hot_rows)
    if hot is None:
        indexed = whole_gaps(rows, list(keys), time, tie, limit_us, n)
    else:
        many = rows.join(F.broadcast(hot), list(keys), "left_semi")
        chunked = many.join(time_gaps(many, list(keys), time, tie, limit_us), [*keys, time])
        indexed = whole_gaps(rows.join(F.broadcast(hot), list(keys), "left_anti"), list(keys), time, tie, limit_us, n).unionByName(chunked)
    first = F.col(tie) == F.col("first_tie")
    opens = first & (F.col("gap_us").isNull() | (F.col("gap_us") > limit_us))
    return indexed.select(
        *rows.columns,
        F.when(first, F.coalesce(F.col("gap_us") / 1e6, F.lit(gap_minutes * 60.0 + 1.0))).otherwise(0.0).alias("session_gap_sec"),
        opens.cast("int").alias("new_session"),
        "session_index",
        C.session_key(prefix, *[F.col(k) for k in keys], F.col("session_index")).alias("session_id"),
        F.when(first & ~opens, F.col("gap_us")).otherwise(0).alias("interval_us"),
    )


def session_aggregate(events: DataFrame, session: str = "session_id", time: str = "click_time") -> DataFrame:
    """Count, start, end and duration (at least one second) per session."""
    span = C.seconds_between(F.max(time), F.min(time))
    return events.groupBy(session).agg(
        F.count("*").alias("event_count"),
        F.min(time).alias("session_start"),
        F.max(time).alias("session_end"),
        C.clip(span, low=1.0).alias("session_duration_sec"),
    )


def value_counts_per_session(events: DataFrame, dims: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, dim, num, txt) with counts and per-value partial aggregates.

    Rows are grouped by session *and value*, so a huge session is reduced to its distinct values before it meets on one key.
    ``keys`` are columns that are the same in all rows of a session: events dealt by them are counted where they lie. Intervals are whole
    microseconds below the gap; distinct ones within a session number at most about the
    square root of twice its length in microseconds.
    """
    kinds = dict(events.dtypes)

    def cell(dim: str):
        text = kinds[dim] == "string"
        return F.struct(
            F.lit(dim).alias("dim"),
            (F.lit(None).cast("long") if text else F.col(dim).cast("long")).alias("num"),
            (F.col(dim) if text else F.lit(None).cast("string")).alias("txt"),
        )

    cells = F.inline(F.array(*[cell(d) for d in ["interval_us", *dims]]))
    ids = [c for c in ("ip", "device", "os") if c in events.columns]
    long = events.select("session_id", "click_time", "is_attributed", *[F.col(i).alias(f"_{i}") for i in ids], cells)
    long = long.filter("num is not null or txt is not null")
    fixed = [f"_{k}" for k in keys]
    return long.groupBy(*fixed, "session_id", "dim", "num", "txt").agg(
        F.count("*").alias("n"),
        F.sum("is_attributed").alias("installs"),
        F.min("click_time").alias("t0"),
        F.max("click_time").alias("t1"),
        *[F.first(f"_{i}", ignorenulls=True).alias(f"_{i}") for i in ids if i not in keys],
    )


def session_temporal_features(
    events: DataFrame, dims: tuple[str, ...] = ("app", "device", "os", "channel"), keys: tuple[str, ...] = ()
) -> DataFrame:
    """The full temporal row per session.

    ``keys`` names those of ip, device and os by which the sessions were cut; every grouping below takes them too, so that events which
    ``sessionize`` dealt by key stay where they are.

    The interval list of a session starts with 0, so its mean is duration / n; its sample
    deviation is NULL for a single click. Modes take the smallest of the most frequent.
    """
    counts = value_counts_per_session(events, list(dims), keys)
    if not keys:
        counts = counts.repartition("session_id")
    kinds = dict(events.dtypes)
    fixed = [f"_{k}" for k in keys]
    w = W.partitionBy(*fixed, "session_id", "dim")
    iv, n, num = F.col("dim") == "interval_us", F.col("n"), F.col("num")
    with_totals = counts.withColumns(
        {
            "total": F.sum("n").over(w),
            "mean": F.sum(n * num).over(w) / F.sum("n").over(w),
            "low": F.min("num").over(w),
            "high": F.max("num").over(w),
        }
    ).withColumns(
        {
            "term": C.entropy_term(n, F.col("total")),
            "bin": F.when(iv, C.equal_width_bin(num, F.col("low"), F.col("high"), 10)),
        }
    )

    def entropy_of(dim):
        return F.coalesce(F.sum(F.when(F.col("dim") == dim, F.col("term"))), F.lit(0.0))

    def mode_of(dim):
        value = F.col("txt") if kinds[dim] == "string" else num
        return F.min(F.when(F.col("dim") == dim, F.struct((-n).alias("c"), value.alias("v")))).getField("v")

    bins = [F.sum(F.when(F.col("bin") == k, n).otherwise(0)).alias(f"_bin{k}") for k in range(10)]
    ids = [c for c in ("ip", "device", "os") if f"_{c}" in counts.columns]
    base = with_totals.groupBy(*fixed, "session_id").agg(
        F.min(F.when(iv, F.col("t0"))).alias("session_start"),
        F.max(F.when(iv, F.col("t1"))).alias("session_end"),
        F.sum(F.when(iv, n)).alias("click_count"),
        F.sum(F.when(iv, F.col("installs"))).alias("install_count"),
        *[F.first(F.col(f"_{i}"), ignorenulls=True).alias(f"original_{i}") for i in ids],
        *[mode_of(d).alias(d) for d in dims],
        *[entropy_of(d).alias(f"{d}_entropy") for d in dims if d in ("device", "channel", "app")],
        (F.max(F.when(iv, F.col("mean"))) / 1e6).alias("click_interval_mean"),
        F.sum(F.when(iv, n * F.pow(num - F.col("mean"), 2))).alias("_ss"),
        (F.percentile(F.when(iv, num), 0.5, F.when(iv, n).otherwise(1)) / 1e6).alias("click_interval_median"),
        *bins,
    )
    count, start, end = F.col("click_count"), F.col("session_start"), F.col("session_end")
    duration = C.clip(C.seconds_between(end, start), low=1.0)
    entropy = C.bin_entropy([F.col(f"_bin{k}") for k in range(10)])
    std = F.when(count > 1, F.sqrt(F.col("_ss") / (count - 1)) / 1e6)
    out = base.withColumns({"session_duration_sec": duration, "click_interval_std": std, "click_interval_entropy": entropy})
    std0 = F.coalesce(F.col("click_interval_std"), F.lit(0.0))
    seconds = F.col("session_duration_sec")
    return out.drop("_ss", *fixed, *[f"_bin{k}" for k in range(10)]).withColumns(
        {
            "total_requests": count,
            "successful_requests": F.col("install_count"),
            "logs_count": count,
            "request_interval_mean": F.coalesce("click_interval_mean", F.lit(0.0)),
            "request_interval_std": std0,
            "request_interval_entropy": F.col("click_interval_entropy"),
            "clicks_per_minute": C.per_minute(count, seconds),
            "requests_per_minute": C.per_minute(count, seconds),
            "session_idle_ratio": C.clip(std0 / (seconds + 1e-6), 0.0, 1.0),
            "activity_date": C.activity_date(start),
            "time_range": C.time_range(start, end),
            "success_rate": C.success_rate(F.col("install_count"), count),
        }
    )


def event_features(clicks: DataFrame, time: str = "click_time", tie: str = "event_id") -> DataFrame:
    """Address and device frequencies, installs, gap to the address's previous click, combo repetition.

    Totals come from one combined count per (ip, device, channel) instead of windows over
    ip or device, whose hottest value may hold most rows; events meet the totals in a
    plain join that AQE can split.
    """
    rows = clicks.dropna(subset=["ip", time]).withColumns(C.calendar_parts(F.col(time)))
    combo = ["ip", "device", "channel"]
    combos = rows.groupBy(*combo).agg(F.count("*").alias("combo_n"), F.sum("is_attributed").alias("combo_i"))
    per_ip = combos.groupBy("ip").agg(
        F.sum("combo_n").alias("ip_click_frequency"), F.sum("combo_i").alias("ip_install_count")
    )
    per_device = combos.groupBy("device").agg(
        F.sum("combo_n").alias("device_click_frequency"), F.sum("combo_i").alias("device_install_count")
    )
    totals = combos.join(per_ip, "ip").join(per_device, "device").drop("combo_i")
    gaps = time_gaps(rows, ["ip"], time, tie)
    gap = F.when(F.col(tie) == F.col("first_tie"), F.coalesce(F.col("gap_us"), F.lit(0))).otherwise(0) / 1e6
    ip_n = F.greatest("ip_click_frequency", F.lit(1))
    repeat = F.col("combo_n") / ip_n
    return (
        rows.join(totals, combo)
        .join(gaps, ["ip", time])
        .select(
            *rows.columns,
            "ip_click_frequency",
            "device_click_frequency",
            "ip_install_count",
            "device_install_count",
            (F.col("ip_install_count") / ip_n).alias("ip_install_rate"),
            gap.alias("ip_time_gap_sec"),
            repeat.alias("combo_repeat_rate"),
            (1.0 - F.least(repeat, F.lit(1.0))).alias("non_repetitive_combo_score"),
        )
    )


def label_events(features: DataFrame, exact: bool = True) -> DataFrame:
    """Flag a click as bot-like by high frequency without installs at short gaps or low diversity."""
    cuts = quantiles(
        features,
        ["ip_click_frequency", "device_click_frequency", "ip_time_gap_sec", "non_repetitive_combo_score"],
        [0.05, 0.10, 0.99],
        exact=exact,
    )
    hi_ip, hi_device = cuts["ip_click_frequency"][2], cuts["device_click_frequency"][2]
    low_gap = max(0.5, cuts["ip_time_gap_sec"][0] or 0.0)
    low_diversity = cuts["non_repetitive_combo_score"][1]
    busy_ip = (F.col("ip_click_frequency") >= hi_ip) & (F.col("ip_install_count") == 0) & (F.col("ip_time_gap_sec") <= low_gap)
    busy_device = (
        (F.col("device_click_frequency") >= hi_device)
        & (F.col("device_install_count") == 0)
        & (F.col("non_repetitive_combo_score") < low_diversity)
    )
    bot = (F.col("is_attributed") == 0) & (busy_ip | busy_device)
    return features.withColumns(
        {
            "human_heuristic": (~bot).cast("int"),
            "possible_bot_heuristic": bot.cast("int"),
            "label": bot.cast("int"),
            "behavior_class": F.when(bot, "possible_bot").otherwise("human"),
        }
    )


def session_context(events: DataFrame) -> DataFrame:
    """Frequency and heuristic context of labelled events per session, calendar of the first click."""
    first = F.min(F.struct("click_time", "event_id", "year", "month", "day", "hour", "minute", "second"))
    out = events.groupBy("session_id").agg(
        F.max("ip_click_frequency").alias("ip_click_frequency"),
        F.max("device_click_frequency").alias("device_click_frequency"),
        F.max("ip_install_rate").alias("ip_install_rate"),
        F.avg("combo_repeat_rate").alias("combo_repeat_rate"),
        F.avg("human_heuristic").alias("human_event_ratio"),
        F.avg("possible_bot_heuristic").alias("possible_bot_ratio"),
        first.alias("_first"),
    )
    parts = ["year", "month", "day", "hour", "minute", "second"]
    return out.select(*[c for c in out.columns if c != "_first"], *[F.col(f"_first.{p}").alias(p) for p in parts])


def session_rollup_with_context(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Temporal row joined with event context; interval deviation is 0 for one click here."""
    temporal = session_temporal_features(events, keys=keys).drop(
        "click_interval_median", "click_interval_entropy", "request_interval_entropy", "session_idle_ratio"
    )
    out = temporal.join(session_context(events), "session_id")
    return out.withColumns(
        {
            "data_source": F.lit("talkingdata"),
            "click_interval_mean": F.coalesce("click_interval_mean", F.lit(0.0)),
            "click_interval_std": F.coalesce("click_interval_std", F.lit(0.0)),
            "total_response_size": F.lit(None).cast("double"),
            "avg_response_size": F.lit(None).cast("double"),
        }
    )


def label_sessions_by_ratio(sessions: DataFrame, strict: bool = False, exact: bool = True) -> DataFrame:
    """Bot when half the clicks are flagged, or at the top 1 % of request rate without an install.

    The rate test is ``>=``: when one-click sessions (60 per minute) are that common, all of
    them reach the 99th percentile. ``strict=True`` uses ``>``.
    """
    top = quantiles(sessions, ["requests_per_minute"], [0.99], exact=exact)["requests_per_minute"][0]
    rate = F.col("requests_per_minute")
    fast = ((rate > top) if strict else (rate >= top)) & (F.col("install_count") == 0)
    bot = ((F.col("possible_bot_ratio") >= 0.5) | fast) & ~(F.col("install_count") > 0)
    return sessions.withColumns(
        {
            "label": bot.cast("int"),
            "bot_type": F.when(bot, "talkingdata_possible_bot").otherwise("talkingdata_human"),
        }
    )


def label_sessions_by_install(sessions: DataFrame) -> DataFrame:
    """Human only with install evidence, otherwise unknown (NULL label)."""
    human = F.coalesce(F.col("install_count"), F.lit(0)) > 0
    label = F.when(human, LABELS["human"])
    return sessions.withColumns(
        {
            "label": label.cast("int"),
            "candidate_human": human,
            "bot_type": F.when(human, "human").otherwise("unknown"),
        }
    )


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(true rows, other rows); NULL counts as false."""
    yes = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(yes), df.filter(~yes)
