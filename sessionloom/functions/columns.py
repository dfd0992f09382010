"""Scalar column functions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTROPY_EPSILON = 1e-12


def null_if_nan(c: Column) -> Column:
    """Missing is NULL, never NaN: in Spark NaN sorts above every number and NaN > x is true."""
    return F.when(~F.isnan(c), c)


def null_if_infinite(c: Column) -> Column:
    return F.when(F.abs(c) != F.lit(math.inf), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; NULL stays NULL (bare greatest/least would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
    }


def activity_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_range(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "HH:mm:ss"), F.lit("-"), F.date_format(end, "HH:mm:ss"))


def parse_access_log_time(text: Column) -> Column:
    """``[29/Oct/2019:16:23:01 +0000]`` to a timestamp, NULL when unreadable; the offset is cut off."""
    inner = F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", "")
    return F.try_to_timestamp(F.trim(F.split_part(inner, F.lit("+"), F.lit(1))), F.lit("dd/MMM/yyyy:HH:mm:ss"))


def parse_session_start(date_text: Column, range_text: Column) -> Column:
    """``29/Oct/2019`` with ``16:23:01-16:25:00`` to the start timestamp."""
    joined = F.concat_ws(" ", date_text, F.split(range_text, "-").getItem(0))
    return F.try_to_timestamp(joined, F.lit("dd/MMM/yyyy HH:mm:ss"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(micros(ts) + (seconds * 1e6).cast("long"))


def category_label(category: Column) -> Column:
    """Category text to class code; ``advanced`` beats ``moderate`` beats ``human``."""
    text = F.lower(F.trim(category.cast("string")))
    return (
        F.when(text.contains("advanced"), 2)
        .when(text.contains("moderate"), 1)
        .when(text.contains("human"), 0)
        .otherwise(text.try_cast("int"))
    )


def recode(c: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup as one CASE."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def session_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def per_minute(count: Column, seconds: Column) -> Column:
    return count / (seconds / 60.0)


def success_rate(successes: Column, requests: Column) -> Column:
    return successes / F.greatest(requests, F.lit(1))


def burstiness(interval_std: Column, interval_mean: Column) -> Column:
    s, m = F.coalesce(interval_std, F.lit(0.0)), F.coalesce(interval_mean, F.lit(0.0))
    return (s - m) / (s + m + 1e-9)


# --- keyed randomness ------------------------------------------------------------------
# Every draw is a hash of (row key, salt): the same row gets the same draw whatever the
# partitioning, and a lost task recomputes the same values.


def stable_fraction(text: Column) -> Column:
    """First 48 bits of sha-256 as a fraction in [0, 1)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(16**12)


def uniform(key: Column, salt: str) -> Column:
    return stable_fraction(F.concat(key.cast("string"), F.lit("|" + salt)))


def standard_normal(key: Column, salt: str) -> Column:
    """Box-Muller over two keyed uniforms."""
    radius = F.sqrt(-2.0 * F.log(F.greatest(uniform(key, salt + ":a"), F.lit(1e-12))))
    return radius * F.cos(2.0 * math.pi * uniform(key, salt + ":b"))


def cumulative(weights: dict[str, float]) -> list[tuple[str, float]]:
    """(value, upper threshold) pairs of the normalised weights."""
    total, running, out = sum(weights.values()), 0.0, []
    for value, weight in weights.items():
        running += weight
        out.append((value, round(running / total, 12)))
    return out


def weighted_choice(draw: Column, weights: dict[str, float]) -> Column:
    """Pick a value by a uniform draw against cumulative thresholds."""
    pairs = cumulative(weights)
    out = None
    for value, upper in pairs[:-1]:
        out = F.when(draw < upper, value) if out is None else out.when(draw < upper, value)
    return F.lit(pairs[-1][0]) if out is None else out.otherwise(pairs[-1][0])


def pick(values: list, draw: Column) -> Column:
    """Element of a fixed list by a uniform draw."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw * len(values)) + 1).cast("int"))


# --- distributions ---------------------------------------------------------------------


def entropy_term(count: Column, total: Column) -> Column:
    """One value's share of a Shannon entropy; summed over the values it gives the entropy."""
    p = count / total
    return -(p * F.log2(p + ENTROPY_EPSILON))


def equal_width_bin(x: Column, low: Column, high: Column, bins: Column | int) -> Column:
    """Histogram bin index; one bin when all values are equal, last bin closed."""
    n = F.lit(bins) if isinstance(bins, int) else bins
    share = (x - low) / F.nullif(high - low, F.lit(0))
    return F.when(high == low, 0).otherwise(F.least(F.floor(share * n), (n - 1).cast("long"))).cast("int")


def bin_entropy(counts: list[Column]) -> Column:
    """Entropy of a handful of bin counts held as columns."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, entropy_term(c, total)).otherwise(0.0) for c in counts]
    return sum(terms[1:], terms[0])


def correlation(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r as an aggregate; NULL for a constant column."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
