"""Regular-expression spans with code-point positions, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches, as (kind, start, end, value) structs in order.

    A match starts where the pieces between matches and the earlier matches end, so positions follow from two scans of the text
    and a running sum over its matches. Null for a null text.
    """
    between, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda b, v: F.struct(F.char_length(b).alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(held: Column, piece: Column) -> Column:
        begin = held["at"] + piece["gap"]
        end = begin + F.char_length(piece["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(held["out"], span).alias("out"))

    found = F.aggregate(pieces, start, step, lambda held: held["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def listed(found: Column, names: list[str]) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def apart(one: Column, many: Column) -> Column:
    """Whether a span overlaps none of the others."""
    return ~F.exists(many, lambda s: (s["start"] < one["end"]) & (one["start"] < s["end"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def kept(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda s: test(s["value"]))
