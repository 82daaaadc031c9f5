"""Messy number, percentage and depth text as structs of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermocline.functions.binding import let
from thermocline.functions.missing import nan_to_null

# Accepted number text, metres per foot, severity limits in percent.
NUMBER = r"^\s*\+?(\d+\.?\d*|\.\d+)([eE]\+?\d+)?\s*$"
METRES_PER_FOOT = 0.3048
UNCERTAIN_FROM, HIGH_FROM, PERCENT_MAX = 10.0, 20.0, 100.0


def to_number(text: Column) -> Column:
    """Double for number text, else NULL (the guard rejects forms like ``5d`` that a cast takes)."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _struct_of(ends: Column) -> Column:
    """Struct(min, max) from an array of two numbers; one missing end makes both NULL."""

    def pair(e: Column) -> Column:
        whole = F.get(e, 0).isNotNull() & F.get(e, 1).isNotNull()
        return F.struct(F.when(whole, F.get(e, 0)).alias("min"), F.when(whole, F.get(e, 1)).alias("max"))

    return let(ends, pair)


def _ends(text: Column) -> Column:
    """Both ends of number-or-range text as an array."""

    def ends(t: Column) -> Column:
        pieces = F.transform(
            F.slice(F.split(t, "-"), 1, 2), lambda piece: to_number(F.replace(piece, F.lit("%"), F.lit("")))
        )
        return F.when(F.contains(t, F.lit("-")), pieces).otherwise(
            F.array_repeat(to_number(F.split_part(t, F.lit("%"), F.lit(1))), 2)
        )

    return let(text, ends)


def number_range(col: Column) -> Column:
    """(x, x) for a column that already holds numbers."""
    return _struct_of(F.array_repeat(nan_to_null(col.cast("double")), 2))


def parse_range(text: Column) -> Column:
    """``10-20`` gives (10, 20), ``12%`` gives (12, 12); text that does not parse gives a NULL pair."""
    return _struct_of(_ends(text))


def clamp_percentage(pair: Column) -> Column:
    def clamped(p: Column) -> Column:
        return F.struct(
            *[
                F.when(p[end].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(PERCENT_MAX), p[end]))).alias(end)
                for end in ("min", "max")
            ]
        )

    return let(pair, clamped)


def parse_percentage(text: Column) -> Column:
    return clamp_percentage(parse_range(text))


def range_mean(pair: Column) -> Column:
    return (pair["min"] + pair["max"]) / 2.0


def with_mean(pair: Column) -> Column:
    """Struct of min, max and mean."""
    return let(pair, lambda p: F.struct(p["min"].alias("min"), p["max"].alias("max"), range_mean(p).alias("mean")))


def parse_depth(text: Column) -> Column:
    """Depth text to metres: struct of min, max and mean."""

    def feet(t: Column) -> Column:
        numbers = F.regexp_extract_all(t, F.lit(r"([\d.]+)"), 1)
        metres = F.transform(numbers, lambda n: to_number(n) * METRES_PER_FOOT)
        return let(
            metres,
            lambda m: F.when(F.size(m) == 1, F.array_repeat(F.get(m, 0), 2)).when(F.size(m) == 2, m),
        )

    def ends(t: Column) -> Column:
        plain = F.replace(F.replace(t, F.lit("m"), F.lit("")), F.lit("ð"), F.lit("-"))
        return F.when(F.contains(t, F.lit("ft")), feet(t)).otherwise(_ends(plain))

    return with_mean(_struct_of(let(F.regexp_replace(F.lower(text), r"[+<>]", ""), ends)))


def severity_band(percent: Column) -> Column:
    return (
        F.when((percent >= 0.0) & (percent < UNCERTAIN_FROM), "low")
        .when((percent >= UNCERTAIN_FROM) & (percent < HIGH_FROM), "uncertain")
        .when((percent >= HIGH_FROM) & (percent <= PERCENT_MAX), "high")
    )
