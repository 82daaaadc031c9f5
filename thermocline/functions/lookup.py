"""Places in a sorted array column: the nearest-coordinate lookup without a range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermocline.functions.binding import let

Lookup = Callable[[Column, Column], Column]


def _bound(axis: Column, value: Column, body: Lookup) -> Column:
    """``body(axis, value)`` with both written once, whatever they stand for in the caller's plan."""
    return let(F.struct(axis.alias("axis"), value.alias("value")), lambda b: body(b["axis"], b["value"]))


def count_at_most(sorted_array: Column, value: Column) -> Column:
    """How many entries of a sorted array are <= value (NULL for a NULL value)."""
    return _bound(sorted_array, value, _count)


def _count(axis: Column, value: Column) -> Column:
    """The place in an evenly spaced array is tried first; where that misses, a binary search decides."""
    size, first = F.size(axis), F.get(axis, F.lit(0))
    step = F.nullif(F.get(axis, size - 1) - first, F.lit(0.0)) / (size - 1)
    guess = F.greatest(F.lit(0), F.least(F.floor((value - first) / step), (size - 1).cast("bigint"))).cast("int")

    def checked(g: Column) -> Column:
        holds = (F.get(axis, g) <= value) & F.coalesce(F.get(axis, g + 1) > value, F.lit(True))
        return F.when(holds, g + 1).otherwise(_search(axis, value))

    return F.when(value.isNotNull(), F.when(value < first, 0).otherwise(let(guess, checked)))


def _search(axis: Column, value: Column) -> Column:
    def halve(bounds: Column, _: Column) -> Column:
        middle = F.shiftright(bounds["lo"] + bounds["hi"], 1)
        open_, below = bounds["lo"] < bounds["hi"], F.get(axis, middle) <= value
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(bounds["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(bounds["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(axis).alias("hi"))
    halvings = F.ceil(F.log2(F.size(axis) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), halvings), start, halve, lambda bounds: bounds["lo"])


def _around(axis: Column, place: Column, body: Lookup) -> Column:
    """``body`` of two neighbouring entries, the lower one at index ``place``."""

    def at(index: Column) -> Column:
        upper = F.get(axis, F.least(index + 1, F.size(axis) - 1))
        return let(
            F.struct(F.get(axis, index).alias("lower"), upper.alias("upper")), lambda e: body(e["lower"], e["upper"])
        )

    return let(F.greatest(place, F.lit(0)), at)


def nearest_entry(axis: Column, value: Column) -> Column:
    """Closest axis entry; halfway goes to the lower one, outside values to the edge, NULL to NULL."""

    def nearest(a: Column, v: Column) -> Column:
        def closer(lower: Column, upper: Column) -> Column:
            share = (v - lower) / F.nullif(upper - lower, F.lit(0.0))
            return F.when(share > 0.5, upper).otherwise(lower)

        return F.when(v.isNotNull(), _around(a, _count(a, v) - 1, closer))

    return _bound(axis, value, nearest)


def linear_corners(axis: Column, value: Column) -> Column:
    """Array of (entry, weight) for linear interpolation; values outside extrapolate.

    A NULL value gives one corner at NULL, which meets no cell.
    """

    def corner(entry: Column, weight: Column) -> Column:
        return F.struct(entry.alias("at"), weight.alias("weight"))

    def surrounding(a: Column, v: Column) -> Column:
        def corners(lower: Column, upper: Column) -> Column:
            share = (v - lower) / (upper - lower)
            single = F.array(corner(F.when(v.isNotNull(), lower), F.lit(1.0)))
            pair = F.array(corner(lower, 1.0 - share), corner(upper, share))
            return F.when(v.isNotNull() & (upper != lower), pair).otherwise(single)

        return _around(a, F.least(_count(a, v) - 1, F.size(a) - 2), corners)

    return _bound(axis, value, surrounding)
