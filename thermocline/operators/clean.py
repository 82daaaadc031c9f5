"""Cleaning of observation frames and the registry of named column cleaners."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.functions import parsing
from thermocline.functions.missing import without_nan

# Names of the built-in cleaners.
_CLEANERS: dict[str, Callable[[Column], Column]] = {
    "float_with_ranges": parsing.parse_range,
    "depth": parsing.parse_depth,
    "percentage": parsing.parse_percentage,
}


def cleaners() -> list[str]:
    return list(_CLEANERS)


def register_cleaner(name: str, fn: Callable, value_type: str | None = None) -> None:
    """Add a cleaner. ``fn`` maps Column to Column; with ``value_type`` (a Spark type string) it maps
    one Python value to another and runs as a vectorised function over Arrow batches."""
    if value_type is None:
        _CLEANERS[name] = fn
        return

    @F.pandas_udf(value_type)
    def over_values(values: pd.Series) -> pd.Series:
        return values.map(fn)

    _CLEANERS[name] = over_values


def apply_cleaner(df: DataFrame, column: str, name: str, into: str | None = None) -> DataFrame:
    if name not in _CLEANERS:
        raise ValueError(f"Unknown cleaner: {name}. Available: {cleaners()}")
    return df.withColumn(into or column, _CLEANERS[name](F.col(column)))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def with_year_date(df: DataFrame, use_month: bool = False) -> DataFrame:
    """``date`` = 1 January of ``year``, or the first of ``month`` when asked."""
    month = F.col("month").cast("int") if use_month else F.lit(1)
    return df.withColumn("date", F.make_date(F.col("year").cast("int"), month, F.lit(1)))


def _range_of(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return parsing.parse_range(F.col(column))
    return parsing.number_range(F.col(column))


def _with_percentage(df: DataFrame, column: str) -> DataFrame:
    pair = F.col("_pair")
    return (
        df.withColumn("_pair", parsing.with_mean(parsing.clamp_percentage(_range_of(df, column))))
        .withColumns(
            {f"min_{column}": pair["min"], f"max_{column}": pair["max"], f"mean_{column}": pair["mean"]}
        )
        .drop("_pair")
    )


def _with_depth(df: DataFrame) -> DataFrame:
    if isinstance(df.schema["depth"].dataType, T.StringType):
        parsed = parsing.parse_depth(F.col("depth"))
    else:
        parsed = parsing.with_mean(parsing.number_range(F.col("depth")))
    metres = F.col("_metres")
    return (
        df.withColumn("_metres", parsed)
        .withColumns({"min_depth": metres["min"], "max_depth": metres["max"], "depth": metres["mean"]})
        .drop("_metres")
    )


def clean_observations(df: DataFrame, use_month: bool = False) -> DataFrame:
    """Lower-case names, add ``date``, and parse the dirty columns that are present."""
    cleaned = with_year_date(without_nan(lower_columns(df)), use_month)
    for column in ("percent_bleached", "percent_mortality"):
        if column in cleaned.columns:
            cleaned = _with_percentage(cleaned, column)
    return _with_depth(cleaned) if "depth" in cleaned.columns else cleaned
