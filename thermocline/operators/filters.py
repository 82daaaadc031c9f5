"""Row predicates and labels for observations, grids and series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Case-study box (degrees).
CASE_STUDY_LONS, CASE_STUDY_LATS = (140.0, 150.0), (-20.0, -10.0)


def drop_missing_keys(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["month", "year", "latitude", "longitude"])


def drop_missing_target(df: DataFrame) -> DataFrame:
    return df.where(F.col("mean_percent_bleached").isNotNull())


def max_year(df: DataFrame, year: int = 2017) -> DataFrame:
    return df.where(F.col("year") <= year)


def drop_missing_mmm(df: DataFrame) -> DataFrame:
    return df.where(F.col("mmm_i").isNotNull())


def drop_uncertain(df: DataFrame) -> DataFrame:
    """Drop rows whose range straddles the limits; rows with missing bounds stay."""
    straddles = (F.col("max_percent_bleached") > 10) & (F.col("min_percent_bleached") < 20)
    return df.where(~F.coalesce(straddles, F.lit(False)))


def in_exposure_period(df: DataFrame, before: int = 1, after: int = 3, wrap: bool = False) -> DataFrame:
    """Months from ``before`` ahead of the warmest month to ``after`` behind it.

    The plain rule does not pass the year end; ``wrap`` counts months around it.
    """
    if wrap:
        offset = F.pmod(F.col("month") - F.col("mmm_i") + before, F.lit(12))
        return df.where(offset <= before + after)
    return df.where(F.col("month").between(F.col("mmm_i") - before, F.col("mmm_i") + after))


def _period(text: str) -> tuple[str, str | None]:
    """First instant of a bound and the unit it covers; none for an instant."""
    for pattern, rest, unit in ((r"\d{4}", "-01-01", "YEAR"), (r"\d{4}-\d{2}", "-01", "MONTH"), (r"\d{4}-\d{2}-\d{2}", "", "DAY")):
        if re.fullmatch(pattern, text):
            return text + rest, unit
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?", text):
        return text, None
    raise ValueError(f"Not a year, month, day or instant: {text}")


def time_slice(df: DataFrame, lo: str, hi: str, column: str = "time") -> DataFrame:
    """Inclusive slice. A bound given as a year, a month or a day covers the whole of it; other bounds are instants."""
    (start, _), (end, length) = _period(lo), _period(hi)
    kept = df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(start)))
    last = F.to_timestamp_ntz(F.lit(end))
    if length is None:
        return kept.where(F.col(column) <= last)
    return kept.where(F.col(column) < last + F.expr(f"INTERVAL 1 {length}"))


def bbox(df: DataFrame, lats: Sequence[float], lons: Sequence[float]) -> DataFrame:
    return df.where(F.col("latitude").between(*lats) & F.col("longitude").between(*lons))


def case_study_area(df: DataFrame) -> DataFrame:
    return bbox(df, CASE_STUDY_LATS, CASE_STUDY_LONS)


def exclude_regions(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Rows of other regions, and those without one."""
    return df.where(~F.coalesce(F.col("region").isin(*codes), F.lit(False)))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["latitude", "longitude", "date", "bleach_presence"])


def with_presence(df: DataFrame, threshold: float = 20) -> DataFrame:
    certain = F.coalesce(F.col("min_percent_bleached") >= threshold, F.lit(False))
    return df.withColumn("bleach_presence", F.when(certain, 1).otherwise(0))


def drop_empty_series(df: DataFrame, column: str = "series", value: str = "sst") -> DataFrame:
    """Keep rows whose series array has at least one value."""
    return df.where(F.exists(F.col(column), lambda step: step[value].isNotNull()))
