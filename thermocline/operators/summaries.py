"""Counts, bounds, histograms and the year filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def years_with_enough(df: DataFrame, threshold: int = 100) -> DataFrame:
    """Rows of the latest years, back to (not including) the last one with fewer than ``threshold`` rows.

    Years without any row are not failures. The cut is a scalar subquery over the counts per year.
    """
    counts = df.groupBy("year").agg(F.count("*").alias("n"))
    cut = counts.agg(F.max(F.when(F.col("n") < threshold, F.col("year")))).scalar()
    return df.where(F.col("year").isNotNull() & (cut.isNull() | (F.col("year") > cut)))


def bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def class_counts(df: DataFrame, label: str = "bleach_presence") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins over the data range, the last one closed; empty bins count 0."""
    extent = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    valued = df.where(F.col(column).isNotNull()).withColumn("_extent", extent)
    flat = F.col("_extent.lo") == F.col("_extent.hi")
    lo = F.when(flat, F.col("_extent.lo") - 0.5).otherwise(F.col("_extent.lo")).cast("double")
    hi = F.when(flat, F.col("_extent.hi") + 0.5).otherwise(F.col("_extent.hi")).cast("double")
    width = (hi - lo) / bins
    placed = valued.select(
        F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("_bin"), lo.alias("_lo"), width.alias("_w")
    )
    counted = placed.agg(
        F.min("_lo").alias("_lo"), F.min("_w").alias("_w"),
        F.array(*[F.count_if(F.col("_bin") == i) for i in range(bins)]).alias("_counts"),
    )
    return counted.select("_lo", "_w", F.posexplode("_counts").alias("bin", "n")).select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"), "n",
    )


def distinct_years(df: DataFrame, column: str = "time") -> DataFrame:
    return df.select(F.year(column).alias("year")).distinct()


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tiles, years or files by column name; columns a source lacks become NULL."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united
