"""Monthly means, the regressed climatology and the warmest month of each cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Years whose mean is the climatology's reference point (1988.2857).
REFERENCE_YEARS = (1985, 1986, 1987, 1988, 1989, 1990, 1993)
BASE_PERIOD = (1985, 2012)
CELL = ("latitude", "longitude")


def epoch_midpoint(years: Sequence[int] = REFERENCE_YEARS) -> float:
    return sum(years) / len(years)


def monthly_means(grid: DataFrame, keys: Sequence[str] = CELL, densify: bool = False) -> DataFrame:
    """Mean of the daily values per cell and calendar month, labelled by the month's last day.

    ``densify`` adds a row with a NULL mean for each month of the grid's span that a cell lacks.
    """
    means = grid.groupBy(*keys, F.last_day("time").alias("month_end")).agg(F.avg("sst").alias("sst"))
    if densify:
        span = means.agg(
            F.sequence(F.trunc(F.min("month_end"), "MM"), F.max("month_end"), F.expr("INTERVAL 1 MONTH"))
        ).scalar()
        frame = means.select(*keys).distinct().withColumn("_span", span)
        frame = frame.select(*keys, F.explode("_span").alias("_start"))
        frame = frame.select(*keys, F.last_day("_start").alias("month_end"))
        means = frame.join(means, [*keys, "month_end"], "left")
    return means.withColumns({"year": F.year("month_end"), "month": F.month("month_end")})


def monthly_climatology(grid: DataFrame, y0: int, y1: int, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean of all daily values of a month of the year between two years."""
    inside = grid.where(F.year("time").between(y0, y1))
    return inside.groupBy(*keys, F.month("time").alias("month")).agg(F.avg("sst").alias("sst"))


def regress_climatology(monthly: DataFrame, nan_policy: str = "pairwise", keys: Sequence[str] = CELL) -> DataFrame:
    """Line of monthly mean on year, per cell and month of the year.

    ``pairwise`` uses the years a cell has. ``reference`` takes the mean and variance of the year
    over every year on the month's axis, also where the cell has no value.
    """
    by = [*keys, "month"]
    if nan_policy == "pairwise":
        return monthly.groupBy(*by).agg(
            F.regr_slope("sst", "year").alias("slope"), F.regr_intercept("sst", "year").alias("intercept")
        )
    if nan_policy != "reference":
        raise ValueError(f"Unknown nan_policy: {nan_policy}")
    axis = (
        monthly.select("month", "year").distinct().groupBy("month")
        .agg(F.avg("year").alias("_mean_year"), F.var_pop("year").alias("_var_year"))
    )
    moments = monthly.groupBy(*by).agg(
        F.covar_pop("year", "sst").alias("_cov"), F.avg("sst").alias("_mean_sst")
    )
    # The axis has one row for each of the 12 months.
    joined = moments.join(F.broadcast(axis), "month")
    slope = F.try_divide(F.col("_cov"), F.col("_var_year"))
    return joined.select(
        *by, slope.alias("slope"), (F.col("_mean_sst") - slope * F.col("_mean_year")).alias("intercept")
    )


def predict_climatology(lines: DataFrame, x: float) -> DataFrame:
    return lines.withColumn("prediction", F.col("intercept") + F.col("slope") * F.lit(float(x)))


def static_fields(climatology: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Maximum monthly mean and the month it falls in, one row per cell; ties go to the later month."""
    best = F.max(
        F.when(F.col("prediction").isNotNull(), F.struct("prediction", "month"))
    )
    return (
        climatology.groupBy(*keys).agg(best.alias("_best"))
        .select(*keys, F.col("_best.prediction").alias("mmm"), F.col("_best.month").alias("month_of_mmm"))
    )


def mmm(climatology: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return static_fields(climatology, keys).select(*keys, "mmm")


def month_of_mmm(climatology: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return static_fields(climatology, keys).select(*keys, "month_of_mmm")


def field_mean(grid: DataFrame, value: str = "sst") -> DataFrame:
    return grid.groupBy("time").agg(F.avg(value).alias(value))
