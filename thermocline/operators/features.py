"""Features of a series, from its exploded rows (key, time, sst). Missing values are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.operators.series import _checked, distinct_windows, with_gate, without_cell

FEATURES = ("mean", "std", "min", "max", "median", "p90", "p95", "p99")
EXTENDED = ("trend", "heat_proxy", "longest_run", "recent_change")
WEEK, RUN_OFFSET, SHORTEST_COMPARED = 7, 1.0, 30


def _basic():
    tails = F.percentile("sst", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    return [
        F.avg("sst").alias("mean"), F.stddev_pop("sst").alias("std"), F.min("sst").alias("min"),
        F.max("sst").alias("max"), F.median("sst").alias("median"), tails.alias("_tails"),
        F.count("sst").alias("_n"),
    ]


def _with_tails(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    tails = [F.get("_tails", i).alias(name) for i, name in enumerate(("p90", "p95", "p99"))]
    return df.where("_n > 0").select(*keys, *FEATURES[:5], *tails)


def _indexed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step index, length and mean of each series; a series is bounded by its window."""
    whole = Window.partitionBy(*keys)
    return rows.withColumns(
        {
            "_i": F.row_number().over(whole.orderBy("time")) - 1,
            "_len": F.count("*").over(whole),
            "_mean": F.avg("sst").over(whole),
        }
    )


def longest_run_above(rows: DataFrame, offset: float = RUN_OFFSET, keys: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Longest run of consecutive steps above the series mean plus ``offset``; 0 when there is none."""
    return _runs(_indexed(rows, keys), offset, keys)


def _runs(indexed: DataFrame, offset: float, keys: Sequence[str]) -> DataFrame:
    hot = F.coalesce(F.col("sst") > F.col("_mean") + offset, F.lit(False))
    ordered = Window.partitionBy(*keys).orderBy("_i")
    marked = indexed.withColumn("_hot", hot)
    # Steps of one run share the number of cool steps before them.
    islands = marked.withColumn(
        "_island", F.sum(F.when(F.col("_hot"), 0).otherwise(1)).over(ordered)
    ).groupBy(*keys, "_island").agg(F.sum(F.col("_hot").cast("int")).alias("_run"))
    return islands.groupBy(*keys).agg(F.max("_run").alias("longest_run"))


def extract_features(rows: DataFrame, keys: Sequence[str] = ("obs_id",), extended: bool = False) -> DataFrame:
    """One row per series that has a value: eight statistics, and four more when ``extended``.

    All use the same key, so Spark shuffles the rows once; a series is bounded by its window.
    """
    if not extended:
        return _with_tails(rows.groupBy(*keys).agg(*_basic()), keys)
    indexed = _indexed(rows, keys)
    third = F.floor(F.col("_len") / 3)
    last_third = F.ceil(F.col("_len") / 3)
    stats = indexed.groupBy(*keys).agg(
        *_basic(),
        F.coalesce(F.regr_slope("sst", "_i"), F.lit(0.0)).alias("trend"),
        F.when(
            F.max("_len") >= SHORTEST_COMPARED,
            F.avg(F.when(F.col("_i") >= F.col("_len") - last_third, F.col("sst")))
            - F.avg(F.when(F.col("_i") < third, F.col("sst"))),
        ).otherwise(0.0).alias("recent_change"),
    )
    weeks = (
        indexed.groupBy(*keys, F.floor(F.col("_i") / WEEK).alias("_week"))
        .agg((F.avg("sst") - F.max("_mean")).alias("_over"))
        .groupBy(*keys).agg(F.sum(F.greatest(F.col("_over"), F.lit(0.0))).alias("heat_proxy"))
    )
    joined = stats.join(weeks, list(keys)).join(_runs(indexed, RUN_OFFSET, keys), list(keys))
    tails = [F.get("_tails", i).alias(name) for i, name in enumerate(("p90", "p95", "p99"))]
    return joined.where("_n > 0").select(*keys, *FEATURES[:5], *tails, *EXTENDED)


def observation_features(
    obs: DataFrame, grid: DataFrame, days_before: int = 31, method: str = "nearest",
    key: str = "obs_id", extended: bool = False, truncate_time: bool = False,
    axes: DataFrame | None = None, years_of_tile: DataFrame | None = None,
) -> DataFrame:
    """Features of each observation's window, computed once per distinct place and date.

    ``axes`` and ``years_of_tile`` as in ``series_for``: an observation whose window lacks a year has no row.
    """
    obs = _checked(obs, key)
    open_obs = obs if years_of_tile is None else with_gate(obs, years_of_tile, days_before).where("_open").drop("_open")
    placed, rows, keys = distinct_windows(open_obs, grid, days_before, method, truncate_time, axes)
    features = extract_features(rows, keys, extended)
    names = [*FEATURES, *(EXTENDED if extended else ())]
    return placed.join(features, keys).select(*without_cell(obs), *names)
