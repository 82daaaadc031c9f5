"""Sampling of gridded fields at points, by nearest cell or bilinear weights, without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions.lookup import linear_corners, nearest_entry
from thermocline.operators.climatology import field_mean

METHODS = ("nearest", "linear")


def unique_axes(grid: DataFrame, order: str = "source_order", value: str = "sst") -> DataFrame:
    """One value per time and cell where sources share coordinates: the first source's."""
    keys = [c for c in ("time", "latitude", "longitude") if c in grid.columns]
    return grid.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def with_axes(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds the grid's sorted coordinate axes as ``_axes.lat`` and ``_axes.lon``.

    An axis has as many entries as the grid has rows or columns of cells (7,200 for a global 0.05
    degree grid), so it fits a scalar subquery. Pass a static field instead of the full grid when
    there is one.
    """
    axes = grid.agg(
        F.struct(
            F.sort_array(F.collect_set("latitude")).alias("lat"),
            F.sort_array(F.collect_set("longitude")).alias("lon"),
        )
    ).scalar()
    return points.withColumn("_axes", axes)


def axes_of(grid: DataFrame) -> DataFrame:
    """A table with the grid's coordinates, one entry of each axis a row, to be written once where several steps look points up."""
    lat, lon = (F.sort_array(F.collect_set(c)).alias(c) for c in ("latitude", "longitude"))
    return grid.agg(lat, lon).select(F.inline(F.arrays_zip("latitude", "longitude")))


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}. Available: {METHODS}")


def nearest_cells(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds ``_lat`` and ``_lon``, the coordinates of the closest cell."""
    return with_axes(points, grid).withColumns(
        {
            "_lat": nearest_entry(F.col("_axes.lat"), F.col("latitude")),
            "_lon": nearest_entry(F.col("_axes.lon"), F.col("longitude")),
        }
    ).drop("_axes")


def corner_cells(points: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per surrounding cell: ``_lat``, ``_lon``, ``_weight`` and ``_corners``, their number."""
    placed = with_axes(points, grid).withColumns(
        {
            "_lats": linear_corners(F.col("_axes.lat"), F.col("latitude")),
            "_lons": linear_corners(F.col("_axes.lon"), F.col("longitude")),
        }
    )
    placed = placed.withColumn("_corners", F.size("_lats") * F.size("_lons")).drop("_axes")
    # Never empty; the outer form keeps Spark from adding size filters that repeat the lookup.
    placed = placed.withColumn("_a", F.explode_outer("_lats")).withColumn("_b", F.explode_outer("_lons"))
    return placed.withColumns(
        {
            "_lat": F.col("_a.at"),
            "_lon": F.col("_b.at"),
            "_weight": F.col("_a.weight") * F.col("_b.weight"),
        }
    ).drop("_a", "_b", "_lats", "_lons")


def weighted(value: str) -> Column:
    """Bilinear value of grouped corner rows; any missing corner makes it NULL."""
    return F.when(F.count(value) == F.max("_corners"), F.sum(F.col("_weight") * F.col(value)))


def sample_grid(
    points: DataFrame,
    grid: DataFrame,
    method: str = "nearest",
    fill: str | float = "none",
    value: str = "sst",
    into: str | None = None,
) -> DataFrame:
    """Value of a field at each point; for a field with ``time``, at each point and time step.

    The join is on exact cell coordinates and is left to adaptive execution: the field is broadcast
    if its measured size allows, else both sides are shuffled and hot cells are split. A field with
    ``time`` is first cut down to the cells that any point asks for (``wanted_series``), and the points
    meet those by cell, so they are not repeated for all time steps before a join. Every point has a row
    for every time step; points with a NULL coordinate have NULL values. A ``time`` or ``into`` column of the points gives way to the field's.
    """
    check_method(method)
    timed = "time" in grid.columns
    into = into or value
    field = grid.select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        F.col(value).alias("_value"), *(["time"] if timed else []),
    )
    steps_of = ["time"] if timed else []
    points = points.drop(into, *steps_of)

    def at_cells(placed: DataFrame) -> DataFrame:
        if not timed:
            return placed.join(field, ["_lat", "_lon"], "left")
        series = wanted_series(placed, field).withColumnsRenamed({"_lat": "_cell_lat", "_lon": "_cell_lon"})
        same = F.col("_lat").eqNullSafe(F.col("_cell_lat")) & F.col("_lon").eqNullSafe(F.col("_cell_lon"))
        return placed.join(series, same)

    if method == "nearest":
        sampled = at_cells(nearest_cells(points, grid)).withColumnRenamed("_value", into)
        sampled = sampled.select(*points.columns, *steps_of, into)
    else:
        # Weights depend on the position alone, so repeated points share one and every row gets its value.
        spots = points.select(F.col("latitude"), F.col("longitude")).distinct()
        values = at_cells(corner_cells(spots, grid)).groupBy("latitude", "longitude", *steps_of).agg(weighted("_value").alias(into))
        values = values.withColumnsRenamed({"latitude": "_at_lat", "longitude": "_at_lon"})
        same = F.col("latitude").eqNullSafe(F.col("_at_lat")) & F.col("longitude").eqNullSafe(F.col("_at_lon"))
        sampled = points.join(values, same).select(*points.columns, *steps_of, into)
    return fill_samples(sampled, fill, grid, value, into)


def wanted_series(placed: DataFrame, field: DataFrame) -> DataFrame:
    """Every time step of the cells (``_lat``, ``_lon``) that ``placed`` names: ``_value`` is NULL where the field has no row.

    The semi join leaves only rows of wanted cells, so the field itself need not be shuffled when the cells are few, and
    what follows grows with the number of different cells and not with that of points.
    """
    cell = ["_lat", "_lon"]
    wanted = placed.select(*cell).distinct()
    steps = field.agg(F.sort_array(F.collect_set("time"))).scalar()
    asked = wanted.withColumn("_steps", steps).withColumn("time", F.explode("_steps")).drop("_steps")
    return asked.join(field.join(wanted, cell, "left_semi"), [*cell, "time"], "left")


def fill_samples(df: DataFrame, strategy: str | float, grid: DataFrame, value: str = "sst", into: str | None = None) -> DataFrame:
    """Fill missing samples: ``mean`` of the whole field (per time step), ``zero``, a number or ``none``."""
    into = into or value
    if strategy == "none":
        return df
    if strategy == "zero":
        return df.withColumn(into, F.coalesce(into, F.lit(0.0)))
    if isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        return df.withColumn(into, F.coalesce(into, F.lit(float(strategy))))
    if strategy != "mean":
        raise ValueError(f"Unknown fill strategy: {strategy}")
    if "time" not in grid.columns:
        return df.withColumn(into, F.coalesce(into, grid.agg(F.avg(value)).scalar()))
    means = field_mean(grid, value).withColumnRenamed(value, "_mean")
    return df.join(means, "time", "left").withColumn(into, F.coalesce(into, "_mean")).drop("_mean")
