"""Daily series in the window before each observation, and steps along a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.dates import month_number
from thermocline.functions.missing import require_columns
from thermocline.operators.ordered import with_lead_in, with_position
from thermocline.operators.sampling import check_method, corner_cells, nearest_cells, weighted

ROLLING_WINDOWS = (30, 90, 180)
_CELL = ("_lat", "_lon")
_PLACE = (*_CELL, "date")


def _checked(obs: DataFrame, key: str) -> DataFrame:
    require_columns(obs, key, "latitude", "longitude", "date")
    bad = F.raise_error(F.lit("Some 'date' values could not be parsed.")).cast("date")
    return obs.withColumn("date", F.when(F.col("date").isNull(), bad).otherwise(F.to_date("date")))


def _window_rows(
    places: DataFrame, grid: DataFrame, days_before: int, truncate_time: bool, carried: Sequence[str] = ()
) -> DataFrame:
    """Grid rows of each distinct (cell, date): an equi-join on cell, year and month, then the exact days."""
    opens = F.date_sub("date", days_before)
    months = F.sequence(month_number(opens), month_number(F.col("date")))
    asked = places.withColumn("_month", F.explode(months)).withColumn(
        "_year", F.floor(F.col("_month") / 12).cast("int")
    )
    # ``year`` is the partition column of a stored grid; joining on it lets Spark prune partitions.
    year = F.col("year").cast("int") if "year" in grid.columns else F.year("time")
    cells = grid.select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), year.alias("_year"),
        month_number(F.col("time")).alias("_month"), "time", "sst",
    )
    moment = F.to_date("time").cast("timestamp_ntz") if truncate_time else F.col("time")
    inside = moment.between(opens.cast("timestamp_ntz"), F.col("date").cast("timestamp_ntz"))
    joined = asked.join(cells, ["_lat", "_lon", "_year", "_month"]).where(inside)
    return joined.select(*places.columns, *carried, "time", "sst")


def without_cell(obs: DataFrame) -> list[str]:
    """The columns of observations but those of ``nearest_cells``."""
    return [c for c in obs.columns if c not in _CELL]


def distinct_windows(
    obs: DataFrame, grid: DataFrame, days_before: int = 31, method: str = "nearest", truncate_time: bool = False,
    axes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Observations with a place, the series rows of each distinct place and date, and their shared keys.

    Many observations share a cell and a date; their series is built once. ``axes`` is any table with the grid's
    coordinates, such as a static field: without it the coordinates are read from all of the grid. Rows whose ``_open`` is
    false get no series. Observations that bring the ``_lat`` and ``_lon`` of ``nearest_cells`` are not looked up again.
    """
    check_method(method)
    lattice = grid if axes is None else axes

    def asked(placed: DataFrame, keys: list[str]) -> DataFrame:
        return (placed.where("_open") if "_open" in placed.columns else placed).select(*keys).distinct()

    if method == "nearest":
        placed = obs if set(_CELL) <= set(obs.columns) else nearest_cells(obs, lattice)
        keys = list(_PLACE)
        return placed, _window_rows(asked(placed, keys), grid, days_before, truncate_time), keys
    placed = obs.withColumns({"_at_lat": F.col("latitude"), "_at_lon": F.col("longitude")})
    keys = ["_at_lat", "_at_lon", "date"]
    points = asked(placed, keys).withColumns({"latitude": F.col("_at_lat"), "longitude": F.col("_at_lon")})
    corners = corner_cells(points, lattice).drop("latitude", "longitude")
    rows = _window_rows(corners, grid, days_before, truncate_time)
    rows = rows.groupBy(*keys, "time").agg(weighted("sst").alias("sst"))
    return placed, rows, keys


def series_rows(
    obs: DataFrame, grid: DataFrame, days_before: int = 31, method: str = "nearest",
    key: str = "obs_id", truncate_time: bool = False, axes: DataFrame | None = None,
) -> DataFrame:
    """Exploded series (key, time, sst): days from midnight(date) - N to midnight(date), inclusive."""
    placed, rows, keys = distinct_windows(_checked(obs, key), grid, days_before, method, truncate_time, axes)
    return placed.select(key, *keys).join(rows, keys).select(key, "time", "sst")


def series_for(
    obs: DataFrame, grid: DataFrame, days_before: int = 31, method: str = "nearest",
    key: str = "obs_id", truncate_time: bool = False, value_transform: Callable[[Column], Column] | None = None,
    axes: DataFrame | None = None, years_of_tile: DataFrame | None = None,
) -> DataFrame:
    """Observations with ``series``, an array of (time, sst) in time order; NULL where the grid has none.

    A series has at most one entry per day of its window, so the array is bounded by ``days_before``.
    ``value_transform`` maps the array column to another. With ``years_of_tile`` (see ``window_availability``), a window
    that touches a year its tile lacks has a NULL series instead of a partial one.
    """
    obs = _checked(obs, key)
    gated = obs if years_of_tile is None else with_gate(obs, years_of_tile, days_before)
    placed, rows, keys = distinct_windows(gated, grid, days_before, method, truncate_time, axes)
    arrays = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("time", "sst"))).alias("series"))
    if value_transform is not None:
        arrays = arrays.withColumn("series", value_transform(F.col("series")))
    joined = placed.join(arrays, keys, "left")
    if years_of_tile is not None:
        joined = joined.withColumn("series", F.when(F.col("_open"), F.col("series")))
    return joined.select(*without_cell(obs), "series")


def window_availability(
    obs: DataFrame, years_of_tile: DataFrame, days_before: int = 31, key: str = "obs_id"
) -> DataFrame:
    """Years a window touches that its tile lacks. ``obs`` carries ``patch``; a tile has few years."""
    have = years_of_tile.select("patch", F.transform("available_years", lambda y: y.cast("int")).alias("_have"))
    needed = F.sequence(F.year(F.date_sub("date", days_before)), F.year("date"))
    missing = F.array_sort(F.array_except(needed, F.coalesce("_have", F.array().cast("array<int>"))))
    return (
        obs.join(have, "patch", "left")
        .select(*obs.columns, missing.alias("missing_years"))
        .withColumn("is_available", F.size("missing_years") == 0)
    )


def with_gate(obs: DataFrame, years_of_tile: DataFrame, days_before: int = 31) -> DataFrame:
    """Adds ``_open``: all years of the window are there."""
    found = window_availability(obs, years_of_tile, days_before)
    return found.withColumnRenamed("is_available", "_open").drop("missing_years")


def with_days_before(rows: DataFrame, keys: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Steps back from the newest: T-1 for the first row of a series, 0 for the last.

    A series is bounded by its window, so a plain window over it is safe.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("time"))
    return rows.withColumn("days_before", F.row_number().over(newest_first) - 1)


def rolling_averages(
    rows: DataFrame, windows: Sequence[int] = ROLLING_WINDOWS, keys: Sequence[str] = ("obs_id",), value: str = "sst"
) -> DataFrame:
    """Mean of the previous w values, the current one excluded; NULL unless all w are present.

    Works on series of any length: a key is cut into blocks with a lead-in of the longest window.
    """
    longest = max(windows)
    blocks = with_lead_in(with_position(rows, keys, name="_step"), F.col("_step"), 4 * longest, longest)
    ordered = Window.partitionBy(*keys, "_block").orderBy("_step")
    means = {}
    for width in windows:
        past = ordered.rowsBetween(-width, -1)
        means[f"mean_{width}"] = F.when(F.count(value).over(past) == width, F.avg(value).over(past))
    return blocks.withColumns(means).where("_own").drop("_own", "_block", "_step")


def to_sequence(df: DataFrame, length: int, column: str = "series", value: str = "sst", pad: float = 0.0) -> DataFrame:
    """Adds ``sequence``, the newest ``length`` values as doubles, padded in front; gaps become ``pad``."""
    values = F.transform(F.col(column), lambda step: F.coalesce(step[value].cast("double"), F.lit(pad)))
    newest = F.when(F.size(values) > length, F.slice(values, -length, length)).otherwise(values)
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(newest), F.lit(0)))
    return df.withColumn("sequence", F.concat(padding, newest))
