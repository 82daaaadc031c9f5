"""Tiles of the download grid: covering a box, work manifests and the tile of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions.geometry import BOUNDS, patch_name, snap

TILE_WIDTH = 20.0


def _starts(lo: str, hi: str, width: float) -> Column:
    """Lower edges of the tiles between two coordinates, as an array."""
    first = F.floor(F.col(lo) / width)
    count = F.ceil(F.col(hi) / width) - first
    numbers = F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: i.cast("double") * F.lit(float(width)))


def tiles_for_boxes(boxes: DataFrame, width: float = TILE_WIDTH) -> DataFrame:
    """Full tiles that overlap each box (``lat_min, lat_max, lon_min, lon_max``) with positive area."""
    spread = boxes.withColumn("lat0", F.explode(_starts("lat_min", "lat_max", width))).withColumn(
        "lon0", F.explode(_starts("lon_min", "lon_max", width))
    )
    tiled = spread.withColumns({"lat1": F.col("lat0") + width, "lon1": F.col("lon0") + width})
    overlap = (F.least("lat1", "lat_max") > F.greatest("lat0", "lat_min")) & (
        F.least("lon1", "lon_max") > F.greatest("lon0", "lon_min")
    )
    return tiled.where(overlap).withColumn("patch", patch_name(*[F.col(b) for b in BOUNDS]))


def tiles_for_bbox(spark, lats: tuple[float, float], lons: tuple[float, float], width: float = TILE_WIDTH) -> DataFrame:
    box = [(float(min(lats)), float(max(lats)), float(min(lons)), float(max(lons)))]
    boxes = spark.createDataFrame(box, "lat_min double, lat_max double, lon_min double, lon_max double")
    return tiles_for_boxes(boxes, width).select("patch", *BOUNDS)


def month_slices(df: DataFrame, start: str, end: str) -> DataFrame:
    """Explodes each row into calendar-month slices of [start, end] (two date columns).

    Slices start at noon; one whose noon start is not before the end is not emitted, and an end
    before the start is an error.
    """
    wrong = F.raise_error(F.lit("Start date must be before end date.")).cast("date")
    first = F.when(F.col(start) > F.col(end), wrong).otherwise(F.col(start))
    months = F.sequence(F.trunc(first, "MM"), F.col(end), F.expr("INTERVAL 1 MONTH"))
    noon = F.greatest("_month", F.col(start)).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return (
        df.withColumn("_month", F.explode(months))
        .withColumn("slice_start", noon)
        .where(F.col("slice_start") < F.col(end).cast("timestamp_ntz"))
        .withColumn("slice_end", F.least(F.last_day("_month"), F.col(end)))
        .drop("_month")
    )


def manifest(tiles: DataFrame, var: str, start: str, end: str) -> DataFrame:
    """Every tile and month slice with the path its file will have; no cross join."""
    name = F.concat(
        F.col("patch"), F.lit(f"/{var}_"), F.date_format("slice_start", "yyyy-MM-dd"), F.lit("_"),
        F.date_format("slice_end", "yyyy-MM-dd"), F.lit(".nc"),
    )
    return month_slices(tiles, start, end).withColumn("path", name)


def pending(work: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Manifest entries without a non-empty file.

    Files are matched by tile and name, since a scanned catalogue has full addresses and a manifest relative paths.
    """

    def place(path: str) -> Column:
        return F.concat_ws("/", F.regexp_extract(path, r"(patch_[^/]*)", 1), F.regexp_extract(path, r"([^/]*)$", 1))

    there = catalogue.where(F.col("bytes") > 0).select(place("path").alias("_place"))
    return work.withColumn("_place", place("path")).join(there, "_place", "left_anti").drop("_place")


def assign_tile(
    points: DataFrame, tiles: DataFrame, on_missing: str = "error", width: float = TILE_WIDTH
) -> DataFrame:
    """Tile of each point, bounds closed on all sides; the lowest tile wins where several contain it.

    Tiles are keyed by the coarse squares they touch and packed per square, so each point meets one
    row. ``width`` is the tile width, so a square is touched by at most its own tile and neighbours.
    """
    if on_missing not in ("error", "null"):
        raise ValueError(f"Unknown on_missing: {on_missing}")

    def squares(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))

    packed = (
        tiles.select("patch", *BOUNDS).distinct()
        .withColumn("_row", F.explode(squares("lat0", "lat1")))
        .withColumn("_col", F.explode(squares("lon0", "lon1")))
        .groupBy("_row", "_col")
        .agg(F.sort_array(F.collect_list(F.struct("lat0", "lon0", "lat1", "lon1", "patch"))).alias("_tiles"))
    )
    keyed = points.withColumns(
        {"_row": F.floor(F.col("latitude") / width), "_col": F.floor(F.col("longitude") / width)}
    )
    holding = F.filter(
        F.col("_tiles"),
        lambda t: F.col("latitude").between(t["lat0"], t["lat1"]) & F.col("longitude").between(t["lon0"], t["lon1"]),
    )
    found = F.get(holding, 0)["patch"]
    if on_missing == "error":
        where = F.concat_ws(", ", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
        message = F.concat(F.lit("No tile contains point "), where)
        found = F.coalesce(found, F.raise_error(message).cast("string"))
    return keyed.join(packed, ["_row", "_col"], "left").withColumn("patch", found).drop("_row", "_col", "_tiles")


def snapped_bounds(df: DataFrame, width: float = TILE_WIDTH) -> DataFrame:
    """Bounds of the tile-aligned box around each box."""
    return df.withColumns(
        {
            "grid_lat0": snap(F.col("lat_min"), width), "grid_lat1": snap(F.col("lat_max"), width, up=True),
            "grid_lon0": snap(F.col("lon_min"), width), "grid_lon1": snap(F.col("lon_max"), width, up=True),
        }
    )
