"""Point-in-polygon and within-distance joins as equi-joins on the squares of an edge index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.geometry import PLATE_CARREE_DEGREE, meridian_meters

# Least side of a square in degrees, the place of its reference point as shares of the side (no round or related numbers, so that outlines on round
# coordinates, diagonals included, do not run through it), and what rounding may move an edge by.
SQUARE, REFERENCE_X, REFERENCE_Y, ROUNDING = 0.25, 0.4321789316, 0.5718281829, 1e-9

# Region codes and names, and the codes left out of region maps.
REGION_NAMES = {
    "arab": "Arabian Sea",
    "car": "Caribbean",
    "china": "China Seas",
    "cind": "Central Indian",
    "ctplus": "Central Tropical Plus",
    "enso": "ENSO",
    "enso1+2": "ENSO 1+2",
    "enso3": "ENSO 3",
    "enso4": "ENSO 4",
    "epac": "East Pacific",
    "eqatl": "Equatorial Atlantic",
    "eqpac": "Equatorial Pacific",
    "gbr": "Great Barrier Reef",
    "hi": "Hawaii",
    "pg": "Papua New Guinea",
    "red": "Red Sea",
    "sea": "Southeast Asia",
    "spac": "South Pacific",
    "waus": "Western Australia",
    "wind": "Windward Islands",
}
EXCLUDED_REGIONS = ("enso", "enso1+2", "enso3", "enso4")


def region_names(df: DataFrame) -> DataFrame:
    """Adds ``region_name``; the dictionary is fixed, so it is a literal map rather than a join."""
    names = F.create_map(*[F.lit(text) for pair in REGION_NAMES.items() for text in pair])
    return df.withColumn("region_name", F.try_element_at(names, F.col("region")))


def region_bounds(regions: DataFrame, by: str = "region") -> DataFrame:
    return regions.groupBy(by).agg(
        F.min("lats").alias("lat_min"), F.max("lats").alias("lat_max"),
        F.min("lons").alias("lon_min"), F.max("lons").alias("lon_max"),
    )


def region_polygons(regions: DataFrame) -> DataFrame:
    """One-ring polygon of each region as a vertex table; ``seq`` gives the order of the outline.

    A polygon stays one row per vertex, since a region may have any number of them; ``edges`` closes it.
    """
    return regions.select(
        F.col("region").alias("polygon_id"), F.lit(0).alias("ring_id"), "seq",
        F.col("lons").alias("lon"), F.col("lats").alias("lat"),
    )


def edges(vertices: DataFrame) -> DataFrame:
    """Closed rings as edges, by joining each vertex to the next ``seq`` (consecutive in its ring)."""
    ring = ["polygon_id", "ring_id"]
    ends = vertices.groupBy(*ring).agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    here = vertices.join(ends, ring).select(
        *ring, F.col("seq").alias("_seq"), F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.when(F.col("seq") == F.col("_last"), F.col("_first")).otherwise(F.col("seq") + 1).alias("seq"),
    )
    after = vertices.select(*ring, "seq", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    gap = F.raise_error(F.lit("Vertex numbers of a ring are not consecutive.")).cast("double")
    return here.join(after, [*ring, "seq"], "left").select(
        *ring, F.col("_seq").alias("seq"), "x1", "y1", F.coalesce("x2", gap).alias("x2"), F.coalesce("y2", gap).alias("y2")
    )


def _polygon_reach(vertices: DataFrame, distance: float, unit: str) -> DataFrame:
    """Box of each polygon and its reach in degrees of the projected plane."""
    boxes = vertices.groupBy("polygon_id").agg(
        F.min("lon").alias("x_min"), F.max("lon").alias("x_max"),
        F.min("lat").alias("y_min"), F.max("lat").alias("y_max"),
    )
    if unit == "degrees":
        metres = meridian_meters((F.col("y_min") + F.col("y_max")) / 2.0, distance) if distance else F.lit(0.0)
    elif unit == "meters":
        metres = F.lit(float(distance))
    else:
        raise ValueError(f"Unknown unit {unit}: degrees or meters")
    return boxes.withColumn("reach", metres / PLATE_CARREE_DEGREE)


def _crossing_x(e1: Column, e2: Column, y: Column) -> Column:
    (x1, y1), (x2, y2) = e1, e2
    return x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))


def _ends() -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    return (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))


def _crosses(y: Column) -> Column:
    """Whether the edge crosses this latitude (half-open)."""
    return (F.col("y1") <= y) != (F.col("y2") <= y)


def _touches(x: Column, y: Column) -> Column:
    (x1, y1), (x2, y2) = _ends()
    turn = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    return (turn == 0.0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def _within(x: Column, y: Column, reach: Column) -> Column:
    """Whether the point is at most ``reach`` from the edge."""
    (x1, y1), (x2, y2) = _ends()
    dx, dy = x2 - x1, y2 - y1
    along = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    off_x, off_y = x - x1 - share * dx, y - y1 - share * dy
    return off_x * off_x + off_y * off_y <= reach * reach


def _in_squares(sides: DataFrame, side: float) -> DataFrame:
    """Each edge in each square (``_col``, ``_band``) that it passes within the polygon's ``reach``."""
    pad = F.col("reach") + ROUNDING

    def squares(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor((low - pad) / side), F.floor((high + pad) / side)))

    banded = sides.withColumn("_band", squares(F.least("y1", "y2"), F.greatest("y1", "y2")))
    # The part of the edge that the band and its margin hold.
    low = F.greatest(F.least("y1", "y2"), F.col("_band") * side - pad)
    high = F.least(F.greatest("y1", "y2"), (F.col("_band") + 1) * side + pad)
    flat = F.col("y1") == F.col("y2")
    xs = [F.when(flat, end).otherwise(_crossing_x(*_ends(), y)) for end, y in ((F.col("x1"), low), (F.col("x2"), high))]
    return banded.withColumn("_col", squares(F.least(*xs), F.greatest(*xs)))


def _reference_parity(placed: DataFrame, sides: DataFrame, side: float) -> DataFrame:
    """The squares whose reference point is inside its polygon: those with edges, and whole inside squares between them.

    Along a band, the crossings of the outline with the latitude of the reference points are counted per column and summed from
    the west; a band has no more columns than the globe, whatever the number of edges.
    """
    band = ["polygon_id", "_band"]
    y = (F.col("_band") + REFERENCE_Y) * side
    spans = F.sequence(F.floor(F.least("y1", "y2") / side), F.floor(F.greatest("y1", "y2") / side))
    crossed = sides.withColumn("_band", F.explode(spans)).where(_crosses(y)).select(
        *band, F.ceil(_crossing_x(*_ends(), y) / side - REFERENCE_X).alias("_col"), F.lit(1).alias("_n"), F.lit(False).alias("_edged")
    )
    edged = placed.select(*band, "_col", F.lit(0).alias("_n"), F.lit(True).alias("_edged"))
    columns = edged.union(crossed).groupBy(*band, "_col").agg(F.sum("_n").alias("_n"), F.max("_edged").alias("_edged"))
    west = Window.partitionBy(*band).orderBy("_col")
    summed = columns.withColumns({"_n": F.sum("_n").over(west), "_next": F.lead("_col").over(west)})
    odd = summed.where(F.col("_n") % 2 == 1)
    return odd.select("polygon_id", "_band", F.explode(F.sequence(F.col("_col"), F.col("_next") - 1)).alias("_col"))


def _edge_index(vertices: DataFrame, distance: float, unit: str) -> tuple[DataFrame, float]:
    """Squares with what decides on a position in them: ``_inside`` = 1 where the reference point is inside, and the edges near the square."""
    reach = _polygon_reach(vertices, distance, unit)
    degrees = 1.02 * distance if unit == "degrees" else distance / PLATE_CARREE_DEGREE
    side = max(SQUARE, degrees)
    sides = edges(vertices).join(reach.select("polygon_id", "reach"), "polygon_id").select("polygon_id", "reach", "x1", "y1", "x2", "y2")
    placed = _in_squares(sides, side)
    none = [F.lit(None).cast("double").alias(c) for c in ("reach", "x1", "y1", "x2", "y2")]
    inside = _reference_parity(placed, sides, side).select("_col", "_band", "polygon_id", F.lit(1).alias("_inside"), *none)
    held = placed.select("_col", "_band", "polygon_id", F.lit(0).alias("_inside"), "reach", "x1", "y1", "x2", "y2")
    return held.union(inside), side


def _held_positions(points: DataFrame, vertices: DataFrame, distance: float, unit: str) -> DataFrame:
    """Distinct positions of ``points`` with each polygon they are in or near.

    Only coordinates travel: points that repeat a position share one test, and other columns stay behind. A position meets the index rows of its own square by
    one equi-join: the edges there, and whether the square's reference point is inside. The way from that point along its longitude and then
    along the position's latitude stays in the square; the edges it crosses change the side. Squares without edges need no edge test.
    """
    index, side = _edge_index(vertices, distance, unit)
    x, y = F.col("longitude"), F.col("latitude")
    keyed = points.select("longitude", "latitude").distinct().withColumns({"_col": F.floor(x / side), "_band": F.floor(y / side)})
    met = keyed.join(index, ["_col", "_band"])
    x0, y0 = (F.col("_col") + REFERENCE_X) * side, (F.col("_band") + REFERENCE_Y) * side
    (x1, y1), (x2, y2) = _ends()
    meets = y1 + (x0 - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    north = ((x1 <= x0) != (x2 <= x0)) & ((meets <= y0) != (meets <= y))
    at = _crossing_x(*_ends(), y)
    east = _crosses(y) & ((at <= x0) != (at < x))
    near = _within(x, y, F.col("reach")) if distance > 0 else _touches(x, y)
    turns = F.col("_inside") + F.when(north, 1).otherwise(0) + F.when(east, 1).otherwise(0)
    return (
        met.groupBy("longitude", "latitude", "polygon_id")
        .agg(F.sum(turns).alias("_turns"), F.max(F.coalesce(near, F.lit(False))).alias("_near"))
        .where((F.col("_turns") % 2 == 1) | F.col("_near"))
        .drop("_turns", "_near")
    )


def _with_polygons(points: DataFrame, held: DataFrame) -> DataFrame:
    return points.join(held, ["longitude", "latitude"]).select(*points.columns, "polygon_id")


def join_polygons(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Inner join of points to the polygons that hold them, boundary included; one row per pair.

    Repeated points are kept, each with its pairs; points without a position are in no polygon.
    """
    return _with_polygons(points, _held_positions(points, vertices, 0.0, "meters"))


def points_in_polygons(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Points inside at least one polygon, once for each row, with the lowest polygon id."""
    held = _held_positions(points, vertices, 0.0, "meters")
    return _with_polygons(points, held.groupBy("longitude", "latitude").agg(F.min("polygon_id").alias("polygon_id")))


def points_within(points: DataFrame, vertices: DataFrame, distance: float, unit: str = "degrees") -> DataFrame:
    """Points inside a polygon or at most ``distance`` from its outline, one row per pair.

    Degrees are turned into metres by the meridian at the polygon's centre latitude; distances are
    taken in the plate carree plane.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    return _with_polygons(points, _held_positions(points, vertices, distance, unit))
