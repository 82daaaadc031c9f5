"""Grid sampling, tiles, polygons and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.clean_queries import _arc
from checks.registry import query, rounded
from thermocline.functions.geometry import BOUNDS
from thermocline.operators import filters, polygons, sampling, series, tiles
from thermocline.plans.comparison import stored_features, window_key
from thermocline.session import shared_folder
from thermocline.sources import catalogue as cat
from thermocline.sources.store import FeatureStore


@query(
    "d01_nearest_sample",
    """SELECT p.obs_id, round(s.mmm, 6) AS mmm FROM placed p LEFT JOIN static_located s ON s.latitude = p._lat AND s.longitude = p._lon""",
    ["placed", "static_located"],
)
def nearest(spark, sf):
    sampled = sampling.sample_grid(v.points(spark, sf), v.static_located(spark, sf), value="mmm")
    return rounded(sampled.select("obs_id", "mmm"))


_SITE_STEPS = """WITH near AS (SELECT site, latitude, longitude,
      (SELECT a FROM (SELECT DISTINCT latitude AS a FROM grid_daily) ORDER BY abs(a - s.latitude), a LIMIT 1) AS _lat,
      (SELECT a FROM (SELECT DISTINCT longitude AS a FROM grid_daily) ORDER BY abs(a - s.longitude), a LIMIT 1) AS _lon FROM sites s),
    steps AS (SELECT DISTINCT time FROM grid_daily), means AS (SELECT time, avg(sst) AS m FROM grid_daily GROUP BY time)"""


@query(
    "d01_nearest_sample_daily",
    _SITE_STEPS
    + """ SELECT site, t.time, round(g.sst, 6) AS sst FROM near n CROSS JOIN steps t
    LEFT JOIN grid_daily g ON g.latitude = _lat AND g.longitude = _lon AND g.time = t.time""",
    ["sites", "grid_daily"],
)
def nearest_daily(spark, sf):
    grid = v.grid_daily(spark, sf).select("time", "latitude", "longitude", "sst")
    return rounded(sampling.sample_grid(v.sites(spark, sf), grid).select("site", "time", "sst"))


@query(
    "d03_fill_mean",
    _SITE_STEPS
    + """ SELECT site, t.time, round(coalesce(g.sst, m), 8) AS sst FROM near n CROSS JOIN steps t JOIN means USING (time)
    LEFT JOIN grid_daily g ON g.latitude = _lat AND g.longitude = _lon AND g.time = t.time""",
    ["sites", "grid_daily"],
)
def fill_mean(spark, sf):
    grid = v.grid_daily(spark, sf).select("time", "latitude", "longitude", "sst")
    return rounded(sampling.sample_grid(v.sites(spark, sf), grid, fill="mean").select("site", "time", "sst"), 8)


@query(
    "d03_fill_zero",
    _SITE_STEPS
    + """ SELECT site, t.time, round(coalesce(g.sst, 0), 6) AS sst FROM near n CROSS JOIN steps t
    LEFT JOIN grid_daily g ON g.latitude = _lat AND g.longitude = _lon AND g.time = t.time""",
    ["sites", "grid_daily"],
)
def fill_zero(spark, sf):
    grid = v.grid_daily(spark, sf).select("time", "latitude", "longitude", "sst")
    return rounded(sampling.sample_grid(v.sites(spark, sf), grid, fill="zero").select("site", "time", "sst"))


_CORNERS = """WITH axes AS (SELECT list(DISTINCT latitude ORDER BY latitude) AS la, list(DISTINCT longitude ORDER BY longitude) AS lo FROM grid_daily),
    squares AS (SELECT p.*, la, lo,
        greatest(least(len(list_filter(la, lambda a: a <= p.latitude)), len(la) - 1), 1) AS i,
        greatest(least(len(list_filter(lo, lambda a: a <= p.longitude)), len(lo) - 1), 1) AS j FROM {points} p, axes),
    shares AS (SELECT *, (latitude - la[i]) / (la[i + 1] - la[i]) AS u, (longitude - lo[j]) / (lo[j + 1] - lo[j]) AS w FROM squares),
    corners AS (SELECT * EXCLUDE (la, lo, i, j, u, w), la[i + a] AS _lat, lo[j + b] AS _lon,
        (CASE a WHEN 0 THEN 1 - u ELSE u END) * (CASE b WHEN 0 THEN 1 - w ELSE w END) AS weight
      FROM shares, (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b))"""


@query(
    "d02_bilinear_sample",
    _CORNERS.format(points="points")
    + """ SELECT obs_id, round(CASE WHEN count(mmm) = 4 THEN sum(weight * mmm) END, 6) AS mmm
    FROM corners c LEFT JOIN static_located s ON s.latitude = _lat AND s.longitude = _lon GROUP BY obs_id""",
    ["points", "static_located", "grid_daily"],
)
def bilinear(spark, sf):
    sampled = sampling.sample_grid(v.points(spark, sf), v.static_located(spark, sf), "linear", value="mmm")
    return rounded(sampled.select("obs_id", "mmm"))


@query(
    "d02_bilinear_sample_daily",
    _CORNERS.format(points="sites")
    + """, steps AS (SELECT DISTINCT time FROM grid_daily)
    SELECT site, t.time, round(CASE WHEN count(sst) = 4 THEN sum(weight * sst) END, 6) AS sst
    FROM corners c CROSS JOIN steps t LEFT JOIN grid_daily g ON g.latitude = _lat AND g.longitude = _lon AND g.time = t.time
    GROUP BY site, t.time""",
    ["sites", "grid_daily"],
)
def bilinear_daily(spark, sf):
    grid = v.grid_daily(spark, sf).select("time", "latitude", "longitude", "sst")
    return rounded(sampling.sample_grid(v.sites(spark, sf), grid, "linear").select("site", "time", "sst"))


@query(
    "a07_tiles",
    """SELECT year, printf('patch_%.0f_%.0f_%.0f_%.0f', lat0, lat0 + 1, lon0, lon0 + 1) AS patch, lat0, lat0 + 1 AS lat1, lon0, lon0 + 1 AS lon1
    FROM (SELECT *, unnest(generate_series(floor(lat_min)::INT, ceil(lat_max)::INT - 1))::DOUBLE AS lat0 FROM boxes_by_year),
      LATERAL (SELECT unnest(generate_series(floor(lon_min)::INT, ceil(lon_max)::INT - 1))::DOUBLE AS lon0)""",
    ["boxes_by_year"],
)
def tiles_of_boxes(spark, sf):
    return tiles.tiles_for_boxes(v.boxes_by_year(spark, sf), 1.0).select("year", "patch", *BOUNDS)


@query(
    "i05_snapped_bounds",
    """SELECT year, floor(lat_min / 2) * 2 AS grid_lat0, ceil(lat_max / 2) * 2 AS grid_lat1,
      floor(lon_min / 2) * 2 AS grid_lon0, ceil(lon_max / 2) * 2 AS grid_lon1 FROM boxes_by_year""",
    ["boxes_by_year"],
)
def snapped(spark, sf):
    names = ("year", "grid_lat0", "grid_lat1", "grid_lon0", "grid_lon1")
    return tiles.snapped_bounds(v.boxes_by_year(spark, sf), 2.0).select(*names)


_MANIFEST = """WITH spans AS (SELECT t.*, s, e FROM tiles t, (SELECT min(time)::DATE AS s, max(time)::DATE AS e FROM grid_daily)),
    months AS (SELECT *, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH))::DATE AS m FROM spans),
    slices AS (SELECT *, greatest(m, s) + INTERVAL 12 HOUR AS slice_start, least(last_day(m), e) AS slice_end FROM months),
    manifest AS (SELECT patch, slice_start, slice_end,
        concat(patch, '/SST_', strftime(slice_start, '%Y-%m-%d'), '_', strftime(slice_end, '%Y-%m-%d'), '.nc') AS path
      FROM slices WHERE slice_start < e)"""


def _manifest(spark, sf):
    grid = v.grid_daily(spark, sf)
    box = v.boxes_by_year(spark, sf)
    some = tiles.tiles_for_boxes(box, 1.0).select("patch", *BOUNDS).distinct()
    spanned = some.withColumns(
        {"start": F.to_date(grid.agg(F.min("time")).scalar()), "end": F.to_date(grid.agg(F.max("time")).scalar())}
    )
    return tiles.manifest(spanned, v.VAR, "start", "end").select("patch", "slice_start", "slice_end", "path")


@query("a08_manifest", _MANIFEST + " SELECT * FROM manifest", ["tiles", "grid_daily"])
def manifest(spark, sf):
    return _manifest(spark, sf)


@query(
    "a09_h02_pending",
    _MANIFEST + " SELECT * FROM manifest WHERE path NOT IN (SELECT path FROM catalogue WHERE bytes > 0)",
    ["tiles", "grid_daily", "catalogue"],
)
def pending(spark, sf):
    return tiles.pending(_manifest(spark, sf), v.catalogue(spark, sf)).select("patch", "slice_start", "slice_end", "path")


@query(
    "a09_pending_scanned",
    _MANIFEST + " SELECT * FROM manifest WHERE path NOT IN (SELECT path FROM catalogue WHERE bytes > 0)",
    ["tiles", "grid_daily", "catalogue"],
)
def pending_scanned(spark, sf):
    """A scanned catalogue has full addresses, the manifest relative paths."""
    scanned = v.catalogue(spark, sf).withColumn("path", F.concat(F.lit("s3a://store/grid/"), "path"))
    return tiles.pending(_manifest(spark, sf), scanned).select("patch", "slice_start", "slice_end", "path")


_ASSIGNED = """SELECT obs_id, arg_min(patch, lat0 * 1000 + lon0) AS patch FROM points p JOIN tiles t
    ON p.latitude BETWEEN lat0 AND lat1 AND p.longitude BETWEEN lon0 AND lon1 GROUP BY obs_id"""


def _tiles(spark, sf):
    return tiles.tiles_for_boxes(v.boxes_by_year(spark, sf), 1.0).select("patch", *BOUNDS).distinct()


@query("d05_assign_tile", _ASSIGNED, ["points", "tiles"])
def assign_tile(spark, sf):
    return tiles.assign_tile(v.points(spark, sf), _tiles(spark, sf), "error", 1.0).select("obs_id", "patch")


@query(
    "d05_assign_tile_null",
    """SELECT obs_id, arg_min(patch, lat0 * 1000 + lon0) AS patch FROM points p LEFT JOIN
      (SELECT DISTINCT patch, string_split(patch, '_')[2]::DOUBLE AS lat0, string_split(patch, '_')[3]::DOUBLE AS lat1,
        string_split(patch, '_')[4]::DOUBLE AS lon0, string_split(patch, '_')[5]::DOUBLE AS lon1 FROM catalogue) t
    ON p.latitude BETWEEN lat0 AND lat1 AND p.longitude BETWEEN lon0 AND lon1 GROUP BY obs_id""",
    ["points", "catalogue"],
)
def assign_tile_null(spark, sf):
    known = cat.availability(v.catalogue(spark, sf), v.VAR)
    return tiles.assign_tile(v.points(spark, sf), known, "null", 1.0).select("obs_id", "patch")


# Tiles are taken to lack one year in the middle, so that some windows are not all there.
LOST_YEAR = 1997
_NEEDED = f"""assigned AS ({_ASSIGNED}),
    have AS (SELECT patch, list(DISTINCT year) FILTER (year <> {LOST_YEAR}) AS years FROM catalogue WHERE bytes > 0 GROUP BY patch),
    needed AS (SELECT obs_id, list_sort(list_filter(generate_series(year(date - INTERVAL 31 DAY), year(date)),
        lambda y: NOT list_contains(coalesce(years, []), y))) AS missing
      FROM dated JOIN assigned USING (obs_id) LEFT JOIN have USING (patch))"""


def _tile_years(spark, sf):
    years = cat.availability(v.catalogue(spark, sf).where("bytes > 0"), v.VAR)
    return years.withColumn("available_years", F.filter("available_years", lambda y: y != LOST_YEAR))


def _tiled(spark, sf):
    return tiles.assign_tile(v.dated(spark, sf), _tiles(spark, sf), "error", 1.0)


@query(
    "d07_window_availability",
    f"""WITH {_NEEDED}
    SELECT obs_id, array_to_string(missing, ',') AS missing_years, len(missing) = 0 AS is_available FROM needed""",
    ["points", "tiles", "catalogue", "dated"],
)
def window_availability(spark, sf):
    found = series.window_availability(_tiled(spark, sf), _tile_years(spark, sf))
    return found.select("obs_id", F.array_join("missing_years", ",").alias("missing_years"), "is_available")


_GRID = ("time", "latitude", "longitude", "year", "sst")


@query(
    "d06_series_gated",
    f"""WITH {_NEEDED}
    SELECT n.obs_id, count(s.time) AS n, round(coalesce(sum(s.sst), 0), 6) AS total
    FROM needed n LEFT JOIN series s ON s.obs_id = n.obs_id AND len(missing) = 0 GROUP BY n.obs_id""",
    ["points", "tiles", "catalogue", "dated", "series"],
)
def series_gated(spark, sf):
    found = series.series_for(
        _tiled(spark, sf), v.grid_daily(spark, sf).select(*_GRID),
        axes=v.static_located(spark, sf), years_of_tile=_tile_years(spark, sf),
    )
    total = F.aggregate("series", F.lit(0.0), lambda t, step: t + step["sst"])
    return rounded(found.select("obs_id", F.coalesce(F.size("series"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(total, F.lit(0.0)).alias("total")))


@query(
    "l09_gated_training_rows",
    f"""WITH {_NEEDED}
    SELECT obs_id, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence
    FROM dated JOIN needed USING (obs_id) WHERE len(missing) = 0 AND obs_id IN (SELECT obs_id FROM series)""",
    ["points", "tiles", "catalogue", "dated", "series"],
)
def gated_training_rows(spark, sf):
    obs = filters.with_presence(_tiled(spark, sf))
    kept = FeatureStore(spark, shared_folder(spark, "features"), window_key(obs, window_days=31, gated=True))
    found = stored_features(
        obs, v.grid_daily(spark, sf).select(*_GRID), kept, 31,
        axes=v.static_located(spark, sf), years_of_tile=_tile_years(spark, sf),
    )
    return found.select("obs_id", "bleach_presence")


@query("d08_join_polygons", "SELECT obs_id, polygon_id FROM held", ["held"])
def join_polygons(spark, sf):
    return polygons.join_polygons(v.points(spark, sf), v.polygon_vertices(spark, sf)).select("obs_id", "polygon_id")


# Points that keep only their position occur repeatedly; every repeat is in the result.
_REPEATED = """WITH twice AS (SELECT longitude, latitude, obs_id FROM points UNION ALL SELECT longitude, latitude, obs_id FROM points)
    SELECT round(t.longitude, 9) AS longitude, round(t.latitude, 9) AS latitude, {value} FROM twice t {join}"""


def _twice(spark, sf):
    places = v.points(spark, sf).select("longitude", "latitude")
    return places.union(places)


def _at(found, *more):
    return found.select(F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"), *more)


@query("d08_repeated_points", _REPEATED.format(value="polygon_id", join="JOIN held USING (obs_id)"), ["points", "held"])
def join_polygons_repeated(spark, sf):
    return _at(polygons.join_polygons(_twice(spark, sf), v.polygon_vertices(spark, sf)), "polygon_id")


@query(
    "d09_repeated_points",
    _REPEATED.format(
        value="polygon_id", join="JOIN (SELECT obs_id, min(polygon_id) AS polygon_id FROM held GROUP BY obs_id) USING (obs_id)"
    ),
    ["points", "held"],
)
def points_in_polygons_repeated(spark, sf):
    return _at(polygons.points_in_polygons(_twice(spark, sf), v.polygon_vertices(spark, sf)), "polygon_id")


@query("d09_points_in_polygons", "SELECT obs_id, min(polygon_id) AS polygon_id FROM held GROUP BY obs_id", ["held"])
def points_in_polygons(spark, sf):
    found = polygons.points_in_polygons(v.points(spark, sf), v.polygon_vertices(spark, sf))
    return found.select("obs_id", "polygon_id")


_NEAR = """WITH reach AS (SELECT polygon_id, {metres} / (6378137.0::DOUBLE * pi() / 180) AS r FROM edges GROUP BY polygon_id),
    near AS (SELECT DISTINCT obs_id, polygon_id FROM (
      SELECT *, longitude - x1 - share * dx AS ox, latitude - y1 - share * dy AS oy FROM (
        SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, ((longitude - x1) * dx + (latitude - y1) * dy) / (dx * dx + dy * dy))) AS share
        FROM (SELECT p.*, e.*, r, x2 - x1 AS dx, y2 - y1 AS dy FROM points p, edges e JOIN reach USING (polygon_id))))
      WHERE ox * ox + oy * oy <= r * r)
    SELECT obs_id, polygon_id FROM near UNION SELECT obs_id, polygon_id FROM held"""


@query("d10_points_within_meters", _NEAR.format(metres="7000.0::DOUBLE"), ["points", "edges", "held"])
def within_meters(spark, sf):
    near = polygons.points_within(v.points(spark, sf), v.polygon_vertices(spark, sf), 7000.0, "meters")
    return near.select("obs_id", "polygon_id")


_MIDDLE = "((min(y1) + max(y1)) / 2.0::DOUBLE)"


@query(
    "d10_points_within_degrees",
    _NEAR.format(metres=f"({_arc(f'({_MIDDLE} + 0.07::DOUBLE)')} - {_arc(_MIDDLE)})"),
    ["points", "edges", "held"],
)
def within_degrees(spark, sf):
    near = polygons.points_within(v.points(spark, sf), v.polygon_vertices(spark, sf), 0.07, "degrees")
    return near.select("obs_id", "polygon_id")


@query(
    "d10_repeated_points",
    f"""WITH near_held AS ({_NEAR.format(metres="7000.0::DOUBLE")}), twice AS (SELECT longitude, latitude, obs_id FROM points
      UNION ALL SELECT longitude, latitude, obs_id FROM points)
    SELECT round(t.longitude, 9) AS longitude, round(t.latitude, 9) AS latitude, polygon_id FROM twice t JOIN near_held USING (obs_id)""",
    ["points", "edges", "held"],
)
def within_repeated(spark, sf):
    return _at(polygons.points_within(_twice(spark, sf), v.polygon_vertices(spark, sf), 7000.0, "meters"), "polygon_id")


@query(
    "c09_exclude_regions",
    """SELECT region, seq FROM (SELECT nullif(region, 'hi') AS region, seq FROM regions)
    WHERE region IS NULL OR region NOT IN ('enso', 'enso1+2', 'enso3', 'enso4')""",
    ["regions"],
)
def exclude_regions(spark, sf):
    rows = v.regions(spark, sf).withColumn("region", F.nullif("region", F.lit("hi")))
    return filters.exclude_regions(rows, polygons.EXCLUDED_REGIONS).select("region", "seq")


@query(
    "d12_region_names",
    """SELECT region, seq, CASE region WHEN 'gbr' THEN 'Great Barrier Reef' WHEN 'enso3' THEN 'ENSO 3'
      WHEN 'waus' THEN 'Western Australia' WHEN 'pg' THEN 'Papua New Guinea' END AS region_name FROM regions""",
    ["regions"],
)
def region_names(spark, sf):
    return polygons.region_names(v.regions(spark, sf)).select("region", "seq", "region_name")


@query(
    "e10_region_bounds",
    """SELECT region, round(min(lats), 6) AS lat_min, round(max(lats), 6) AS lat_max, round(min(lons), 6) AS lon_min,
      round(max(lons), 6) AS lon_max FROM regions GROUP BY region""",
    ["regions"],
)
def region_bounds(spark, sf):
    return rounded(polygons.region_bounds(v.regions(spark, sf)))


@query(
    "e11_region_polygons",
    """SELECT polygon_id, seq, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM edges""",
    ["edges"],
)
def region_polygons(spark, sf):
    outlines = polygons.edges(polygons.region_polygons(v.regions(spark, sf)))
    return rounded(outlines.select("polygon_id", "seq", "x1", "y1", "x2", "y2"))
