"""Scans, stores and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.evaluation_queries import SUMMARY_SQL
from checks.registry import query, rounded
from thermocline.functions.geometry import BOUNDS, patch_name
from thermocline.operators import evaluation as ev
from thermocline.operators import climatology as clim
from thermocline.operators import features, filters, series, tiles
from thermocline.plans.comparison import stored_features
from thermocline.session import shared_folder
from thermocline.sources import catalogue as cat
from thermocline.sources import results, store, tables

_PLACED = ("obs_id", "year", "month", "latitude", "longitude", "percent_bleached", "depth", "percent_mortality")
_GRID = ("time", "latitude", "longitude", "year", "sst")


@query(
    "a01_read_observations",
    "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, month::DOUBLE AS month) FROM observations",
    ["observations"],
)
def read_observations(spark, sf):
    path = shared_folder(spark, "observations")
    writer = v.observations(spark, sf).select(*_PLACED).write.option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return rounded(tables.read_observations(spark, path).withColumn("month", F.col("month").cast("double")))


def _stored_grid(spark, sf):
    path = shared_folder(spark, "grid")
    low_lat, low_lon = F.floor("latitude").cast("double"), F.floor("longitude").cast("double")
    tables.write_grid(
        v.grid_daily(spark, sf).withColumn("patch", patch_name(low_lat, low_lat + 1, low_lon, low_lon + 1)), path
    )
    return path


@query(
    "a02_read_grid",
    """SELECT latitude, longitude, time, round(sst, 6) AS sst, year FROM grid_daily WHERE year IN (1996, 1998)
      AND floor(latitude) = -20 AND floor(longitude) IN (140, 141)""",
    ["grid_daily"],
)
def read_grid(spark, sf):
    kept = tables.read_grid(
        spark, _stored_grid(spark, sf), [1996, 1998], ["patch_-20_-19_140_141", "patch_-20_-19_141_142"]
    )
    return rounded(kept.select("latitude", "longitude", "time", "sst", "year"))


@query(
    "a02b_read_grid_by_year",
    "SELECT year, count(*) AS n, round(sum(sst), 4) AS total FROM grid_daily WHERE year IN (1996, 1997, 1998) GROUP BY year",
    ["grid_daily"],
)
def read_grid_by_year(spark, sf):
    grid = tables.read_grid_by_year(spark, _stored_grid(spark, sf), [1996, 1997, 1998])
    return grid.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("sst"), 4).alias("total"))


@query(
    "a03_read_grid_months",
    "SELECT latitude, longitude, time, round(sst, 6) AS sst FROM grid_daily WHERE year = 1997 AND month(time) IN (1, 2, 12)",
    ["grid_daily"],
)
def read_grid_months(spark, sf):
    kept = tables.read_grid_months(spark, _stored_grid(spark, sf), 1997, [1, 2, 12])
    return rounded(kept.select("latitude", "longitude", "time", "sst"))


@query(
    "a04_availability",
    """SELECT patch, lat0, lat1, lon0, lon1, array_to_string(list_sort(list(DISTINCT c.year) FILTER (c.year IS NOT NULL)), ',') AS years,
      count(c.path) AS file_count FROM tiles LEFT JOIN catalogue c USING (patch) GROUP BY ALL""",
    ["tiles", "catalogue"],
)
def availability(spark, sf):
    every = tiles.tiles_for_boxes(v.boxes_by_year(spark, sf), 1.0).select("patch")
    found = cat.availability(v.catalogue(spark, sf), v.VAR, every)
    years = F.when(F.size("available_years") > 0, F.array_join("available_years", ","))
    return found.select("patch", *BOUNDS, years.alias("years"), "file_count")


@query("a05_file_dates", 'SELECT path, start, "end" FROM catalogue', ["catalogue"])
def file_dates(spark, sf):
    return cat.with_file_dates(v.catalogue(spark, sf).select("path"))


@query(
    "a06_filter_files",
    """SELECT path FROM catalogue WHERE start >= DATE '1996-02-01' AND "end" <= DATE '1998-12-31'""",
    ["catalogue"],
)
def filter_files(spark, sf):
    files = cat.with_file_dates(v.catalogue(spark, sf).select("path"))
    return cat.filter_files(files, "199602", "1998-12-31T12:00:00Z").select("path")


@query(
    "a10_a11_missing_years",
    "SELECT cell, month_end, round(CASE WHEN year = 1996 THEN -sst ELSE sst END, 8) AS sst, year, month FROM monthly",
    ["monthly"],
)
def missing_years(spark, sf):
    path = shared_folder(spark, "monthly")
    means = clim.monthly_means(v.grid_daily(spark, sf), v.CELL)
    # A year that is stored already stays as it is, here with its sign turned.
    tables.write_missing_years(means.where("year = 1996").withColumn("sst", -F.col("sst")), path)
    tables.write_missing_years(means, path)
    tables.write_missing_years(means, path)
    return rounded(tables.read_grid(spark, path), 8)


@query(
    "a12_read_polygons",
    "SELECT region AS polygon_id, 0 AS ring_id, seq, round(lons, 6) AS lon, round(lats, 6) AS lat FROM regions",
    ["regions"],
)
def read_polygons(spark, sf):
    path = shared_folder(spark, "polygons")
    v.polygon_vertices(spark, sf).write.parquet(path)
    return rounded(tables.read_polygons(spark, path))


@query(
    "a13_read_regions",
    "SELECT region, seq, round(lats, 6) AS lats, round(lons, 6) AS lons FROM regions",
    ["regions"],
)
def read_regions(spark, sf):
    path = shared_folder(spark, "regions")
    v.regions(spark, sf).write.csv(path, header=True)
    return rounded(tables.read_regions(spark, path))


def _labelled(spark, sf):
    dated = v.dated(spark, sf)
    return filters.with_presence(dated).select("obs_id", "year", "latitude", "longitude", "date", "bleach_presence")


def _plain_grid(spark, sf):
    """The daily grid as a stored table: its axes and its windows are then read, not grouped anew from the lines each time."""
    path = shared_folder(spark, "plain-grid")
    v.grid_daily(spark, sf).select(*_GRID).write.parquet(path)
    return spark.read.parquet(path)


_LABEL = "CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END"
_STORED = f"""SELECT obs_id, {_LABEL} AS bleach_presence, round(avg(sst), 8) AS mean, round(max(sst), 8) AS max
    FROM series JOIN dated USING (obs_id) {{where}} GROUP BY ALL"""


@query(
    "a14_a17_feature_store",
    _STORED.format(where="WHERE year <> 1997"),
    ["series", "dated"],
)
def feature_store(spark, sf):
    obs, grid = _labelled(spark, sf), _plain_grid(spark, sf)
    kept = store.FeatureStore(spark, shared_folder(spark, "features"), "window-31")
    stored_features(obs.where("year < 1999"), grid, kept, 31)
    stored_features(obs, grid, kept, 31)
    return rounded(kept.matrix(obs.where("year <> 1997")).select("obs_id", "bleach_presence", "mean", "max"), 8)


@query(
    "a14_failed_ids",
    "SELECT obs_id FROM dated WHERE obs_id NOT IN (SELECT obs_id FROM series)",
    ["series", "dated"],
)
def failed_ids(spark, sf):
    obs, grid = _labelled(spark, sf), _plain_grid(spark, sf)
    kept = store.FeatureStore(spark, shared_folder(spark, "features"), "window-31")
    stored_features(obs.where("year < 1999"), grid, kept, 31)
    stored_features(obs, grid, kept, 31)
    return kept.failed()


@query(
    "a14_feature_store_forced",
    _STORED.format(where="WHERE year >= 1999"),
    ["series", "dated"],
)
def feature_store_forced(spark, sf):
    obs, grid = _labelled(spark, sf), _plain_grid(spark, sf)
    kept = store.FeatureStore(spark, shared_folder(spark, "features"), "window-31")
    stored_features(obs, grid, kept, 31)
    stored_features(obs.where("year >= 1999"), grid, kept, 31, force=True)
    return rounded(kept.read().select("obs_id", "bleach_presence", "mean", "max"), 8)


@query(
    "a15_series_store",
    """SELECT obs_id, count(*) AS n, min(time) AS first, max(time) AS last,
    string_agg(coalesce(printf('%.6f', sst), '-'), ',' ORDER BY time) AS "values" FROM series GROUP BY obs_id""",
    ["series"],
)
def series_store(spark, sf):
    obs, grid = _labelled(spark, sf), _plain_grid(spark, sf)
    kept = store.SeriesStore(spark, shared_folder(spark, "series"), "window-31")

    def build(new):
        return filters.drop_empty_series(series.series_for(new, grid).dropna(subset=["series"]))

    kept.compute(obs.where("year < 1998"), build)
    rows = kept.compute(obs, build)
    return rows.select(
        "obs_id", F.size("series").cast("bigint").alias("n"), F.get("series", 0)["time"].alias("first"),
        F.element_at("series", -1)["time"].alias("last"),
        F.array_join(F.transform("series.sst", lambda x: F.coalesce(F.format_string("%.6f", x), F.lit("-"))), ",").alias("values"),
    )


@query(
    "a16_store_key",
    f"""WITH h AS (SELECT substr(md5(concat(printf('%.6f', latitude), '|', printf('%.6f', longitude), '|', date::VARCHAR, '|', {_LABEL})), 1, 15) AS hex FROM dated),
    d AS (SELECT concat(count(*), ':', sum(list_sum(list_transform(range(1, 16), lambda i: (strpos('0123456789abcdef', hex[i]) - 1)::HUGEINT * (1::HUGEINT << (4 * (15 - i))::INT))))::VARCHAR) AS digest FROM h)
    SELECT substr(md5('{{"method": "nearest", "var": "SST", "window_days": 31}}|' || digest), 1, 16) AS store_key FROM d""",
    ["dated"],
)
def store_key(spark, sf):
    config = {"var": v.VAR, "window_days": 31, "method": "nearest"}
    return store.store_key(config, _labelled(spark, sf))


@query("a18_clear_store", "SELECT obs_id FROM observations WHERE false", ["observations"])
def clear_store(spark, sf):
    obs = _labelled(spark, sf)
    kept = store.FeatureStore(spark, shared_folder(spark, "features"), "cleared")
    kept.compute(obs, lambda new: new.select("obs_id"))
    kept.clear()
    return kept.read()


@query("a19_save_results", SUMMARY_SQL, ["scored", "ranked"])
def save_results(spark, sf):
    path = shared_folder(spark, "results")
    scored = v.scored(spark, sf)
    results.save_results(
        {"summary": ev.summary(scored), "confusion_matrix": ev.confusion_matrix(scored, ["model"])}, path
    )
    numbers = ("accuracy", "roc_auc", "average_precision", "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1")
    schema = "model string, " + ", ".join(f"{n} double" for n in numbers)
    return rounded(spark.read.csv(f"{path}/summary_table", header=True, schema=schema))
