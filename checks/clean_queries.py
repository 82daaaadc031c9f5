"""Cleaning, predicates, labels and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query, rounded
from checks.view_sql import depth_ends, percent_ends, range_ends
from thermocline.functions import dates, geometry, parsing
from thermocline.operators import clean, filters, sampling
from thermocline.plans.observations import ESSENTIAL, determine_mmm, prepare_observations

_RANGE, _PERCENT, _DEPTH = range_ends("percent_bleached"), percent_ends("percent_bleached"), depth_ends("depth")


@query(
    "b01_lower_columns",
    "SELECT n_nationkey AS n_nationkey, n_name, n_regionkey FROM nation",
)
def lower_columns(spark, sf):
    nation = v.table(spark, sf, "nation")
    return clean.lower_columns(nation.toDF(*[c.upper() for c in nation.columns]))


@query(
    "b02_year_date",
    "SELECT obs_id, make_date(year, 1, 1) AS date FROM observations",
    ["observations"],
)
def year_date(spark, sf):
    return clean.with_year_date(v.observations(spark, sf)).select("obs_id", "date")


@query(
    "b02_month_date",
    "SELECT obs_id, CASE WHEN month IS NOT NULL THEN make_date(year, month, 1) END AS date FROM observations",
    ["observations"],
)
def month_date(spark, sf):
    return clean.with_year_date(v.observations(spark, sf), use_month=True).select("obs_id", "date")


@query(
    "b03_parse_range",
    f"SELECT obs_id, {_RANGE[0]} AS lo, {_RANGE[1]} AS hi FROM observations",
    ["observations"],
)
def parse_range(spark, sf):
    pair = parsing.parse_range(F.col("percent_bleached"))
    return v.observations(spark, sf).select("obs_id", pair["min"].alias("lo"), pair["max"].alias("hi"))


@query(
    "b04_parse_percentage",
    f"SELECT obs_id, {_PERCENT[0]} AS lo, {_PERCENT[1]} AS hi FROM observations",
    ["observations"],
)
def parse_percentage(spark, sf):
    pair = parsing.parse_percentage(F.col("percent_bleached"))
    return v.observations(spark, sf).select("obs_id", pair["min"].alias("lo"), pair["max"].alias("hi"))


@query(
    "b05_b06_i10_parse_depth",
    f"""SELECT obs_id, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo + hi) / 2.0::DOUBLE, 6) AS mean
    FROM (SELECT obs_id, {_DEPTH[0]} AS lo, {_DEPTH[1]} AS hi FROM observations)""",
    ["observations"],
)
def parse_depth(spark, sf):
    metres = parsing.parse_depth(F.col("depth"))
    return rounded(
        v.observations(spark, sf).select(
            "obs_id", metres["min"].alias("lo"), metres["max"].alias("hi"), metres["mean"].alias("mean")
        )
    )


@query(
    "b07_clean_observations",
    """SELECT * REPLACE (round(depth, 6) AS depth, round(min_depth, 6) AS min_depth, round(max_depth, 6) AS max_depth,
      round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, month::DOUBLE AS month) FROM cleaned""",
    ["cleaned"],
)
def clean_observations(spark, sf):
    return rounded(v.cleaned(spark, sf).withColumn("month", F.col("month").cast("double")))


@query(
    "b08_apply_cleaner",
    f"SELECT obs_id, {_PERCENT[1]} AS hi FROM observations",
    ["observations"],
)
def apply_cleaner(spark, sf):
    cleaned = clean.apply_cleaner(v.observations(spark, sf), "percent_bleached", "percentage", "pair")
    return cleaned.select("obs_id", F.col("pair.max").alias("hi"))


@query(
    "k01_register_cleaner",
    "SELECT obs_id, coalesce(length(percent_bleached), -1) AS size, upper(depth) AS shout FROM observations",
    ["observations"],
)
def register_cleaner(spark, sf):
    clean.register_cleaner("shout", F.upper)
    clean.register_cleaner("size", lambda text: -1 if pd.isna(text) else len(text), "bigint")
    named = clean.apply_cleaner(v.observations(spark, sf), "depth", "shout", "shout")
    return clean.apply_cleaner(named, "percent_bleached", "size", "size").select("obs_id", "size", "shout")


@query(
    "c01_drop_missing_keys",
    "SELECT obs_id FROM observations WHERE month IS NOT NULL AND latitude IS NOT NULL",
    ["observations"],
)
def drop_missing_keys(spark, sf):
    return filters.drop_missing_keys(v.observations(spark, sf)).select("obs_id")


@query(
    "c02_drop_missing_target",
    "SELECT obs_id, mean_percent_bleached FROM cleaned WHERE mean_percent_bleached IS NOT NULL",
    ["cleaned"],
)
def drop_missing_target(spark, sf):
    return filters.drop_missing_target(v.cleaned(spark, sf)).select("obs_id", "mean_percent_bleached")


@query("c03_max_year", "SELECT obs_id, year FROM observations WHERE year <= 1998", ["observations"])
def max_year(spark, sf):
    return filters.max_year(v.observations(spark, sf), 1998).select("obs_id", "year")


_MMM = """SELECT obs_id, p.month, s.month_of_mmm AS mmm_i FROM observations o LEFT JOIN placed p USING (obs_id)
    LEFT JOIN static_located s ON s.latitude = p._lat AND s.longitude = p._lon"""


@query(
    "c04_drop_missing_mmm",
    f"SELECT obs_id, mmm_i FROM ({_MMM}) WHERE mmm_i IS NOT NULL",
    ["placed", "static_located"],
)
def drop_missing_mmm(spark, sf):
    sampled = determine_mmm(v.observations(spark, sf), v.static_located(spark, sf))
    return filters.drop_missing_mmm(sampled).select("obs_id", "mmm_i")


@query(
    "c05_drop_uncertain",
    """SELECT obs_id FROM cleaned
    WHERE NOT coalesce(max_percent_bleached > 10 AND min_percent_bleached < 20, false)""",
    ["cleaned"],
)
def drop_uncertain(spark, sf):
    return filters.drop_uncertain(v.cleaned(spark, sf)).select("obs_id")


@query(
    "c06_exposure_period",
    f"SELECT obs_id, month, mmm_i FROM ({_MMM}) WHERE month BETWEEN mmm_i - 1 AND mmm_i + 3",
    ["placed", "static_located"],
)
def exposure_period(spark, sf):
    sampled = determine_mmm(v.observations(spark, sf), v.static_located(spark, sf))
    return filters.in_exposure_period(sampled).select("obs_id", "month", "mmm_i")


@query(
    "c06_exposure_period_wrapped",
    f"SELECT obs_id, month, mmm_i FROM ({_MMM}) WHERE (month - mmm_i + 1 + 12) % 12 <= 4",
    ["placed", "static_located"],
)
def exposure_period_wrapped(spark, sf):
    sampled = determine_mmm(v.observations(spark, sf), v.static_located(spark, sf))
    return filters.in_exposure_period(sampled, wrap=True).select("obs_id", "month", "mmm_i")


@query(
    "c10_valid_rows",
    """SELECT obs_id, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence
    FROM cleaned WHERE latitude IS NOT NULL""",
    ["cleaned"],
)
def valid_rows(spark, sf):
    return filters.valid_rows(filters.with_presence(v.cleaned(spark, sf))).select("obs_id", "bleach_presence")


@query(
    "c11_presence",
    """SELECT obs_id, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence FROM cleaned""",
    ["cleaned"],
)
def presence(spark, sf):
    return filters.with_presence(v.cleaned(spark, sf)).select("obs_id", "bleach_presence")


_PREPARED = f"""WITH base AS (SELECT c.*, m.mmm_i FROM cleaned c JOIN ({_MMM}) m USING (obs_id)
      WHERE c.month IS NOT NULL AND c.latitude IS NOT NULL AND mean_percent_bleached IS NOT NULL AND mmm_i IS NOT NULL
        AND c.year <= 2017),
    counts AS (SELECT year, count(*) AS n FROM base GROUP BY year),
    cut AS (SELECT coalesce(max(year) FILTER (n < 100), 0) AS y FROM counts),
    prepared AS (SELECT *, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence
      FROM base, cut WHERE year > y)"""


def _prepared(spark, sf, steps, counts=None):
    return prepare_observations(
        v.cleaned(spark, sf), steps, month_of_mmm=v.static_located(spark, sf),
        polygons=v.polygon_vertices(spark, sf), counts=counts,
    )


@query(
    "k04_prepared_observations",
    _PREPARED
    + """ SELECT obs_id, year, mmm_i, bleach_presence FROM prepared
    WHERE NOT coalesce(max_percent_bleached > 10 AND min_percent_bleached < 20, false)""",
    ["cleaned", "placed", "static_located"],
)
def prepared(spark, sf):
    rows = _prepared(spark, sf, ["bleach_labels", "remove_uncertain_bleach_presence"])
    return rows.select("obs_id", "year", "mmm_i", "bleach_presence")


@query(
    "k04_prepared_in_reef_areas",
    _PREPARED
    + """ SELECT obs_id, year, mmm_i, bleach_presence, polygon_id FROM prepared
    JOIN held USING (obs_id)
    WHERE month BETWEEN mmm_i - 1 AND mmm_i + 3""",
    ["cleaned", "placed", "static_located", "held"],
)
def prepared_in_areas(spark, sf):
    rows = _prepared(spark, sf, ["filter_mmm_exposure_period", "reef_areas"])
    return rows.select("obs_id", "year", "mmm_i", "bleach_presence", "polygon_id")


@query(
    "e15_step_counts",
    _PREPARED
    + """ SELECT 'essential_nans' AS step, count(*) AS n FROM cleaned WHERE month IS NOT NULL AND latitude IS NOT NULL
    UNION ALL SELECT unnest(['bleaching_nans', 'determine_mmm']), count(*) FROM cleaned
      WHERE month IS NOT NULL AND latitude IS NOT NULL AND mean_percent_bleached IS NOT NULL
    UNION ALL SELECT unnest(['filter_missing_sst_data', 'bleach_labels', 'years_2017']), count(*) FROM base
    UNION ALL SELECT 'years_obs_count', count(*) FROM prepared""",
    ["cleaned", "placed", "static_located"],
)
def step_counts(spark, sf):
    counts = {}
    _prepared(spark, sf, None, counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(s, counts[s].get["n"]) for s in ESSENTIAL], "step string, n bigint")


@query(
    "i01_parse_date",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN make_date(year(d), 1, 1) WHEN 1 THEN make_date(year(d), month(d), 1) ELSE d END AS date
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
)
def parse_date(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.date_format(day, "yyyy")).when(key % 4 == 1, F.date_format(day, "yyyyMM"))
        .when(key % 4 == 2, F.date_format(day, "yyyyMMdd"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00Z")))
    )
    return v.table(spark, sf, "orders").select("o_orderkey", dates.parse_date(text).alias("date"))


@query("i02_year_in_name", "SELECT path, year FROM catalogue", ["catalogue"])
def year_in_name(spark, sf):
    return v.catalogue(spark, sf).select("path", dates.year_in_name(F.col("path")).alias("year"))


@query(
    "i03_patch_bounds",
    """SELECT path, string_split(patch, '_')[2]::DOUBLE AS lat0, string_split(patch, '_')[3]::DOUBLE AS lat1,
      string_split(patch, '_')[4]::DOUBLE AS lon0, string_split(patch, '_')[5]::DOUBLE AS lon1 FROM catalogue""",
    ["catalogue"],
)
def patch_bounds(spark, sf):
    return v.catalogue(spark, sf).select("path", geometry.patch_bounds(F.col("patch")).alias("b")).select("path", "b.*")


@query(
    "i04_i05_patch_name",
    """SELECT obs_id, printf('patch_%.0f_%.0f_%.0f_%.0f', floor(latitude / 20) * 20, ceil(latitude / 20) * 20 + 0,
      floor(longitude / 20) * 20, ceil(longitude / 20) * 20) AS patch FROM points""",
    ["points"],
)
def patch_name(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    name = geometry.patch_name(
        geometry.snap(lat, 20), geometry.snap(lat, 20, up=True), geometry.snap(lon, 20), geometry.snap(lon, 20, up=True)
    )
    return v.points(spark, sf).select("obs_id", name.alias("patch"))


@query(
    "i06_box_area",
    "SELECT year, round((lat_max - lat_min) * (lon_max - lon_min), 6) AS area FROM boxes_by_year",
    ["boxes_by_year"],
)
def box_area(spark, sf):
    area = geometry.box_area(*[F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])
    return rounded(v.boxes_by_year(spark, sf).select("year", area.alias("area")))


def _arc(lat: str) -> str:
    n = "(1/298.257223563::DOUBLE / (2 - 1/298.257223563::DOUBLE))"
    return f"""(6378137.0::DOUBLE / (1 + {n})) * ((1 + {n}**2 / 4 + {n}**4 / 64) * radians({lat})
      - 1.5::DOUBLE * ({n} - {n}**3 / 8) * sin(2 * radians({lat})) + 15.0::DOUBLE / 16 * ({n}**2 - {n}**4 / 4) * sin(4 * radians({lat}))
      - 35.0::DOUBLE / 48 * {n}**3 * sin(6 * radians({lat})) + 315.0::DOUBLE / 512 * {n}**4 * sin(8 * radians({lat})))"""


@query(
    "i07_meridian_meters",
    f"SELECT obs_id, round({_arc('(latitude + 0.1::DOUBLE)')} - {_arc('latitude')}, 4) AS metres FROM points",
    ["points"],
)
def meridian_meters(spark, sf):
    metres = geometry.meridian_meters(F.col("latitude"), 0.1)
    return v.points(spark, sf).select("obs_id", F.round(metres, 4).alias("metres"))


@query(
    "i08_month_year",
    "SELECT event_id, month(ts)::INT AS month, year(ts)::INT AS year FROM events",
)
def month_year(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.month("ts").alias("month"), F.year("ts").alias("year"))


@query(
    "i09_severity_band",
    """SELECT obs_id, CASE WHEN m >= 0 AND m < 10 THEN 'low' WHEN m >= 10 AND m < 20 THEN 'uncertain'
      WHEN m >= 20 AND m <= 100 THEN 'high' END AS band FROM (SELECT obs_id, mean_percent_bleached AS m FROM cleaned)""",
    ["cleaned"],
)
def severity_band(spark, sf):
    return v.cleaned(spark, sf).select("obs_id", parsing.severity_band(F.col("mean_percent_bleached")).alias("band"))


@query(
    "d04_unique_axes",
    """SELECT time, latitude, longitude, round(arg_min(sst, source_order), 6) AS sst FROM grid_sources GROUP BY 1, 2, 3""",
    ["grid_sources"],
)
def unique_axes(spark, sf):
    return rounded(sampling.unique_axes(v.grid_sources(spark, sf)))
