"""Climatology, heat stress, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query, rounded
from thermocline.operators import climatology as clim
from thermocline.operators import filters, heat, series, summaries
from thermocline.plans import heat_stress

SETTINGS = {"years": None, "target": v.TARGET_YEAR}


@query(
    "c07_time_slice",
    "SELECT cell, time, round(sst, 6) AS sst FROM grid_daily WHERE time >= DATE '1996-03-01' AND time < DATE '1997-07-01'",
    ["grid_daily"],
)
def time_slice(spark, sf):
    return rounded(filters.time_slice(v.grid_daily(spark, sf), "1996-03-01", "1997-06-30").select("cell", "time", "sst"))


@query(
    "c07_time_slice_year",
    "SELECT cell, time FROM grid_daily WHERE time >= DATE '1996-01-01' AND time < DATE '1998-01-01'",
    ["grid_daily"],
)
def time_slice_year(spark, sf):
    return filters.time_slice(v.grid_daily(spark, sf), "1996", "1997").select("cell", "time")


@query(
    "c07_time_slice_month",
    "SELECT cell, time FROM grid_daily WHERE time >= DATE '1996-03-01' AND time < DATE '1997-01-01'",
    ["grid_daily"],
)
def time_slice_month(spark, sf):
    return filters.time_slice(v.grid_daily(spark, sf), "1996-03", "1996-12").select("cell", "time")


@query(
    "c08_bbox",
    """SELECT cell, time, round(sst, 6) AS sst FROM grid_daily
    WHERE latitude BETWEEN -19.5 AND -18.5 AND longitude BETWEEN 140.5 AND 142""",
    ["grid_daily"],
)
def bbox(spark, sf):
    return rounded(filters.bbox(v.grid_daily(spark, sf), (-19.5, -18.5), (140.5, 142.0)).select("cell", "time", "sst"))


@query(
    "c08_case_study_area",
    """SELECT latitude, longitude, count(*) AS n FROM grid_daily
    WHERE latitude BETWEEN -20 AND -10 AND longitude BETWEEN 140 AND 150 GROUP BY 1, 2""",
    ["grid_daily"],
)
def case_study(spark, sf):
    return summaries.row_count(filters.case_study_area(v.grid_daily(spark, sf)), ["latitude", "longitude"])


@query(
    "e01_monthly_means",
    "SELECT cell, month_end, round(sst, 8) AS sst, year, month FROM monthly",
    ["monthly"],
)
def monthly_means(spark, sf):
    return rounded(clim.monthly_means(v.grid_daily(spark, sf), v.CELL), 8)


@query(
    "e01_monthly_means_dense",
    """WITH sparse AS (SELECT cell, last_day(time) AS month_end, avg(sst) AS sst FROM grid_gaps WHERE year(time) % 2 = 1 GROUP BY 1, 2),
    span AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(month_end)), max(month_end), INTERVAL 1 MONTH))::DATE) AS month_end FROM sparse),
    frame AS (SELECT cell, s.month_end FROM (SELECT DISTINCT cell FROM sparse), span s)
    SELECT cell, f.month_end, round(sst, 8) AS sst, year(f.month_end)::INT AS year, month(f.month_end)::INT AS month
    FROM frame f LEFT JOIN sparse USING (cell, month_end)""",
    ["grid_gaps"],
)
def monthly_means_dense(spark, sf):
    odd_years = v.grid_gaps(spark, sf).where(F.col("year") % 2 == 1)
    return rounded(clim.monthly_means(odd_years, v.CELL, densify=True), 8)


@query(
    "e02_monthly_climatology",
    """SELECT cell, month(time)::INT AS month, round(avg(sst), 8) AS sst FROM grid_daily
    WHERE year(time) BETWEEN 1995 AND 2001 GROUP BY 1, 2""",
    ["grid_daily"],
)
def monthly_climatology(spark, sf):
    return rounded(clim.monthly_climatology(v.grid_daily(spark, sf), v.FIRST_YEAR, v.LAST_YEAR, v.CELL), 8)


@query(
    "e03_regress_climatology",
    "SELECT cell, month, round(slope, 8) AS slope, round(intercept, 7) AS intercept FROM lines",
    ["lines"],
)
def regress(spark, sf):
    lines = clim.regress_climatology(clim.monthly_means(v.grid_daily(spark, sf), v.CELL), keys=v.CELL)
    return lines.select("cell", "month", F.round("slope", 8).alias("slope"), F.round("intercept", 7).alias("intercept"))


@query(
    "e03_regress_climatology_reference",
    """WITH m AS (SELECT cell, year(time)::INT AS year, month(time)::INT AS month, avg(sst) AS sst FROM grid_gaps
      WHERE NOT (cell % 3 = 0 AND year(time) = 1998) GROUP BY 1, 2, 3),
    axis AS (SELECT month, avg(year) AS mx, var_pop(year) AS vx FROM (SELECT DISTINCT month, year FROM m) GROUP BY month),
    fit AS (SELECT cell, month, covar_pop(sst, year) / any_value(vx) AS slope, avg(sst) AS my, any_value(mx) AS mx
      FROM m JOIN axis USING (month) GROUP BY cell, month)
    SELECT cell, month, round(slope, 8) AS slope, round(my - slope * mx, 7) AS intercept FROM fit""",
    ["grid_gaps"],
)
def regress_reference(spark, sf):
    grid = v.grid_gaps(spark, sf).where(~((F.col("cell") % 3 == 0) & (F.col("year") == 1998)))
    lines = clim.regress_climatology(clim.monthly_means(grid, v.CELL), "reference", v.CELL)
    return lines.select("cell", "month", F.round("slope", 8).alias("slope"), F.round("intercept", 7).alias("intercept"))


@query(
    "e04_predict_climatology",
    "SELECT cell, month, round(prediction, 7) AS prediction FROM lines",
    ["lines"],
)
def predict(spark, sf):
    return rounded(heat_stress.climatology(v.grid_daily(spark, sf), v.CELL, **SETTINGS).select("cell", "month", "prediction"), 7)


@query(
    "e05_epoch_midpoint",
    """WITH years AS (SELECT DISTINCT year FROM grid_daily WHERE year IN (1995, 1996, 1997, 1998, 1999, 2000, 2001)),
    mid AS (SELECT avg(year) AS x FROM years)
    SELECT cell, month, round(regr_intercept(sst, year) + regr_slope(sst, year) * any_value(x), 7) AS prediction
    FROM monthly, mid GROUP BY cell, month""",
    ["monthly"],
)
def epoch_midpoint(spark, sf):
    target = clim.epoch_midpoint(range(v.FIRST_YEAR, v.LAST_YEAR + 1))
    lines = heat_stress.climatology(v.grid_daily(spark, sf), v.CELL, years=None, target=target)
    return rounded(lines.select("cell", "month", "prediction"), 7)


@query("e06_mmm", "SELECT cell, round(mmm, 7) AS mmm FROM static", ["static"])
def mmm(spark, sf):
    return rounded(clim.mmm(v.monthly_lines(spark, sf), v.CELL), 7)


@query("e07_month_of_mmm", "SELECT cell, month_of_mmm FROM static", ["static"])
def month_of_mmm(spark, sf):
    return clim.month_of_mmm(v.monthly_lines(spark, sf), v.CELL)


@query("e08_field_mean", "SELECT time, round(avg(sst), 8) AS sst FROM grid_daily GROUP BY time", ["grid_daily"])
def field_mean(spark, sf):
    return rounded(clim.field_mean(v.grid_daily(spark, sf)), 8)


@query(
    "e09_years_with_enough",
    """WITH moved AS (SELECT obs_id, CASE WHEN year = 1997 AND obs_id % 2 = 0 THEN 1998 ELSE least(year, 2000) END AS year FROM cleaned),
    counts AS (SELECT year, count(*) AS n FROM moved GROUP BY year),
    marked AS (SELECT year, min((n >= (SELECT avg(n) * 0.6 FROM counts))::INT) OVER (ORDER BY year DESC) AS ok FROM counts)
    SELECT obs_id, year FROM moved WHERE year IN (SELECT year FROM marked WHERE ok = 1)""",
    ["cleaned"],
)
def years_with_enough(spark, sf):
    # The partial last year joins the one before and half of 1997 moves on, so that a year in the middle fails at every scale.
    year = F.when((F.col("year") == 1997) & (F.col("obs_id") % 2 == 0), 1998).otherwise(F.least("year", F.lit(2000)))
    moved = v.cleaned(spark, sf).withColumn("year", year)
    counts = moved.groupBy("year").agg(F.count("*").alias("n"))
    threshold = counts.agg(F.avg("n") * 0.6).scalar()
    return summaries.years_with_enough(moved, threshold).select("obs_id", "year")


@query(
    "e12_bounds",
    "SELECT min(latitude) AS min_latitude, max(latitude) AS max_latitude FROM observations",
    ["observations"],
)
def bounds(spark, sf):
    return summaries.bounds(v.observations(spark, sf), "latitude")


@query(
    "e13_class_counts",
    """SELECT CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence, count(*) AS n
    FROM cleaned GROUP BY 1""",
    ["cleaned"],
)
def class_counts(spark, sf):
    return summaries.class_counts(filters.with_presence(v.cleaned(spark, sf)))


_HISTOGRAM = """WITH e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {t}),
    placed AS (SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9)::INT AS bin FROM {t}, e WHERE {c} IS NOT NULL),
    bins AS (SELECT unnest(range(10))::INT AS bin)
    SELECT b.bin, round(lo + b.bin * ((hi - lo) / 10), 6) AS bin_lo, round(lo + (b.bin + 1) * ((hi - lo) / 10), 6) AS bin_hi,
      count(placed.bin) AS n FROM e, bins b LEFT JOIN placed ON placed.bin = b.bin GROUP BY b.bin, lo, hi"""


@query("e14_histogram", _HISTOGRAM.format(c="mean_percent_bleached", t="cleaned"), ["cleaned"])
def histogram(spark, sf):
    return rounded(summaries.histogram(v.cleaned(spark, sf), "mean_percent_bleached"))


@query("e14_histogram_sparse_grid", _HISTOGRAM.format(c="sst", t="grid_sparse"), ["grid_sparse"])
def histogram_sparse(spark, sf):
    return rounded(summaries.histogram(v.grid_sparse(spark, sf), "sst"))


@query("e16_row_count", "SELECT year, count(*) AS n FROM cleaned GROUP BY year", ["cleaned"])
def row_count(spark, sf):
    return summaries.row_count(v.cleaned(spark, sf), ["year"])


@query("d11_f01_hotspot", "SELECT cell, time, round(hotspot, 6) AS hotspot FROM hot", ["hot"])
def hotspot(spark, sf):
    return rounded(heat.hotspot(v.grid_daily(spark, sf), v.static(spark, sf), v.CELL).select("cell", "time", "hotspot"))


@query(
    "f01_hotspot_gaps",
    """SELECT cell, time, round(CASE WHEN g.sst - mmm > 0 THEN g.sst - mmm ELSE 0.0::DOUBLE END, 6) AS hotspot
    FROM grid_gaps g JOIN static USING (cell)""",
    ["grid_gaps", "static"],
)
def hotspot_gaps(spark, sf):
    return rounded(heat.hotspot(v.grid_gaps(spark, sf), v.static(spark, sf), v.CELL).select("cell", "time", "hotspot"))


_DHW = """SELECT cell, time, round(hotspot, 6) AS hotspot, round({value}, 6) AS dhw FROM (
    SELECT *, sum(strong) OVER (PARTITION BY cell ORDER BY time {frame}) / 7.0::DOUBLE AS d FROM hot)"""
_DAYS = "RANGE BETWEEN INTERVAL 83 DAY PRECEDING AND CURRENT ROW"
_ROWS = "ROWS BETWEEN 83 PRECEDING AND CURRENT ROW"


def _dhw(spark, sf, **policy):
    result = heat_stress.degree_heating_weeks(v.grid_daily(spark, sf), v.CELL, **policy, **SETTINGS)
    return rounded(result.select("cell", "time", "hotspot", "dhw"))


@query("f02_f03_dhw_days", _DHW.format(value="d", frame=_DAYS), ["hot"])
def dhw_days(spark, sf):
    return _dhw(spark, sf)


@query("f03_dhw_rows", _DHW.format(value="d", frame=_ROWS), ["hot"])
def dhw_rows(spark, sf):
    return _dhw(spark, sf, frame="rows")


@query("f03_dhw_zero", _DHW.format(value="coalesce(d, 0)", frame=_DAYS), ["hot"])
def dhw_zero(spark, sf):
    return _dhw(spark, sf, empty="zero")


@query(
    "g05_latest_dhw_in_box",
    """SELECT cell, time, round(d, 6) AS dhw FROM (
      SELECT *, sum(strong) OVER (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 83 DAY PRECEDING AND CURRENT ROW) / 7.0::DOUBLE AS d FROM hot)
    WHERE time = (SELECT max(time) FROM grid_daily) AND latitude BETWEEN -20 AND -10 AND longitude BETWEEN 140 AND 150""",
    ["hot"],
)
def latest_dhw(spark, sf):
    weeks = heat_stress.degree_heating_weeks(v.grid_daily(spark, sf), v.CELL, **SETTINGS)
    return rounded(filters.case_study_area(heat.latest(weeks)).select("cell", "time", "dhw"))


@query(
    "g05_latest",
    "SELECT cell, time, round(sst, 6) AS sst FROM grid_daily WHERE time = (SELECT max(time) FROM grid_daily)",
    ["grid_daily"],
)
def latest(spark, sf):
    return rounded(heat.latest(v.grid_daily(spark, sf)).select("cell", "time", "sst"))


@query(
    "f04_rolling_averages",
    """SELECT cell, time, round(sst, 6) AS sst, """
    + ", ".join(
        f"round(CASE WHEN count(sst) OVER w{w} = {w} THEN avg(sst) OVER w{w} END, 6) AS mean_{w}" for w in (30, 90, 180)
    )
    + " FROM grid_gaps WINDOW "
    + ", ".join(
        f"w{w} AS (PARTITION BY cell ORDER BY time ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (30, 90, 180)
    ),
    ["grid_gaps"],
)
def rolling(spark, sf):
    grid = v.grid_gaps(spark, sf).select("cell", "time", "sst")
    return rounded(series.rolling_averages(grid, keys=v.CELL))


@query(
    "f04_rolling_averages_dense",
    """SELECT time, round(sst, 6) AS sst, round(CASE WHEN count(sst) OVER w = 30 THEN avg(sst) OVER w END, 6) AS mean_30
    FROM (SELECT time, avg(sst) AS sst, 1 AS k FROM grid_daily GROUP BY time)
    WINDOW w AS (PARTITION BY k ORDER BY time ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
    ["grid_daily"],
)
def rolling_dense(spark, sf):
    means = clim.field_mean(v.grid_daily(spark, sf)).withColumn("k", F.lit(1))
    return rounded(series.rolling_averages(means, (30,), keys=("k",)).drop("k"))


@query(
    "h01_combine",
    """SELECT cell, time, round(sst, 6) AS sst, CASE WHEN cell % 2 = 0 THEN 'west' END AS side FROM grid_daily""",
    ["grid_daily"],
)
def combine(spark, sf):
    grid = v.grid_daily(spark, sf).select("cell", "time", "sst")
    west = grid.where("cell % 2 = 0").withColumn("side", F.lit("west"))
    return rounded(summaries.combine([west, grid.where("cell % 2 = 1")]))


@query("h03_distinct_years", "SELECT DISTINCT year FROM grid_daily", ["grid_daily"])
def distinct_years(spark, sf):
    return summaries.distinct_years(v.grid_daily(spark, sf))


@query(
    "l11_regression_metrics",
    """WITH clim AS (SELECT cell, month(time) AS month, avg(sst) AS yhat FROM grid_daily GROUP BY 1, 2),
    rows AS (SELECT cell, time, sst, yhat FROM grid_daily g JOIN clim c USING (cell) WHERE month(g.time) = c.month),
    moved AS (SELECT *, sign(sst - lag(sst) OVER w) = sign(yhat - lag(yhat) OVER w) AS agrees FROM rows
      WINDOW w AS (PARTITION BY cell ORDER BY time))
    SELECT round(avg(abs(sst - yhat)), 6) AS mae, round(sqrt(avg((sst - yhat) ** 2)), 6) AS rmse,
      round(avg(abs(sst - yhat) / abs(sst)) * 100, 6) AS mape,
      round(1 - avg((sst - yhat) ** 2) / var_pop(sst), 6) AS r2,
      round(avg(agrees::INT), 6) AS directional_accuracy FROM moved""",
    ["grid_daily"],
)
def regression_metrics(spark, sf):
    from thermocline.operators.evaluation import regression_metrics as metrics

    grid = v.grid_daily(spark, sf)
    clim_ = clim.monthly_climatology(grid, v.FIRST_YEAR, v.LAST_YEAR, v.CELL).withColumnRenamed("sst", "yhat")
    rows = grid.withColumn("month", F.month("time")).join(clim_, ["cell", "month"])
    return rounded(metrics(rows, "sst", "yhat", v.CELL))
