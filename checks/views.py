"""Stand-in views over the TPC-H-like tables: a daily grid, observations, polygons, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.geometry import patch_name
from thermocline.operators.clean import clean_observations
from thermocline.plans.heat_stress import climatology, warmest_month

VAR = "SST"
CELL = ("cell",)
FIRST_YEAR, LAST_YEAR, TARGET_YEAR = 1995, 2001, 1997
REGION_CODES = ("gbr", "enso3", "waus", "pg", "unnamed")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lat(cell: Column) -> Column:
    return F.lit(-20.0) + F.lit(0.5) * F.floor(cell / 5)


def _lon(cell: Column) -> Column:
    return F.lit(140.0) + F.lit(0.5) * (cell % 5)


def grid_daily(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    homes = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    daily = (
        lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("cell"), F.col("l_shipdate").alias("time"))
        .agg((F.lit(20.0) + F.avg("l_quantity") / 5.0).alias("sst"))
    )
    return daily.select(
        "cell", _lat(F.col("cell")).alias("latitude"), _lon(F.col("cell")).alias("longitude"), "time",
        F.year("time").alias("year"), "sst",
    )


def grid_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The daily grid with missing values made on some days."""
    gap = (F.dayofmonth("time") + F.col("cell")) % 29 == 0
    return grid_daily(spark, sf).withColumn("sst", F.when(~gap, F.col("sst")))


def grid_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Grid values per supplier: several sources for one cell and day."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    homes = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("cell"), F.col("l_shipdate").alias("time"), F.col("l_suppkey").alias("source_order"))
        .agg((F.lit(20.0) + F.avg("l_quantity") / 5.0).alias("sst"))
        .select(
            "time", _lat(F.col("cell")).alias("latitude"), _lon(F.col("cell")).alias("longitude"),
            "source_order", "sst",
        )
    )


def grid_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(
        F.col("user_id").alias("cell"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")
    ).agg(F.avg("value").alias("sst"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Raw observations with messy text and some missing months and latitudes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, cust, cell = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    x = F.floor(F.col("o_totalprice") / 5000.0)
    y, n = F.floor(x / 2), key % 40 + 1

    def text(*parts) -> Column:
        return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])

    bleached = (
        F.when(key % 6 == 0, text(x, "-", x + 10, "%"))
        .when(key % 6 == 1, text(x, "%"))
        .when(key % 6 == 2, text(x))
        .when(key % 6 == 3, text("  ", x, "-", x + 5, " "))
        .when(key % 6 == 5, text("-", x))
    )
    depth = (
        F.when(cust % 7 == 0, text(n, "m"))
        .when(cust % 7 == 1, text(n, " ft"))
        .when(cust % 7 == 2, text(n, "-", n + 5, "ft"))
        .when(cust % 7 == 3, text(">", n))
        .when(cust % 7 == 4, text(n, "-", n + 5))
        .when(cust % 7 == 5, text("<", n, " m"))
    )
    mortality = (
        F.when(cust % 5 == 0, text(y, "%")).when(cust % 5 == 1, text(y, "-", y + 5, "%"))
        .when(cust % 5 == 2, text("abc")).when(cust % 5 == 4, text(y))
    )
    return joined.select(
        key.alias("obs_id"), F.year("o_orderdate").alias("year"),
        F.when(key % 97 != 0, F.month("o_orderdate")).alias("month"),
        F.when(key % 89 != 0, _lat(cell) + F.lit(0.05) * (key % 9 - 4)).alias("latitude"),
        (_lon(cell) + F.lit(0.05) * (F.floor(key / 9) % 9 - 4)).alias("longitude"),
        bleached.alias("percent_bleached"), depth.alias("depth"), mortality.alias("percent_mortality"),
    )


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_observations(observations(spark, sf))


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with a place and the first of their month as date, for series."""
    obs = clean_observations(observations(spark, sf), use_month=True)
    return obs.where(F.col("date").isNotNull() & F.col("latitude").isNotNull()).select(
        "obs_id", "year", "month", "latitude", "longitude", "date", "min_percent_bleached", "mean_percent_bleached"
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One point per nation, the middle of its observations."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("site")).agg(
        F.round(_lat(F.col("c_nationkey")) + F.avg(F.lit(0.05) * (F.col("o_orderkey") % 9 - 4)), 4).alias("latitude"),
        F.round(_lon(F.col("c_nationkey")) + F.avg(F.lit(0.05) * (F.floor(F.col("o_orderkey") / 9) % 9 - 4)), 4).alias("longitude"),
    )


def monthly_lines(spark: SparkSession, sf: str) -> DataFrame:
    return climatology(grid_daily(spark, sf), CELL, years=None, target=TARGET_YEAR)


def static(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum monthly mean and its month per cell."""
    return warmest_month(grid_daily(spark, sf), CELL, years=None, target=TARGET_YEAR)


def static_located(spark: SparkSession, sf: str) -> DataFrame:
    return static(spark, sf).select(
        _lat(F.col("cell")).alias("latitude"), _lon(F.col("cell")).alias("longitude"), "mmm", "month_of_mmm"
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """One file per unit tile and month of the grid, with gaps and some empty files."""
    low_lat, low_lon = F.floor("latitude").cast("double"), F.floor("longitude").cast("double")
    files = (
        grid_daily(spark, sf)
        .groupBy(
            patch_name(low_lat, low_lat + 1, low_lon, low_lon + 1).alias("patch"),
            F.trunc(F.to_date("time"), "MM").alias("_first"),
        )
        .agg(F.count("*").alias("_n"), F.min(F.trunc(F.to_date("time"), "MM")).alias("_month"))
        .where(F.month("_first") % 5 != 0)
        # The month as an aggregate's result: filters on what names say stay above the aggregate, on files instead of grid lines.
        .select("patch", F.col("_month").alias("_first"), "_n")
    )
    first, last = F.date_format("_first", "yyyy-MM-dd"), F.date_format(F.last_day("_first"), "yyyy-MM-dd")
    return files.select(
        F.concat("patch", F.lit(f"/{VAR}_"), first, F.lit("_"), last, F.lit(".nc")).alias("path"),
        F.lit(VAR).alias("var"), "patch", F.year("_first").alias("year"), F.col("_first").alias("start"),
        F.last_day("_first").alias("end"),
        F.when(F.month("_first") % 7 == 0, F.lit(0).cast("bigint")).otherwise(F.col("_n") * 8).alias("bytes"),
    )


def boxes_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Box and date span of each year's observations."""
    placed = observations(spark, sf).where(F.col("latitude").isNotNull())
    return placed.groupBy("year").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Region outlines, one per row of cells: a grown rectangle with a cut corner; two overlap."""
    bands = grid_daily(spark, sf).groupBy("latitude").agg(F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    band = F.floor((F.col("latitude") + 20.0) / 0.5).cast("int")
    y0 = F.col("latitude") - 0.1
    y1 = F.col("latitude") + F.when(band == 1, 0.6).otherwise(0.1)
    x0, x1 = F.col("w") - 0.1, F.col("e") + 0.1
    corners = [(x0, y0), (x1, y0), (x1, y1 - 0.05), (x1 - 0.05, y1), (x0, y1)]
    outline = F.array(*[F.struct(y.alias("lats"), x.alias("lons")) for x, y in corners])
    codes = F.array(*[F.lit(c) for c in REGION_CODES])
    return bands.select(F.get(codes, band).alias("region"), F.posexplode(outline).alias("seq", "_at")).select(
        "region", "seq", "_at.lats", "_at.lons"
    )


def polygon_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).select(
        F.col("region").alias("polygon_id"), F.lit(0).alias("ring_id"), "seq",
        F.col("lons").alias("lon"), F.col("lats").alias("lat"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).where(F.col("latitude").isNotNull()).select("obs_id", "latitude", "longitude")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 2)
    joined = labels.join(docs, "doc_id").withColumn("score", score)
    return joined.select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("prediction"),
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("model"), F.col("quality").alias("label")),
                F.struct(F.lit("b").alias("model"), F.col("toxic").alias("label")),
            )
        ),
    )
