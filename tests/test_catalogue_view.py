"""The stand-in catalogue: names are parsed per file."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

from checks import views as v
from thermocline.sources import catalogue as cat


def test_filters_on_names_stay_above_the_grouping_of_files(spark, tmp_path):
    days = [datetime(1996, 1, 1) + timedelta(days=9 * k) for k in range(120)]
    spark.createDataFrame(
        [(k % 3, day, float(k % 7)) for k, day in enumerate(days)],
        T.StructType([
            T.StructField("l_suppkey", T.LongType()), T.StructField("l_shipdate", T.TimestampNTZType()), T.StructField("l_quantity", T.DoubleType()),
        ]),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 0), (1, 7), (2, 24)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    files = cat.with_file_dates(v.catalogue(spark, str(tmp_path)).select("path"))
    found = cat.filter_files(files, "199602", "1998-12-31T12:00:00Z").select("path")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ".nc" in plan and ".nc" not in plan[plan.index("Aggregate"):]
    months = {(d.year, d.month) for d in days if d >= datetime(1996, 2, 1) and d.month % 5}
    assert {tuple(map(int, r["path"].split("SST_")[1].split("-")[:2])) for r in found.collect()} == months
