"""Cleaning, filters, year rule and the named steps."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.operators import clean, filters, summaries
from thermocline.plans.observations import ESSENTIAL, prepare_observations


def test_cleaners_registry(spark):
    df = spark.createDataFrame([("10-20%",), (None,)], "x string")
    assert clean.apply_cleaner(df, "x", "percentage").first()["x"]["max"] == 20.0
    clean.register_cleaner("twice", lambda v: None if pd.isna(v) else v * 2, "string")
    assert [r["x"] for r in clean.apply_cleaner(df, "x", "twice").collect()] == ["10-20%10-20%", None]
    with pytest.raises(ValueError, match="Unknown cleaner"):
        clean.apply_cleaner(df, "x", "nothing")


def test_clean_observations_types(spark):
    raw = spark.createDataFrame([(2010, 3, -5.0, "10-20"), (2011, 4, 150.0, None)], "YEAR int, Month int, percent_bleached double, Depth string")
    got = clean.clean_observations(raw).orderBy("year").collect()
    assert str(got[0]["date"]) == "2010-01-01"
    assert got[0]["min_percent_bleached"] == 0.0 and got[1]["mean_percent_bleached"] == 100.0
    assert got[0]["depth"] == 15.0 and got[1]["depth"] is None
    assert "min_percent_mortality" not in got[0].asDict()
    assert str(clean.clean_observations(raw, use_month=True).orderBy("year").first()["date"]) == "2010-03-01"


def test_cleaning_accepts_a_stream(spark, tmp_path):
    schema = "year int, month int, percent_bleached string"
    spark.createDataFrame([(2010, 3, "30%")], schema).write.parquet(str(tmp_path / "in"))
    stream = filters.with_presence(clean.clean_observations(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    run = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    run.awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["bleach_presence"] == 1 and row["mean_percent_bleached"] == 30.0


def test_presence_and_uncertain(spark):
    rows = [(1, 5.0, 15.0), (2, 20.0, 30.0), (3, 5.0, 10.0), (4, None, None), (5, 19.9, 19.9)]
    df = spark.createDataFrame(rows, "k int, min_percent_bleached double, max_percent_bleached double")
    assert [r["bleach_presence"] for r in filters.with_presence(df).orderBy("k").collect()] == [0, 1, 0, 0, 0]
    assert [r["k"] for r in filters.drop_uncertain(df).orderBy("k").collect()] == [2, 3, 4]


def test_exposure_period(spark):
    df = spark.createDataFrame([(2, 12), (12, 12), (11, 12), (3, 12), (4, 12), (1, None)], "month int, mmm_i int")
    assert sorted(r["month"] for r in filters.in_exposure_period(df).collect()) == [11, 12]
    assert sorted(r["month"] for r in filters.in_exposure_period(df, wrap=True).collect()) == [2, 3, 11, 12]


def _years(spark, counts):
    return spark.createDataFrame([(y,) for y, n in counts.items() for _ in range(n)], "year int")


def test_year_suffix(spark):
    def kept(counts):
        return {r["year"] for r in summaries.years_with_enough(_years(spark, counts)).distinct().collect()}

    assert kept({2014: 120, 2015: 50, 2016: 130, 2017: 110}) == {2016, 2017}
    assert kept({2010: 100, 2017: 110}) == {2010, 2017}
    assert kept({2016: 200, 2017: 99}) == set()


def test_histogram_matches_numpy(spark):
    numpy = pytest.importorskip("numpy")
    values = [float((i * 37) % 101) for i in range(400)] + [0.0, 100.0, 100.0]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    got = [r["n"] for r in summaries.histogram(df, "x").orderBy("bin").collect()]
    assert got == list(numpy.histogram(values, 10)[0])
    flat = summaries.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").orderBy("bin").collect()
    assert [r["n"] for r in flat] == list(numpy.histogram([2.0, 2.0], 10)[0])


def _raw(spark):
    rows = [(i, 2000 + i % 3, 1 + i % 12 if i % 10 else None, 0.1, 0.2, "30%" if i % 4 else None) for i in range(600)]
    raw = spark.createDataFrame(rows, "obs_id int, year int, month int, latitude double, longitude double, percent_bleached string")
    field = spark.createDataFrame([(0.0, 0.0, 3), (0.0, 1.0, 4), (1.0, 0.0, None)], "latitude double, longitude double, month_of_mmm int")
    return clean.clean_observations(raw), field


def test_steps_and_counts(spark):
    obs, field = _raw(spark)
    counts = {}
    result = prepare_observations(obs, ["bleach_labels", "remove_uncertain_bleach_presence"], month_of_mmm=field, counts=counts)
    rows = result.collect()
    assert list(counts) == [*ESSENTIAL, "remove_uncertain_bleach_presence"]
    assert counts["essential_nans"].get["n"] == 540
    assert len(rows) == counts["years_obs_count"].get["n"] == sum(1 for i in range(600) if i % 10 and i % 4)
    assert {r["mmm_i"] for r in rows} == {3}


def test_unknown_and_incomplete_steps(spark):
    obs, field = _raw(spark)
    with pytest.raises(ValueError, match="Unknown step"):
        prepare_observations(obs, ["nothing"], month_of_mmm=field)
    with pytest.raises(ValueError, match="reef polygons"):
        prepare_observations(obs, ["reef_areas"], month_of_mmm=field)
    only = prepare_observations(obs, ["bleach_labels"], essential=False)
    assert only.count() == 600 and "bleach_presence" in only.columns


def test_empty_series_dropped(spark):
    df = spark.createDataFrame([(1, [(None,), (2.0,)]), (2, [(None,)]), (3, [])], "k int, series array<struct<sst:double>>")
    assert [r["k"] for r in filters.drop_empty_series(df).collect()] == [1]
    assert df.withColumn("f", F.lit(1)).count() == 3
