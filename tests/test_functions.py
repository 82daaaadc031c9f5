"""Golden rows for parsers, dates, tile names, geodesy and lookups."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from thermocline.functions import dates, geometry, lookup, parsing
from thermocline.functions.missing import require_columns, without_nan


def _apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_range(spark):
    got = _apply(spark, ["10-20", "12%", "7", "-5", "10-20-30", "abc", "5d", " 3 - 4 ", None, "1e2", "10%-20%"], parsing.parse_range)
    pairs = [(r["min"], r["max"]) for r in got]
    none = (None, None)
    assert pairs == [(10, 20), (12, 12), (7, 7), none, (10, 20), none, none, (3, 4), none, (100, 100), (10, 20)]


def test_parse_percentage_clamps(spark):
    got = _apply(spark, ["10-20%", "150%", "-5", None, "90-120"], parsing.parse_percentage)
    assert [(r["min"], r["max"]) for r in got] == [(10, 20), (100, 100), (None, None), (None, None), (90, 100)]


def test_parse_depth(spark):
    texts = ["30 ft", "10-20ft", ">5m", "3-5m", "abc", "1-2-3ft", "<4 m", "5ð7", "+8", None]
    got = _apply(spark, texts, parsing.parse_depth)
    means = [None if r["mean"] is None else round(r["mean"], 6) for r in got]
    assert means == [9.144, 4.572, 5.0, 4.0, None, None, 4.0, 6.0, 8.0, None]
    assert (got[3]["min"], got[3]["max"]) == (3, 5)
    assert round(got[1]["min"], 6) == 3.048


def test_severity_band(spark):
    got = _apply(spark, [0.0, 9.99, 10.0, 20.0, 100.0, 101.0, None], parsing.severity_band, "double")
    assert got == ["low", "low", "uncertain", "high", "high", None, None]


def test_parse_date(spark):
    got = _apply(spark, ["2012", "201203", "20120305", "2012-03-05T12:00:00Z", None], dates.parse_date)
    assert [str(d) for d in got] == ["2012-01-01", "2012-03-01", "2012-03-05", "2012-03-05", "None"]
    with pytest.raises(Exception, match="Invalid date format"):
        _apply(spark, ["12345"], dates.parse_date)


def test_file_names(spark):
    name = "a/b/SST_2003-01-01_2003-01-31.nc"
    got = _apply(spark, [name], dates.file_dates)[0]
    assert (str(got["start"]), str(got["end"])) == ("2003-01-01", "2003-01-31")
    assert _apply(spark, [name, "x/none.nc"], dates.year_in_name) == [2003, None]
    with pytest.raises(Exception, match="No start and end date"):
        _apply(spark, ["SST_2003-01-01.nc"], dates.file_dates)


def test_patch_names(spark):
    got = _apply(spark, ["patch_-40_-20_160_180", "patch_1_2_3", "other_1_2_3_4", "patch_a_1_2_3"], geometry.patch_bounds)
    assert tuple(got[0]) == (-40, -20, 160, 180) and got[1:] == [None, None, None]
    df = spark.createDataFrame([(-40.0, -20.0, 160.0, 180.0)], "a double, b double, c double, d double")
    assert df.select(geometry.patch_name(*[F.col(c) for c in "abcd"])).first()[0] == "patch_-40_-20_160_180"


def test_meridian_meters(spark):
    # One degree of latitude: 110,574 m at the equator, 111,694 m next to the pole.
    got = _apply(spark, [0.0, 89.0], lambda c: geometry.meridian_meters(c, 1.0), "double")
    assert math.isclose(got[0], 110574.4, abs_tol=1) and math.isclose(got[1], 111693.9, abs_tol=1)


@pytest.mark.parametrize("spacing", ["even", "uneven", "single"])
def test_lookup_against_bisect(spark, spacing):
    rng = random.Random(5)
    axis = {
        "even": [i * 0.05 for i in range(200)],
        "uneven": sorted({round(rng.uniform(0, 10) ** 2, 3) for _ in range(150)}),
        "single": [4.0],
    }[spacing]
    values = [rng.uniform(-5, 110) for _ in range(300)] + axis[:50] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    arr = F.array(*[F.lit(a) for a in axis])
    rows = df.withColumn("axis", arr).select(
        "v", lookup.count_at_most(F.col("axis"), F.col("v")).alias("n"), lookup.nearest_entry(F.col("axis"), F.col("v")).alias("near")
    ).collect()
    for row in rows:
        if row["v"] is None:
            assert row["n"] is None and row["near"] is None
        else:
            assert row["n"] == bisect.bisect_right(axis, row["v"])
            assert abs(row["near"] - row["v"]) <= min(abs(a - row["v"]) for a in axis) + 1e-12


def test_nearest_tie_goes_down(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-3.0,), (9.0,)], "v double")
    near = df.select(lookup.nearest_entry(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.col("v"))).collect()
    assert [r[0] for r in near] == [0.0, 1.0, 0.0, 2.0]


def test_missing_rules(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r["x"] for r in without_nan(df).orderBy("k").collect()] == [None, 2.0]
    with pytest.raises(ValueError, match="Missing required columns"):
        require_columns(df, "x", "latitude")
