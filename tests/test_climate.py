"""Climatology and heat stress on literal rows, against plain Python, and plan shapes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thermocline.operators import climatology as clim
from thermocline.operators import heat, series
from thermocline.operators.filters import time_slice
from thermocline.operators.ordered import with_lead_in, with_position
from thermocline.sources import tables

DAY0 = dt.datetime(2000, 1, 1)


def _grid(spark, rows):
    """rows: (cell, day offset, sst)."""
    data = [(c, DAY0 + dt.timedelta(days=d), s) for c, d, s in rows]
    return spark.createDataFrame(data, "cell int, time timestamp_ntz, sst double")


def _field(spark, *rows):
    return spark.createDataFrame(list(rows), "cell int, mmm double")


def test_dhw_golden(spark):
    grid = _grid(spark, [(1, 0, 29.0), (1, 10, 30.0), (1, 20, 28.8), (1, 30, 29.2), (2, 0, 28.0), (2, 1, None)])
    for frame in ("days", "rows"):
        got = heat.dhw(grid, _field(spark, (1, 28.0), (2, 28.0)), frame=frame, keys=("cell",)).orderBy("cell", "time").collect()
        assert round(got[3]["dhw"], 6) == 0.6
        assert got[4]["dhw"] is None and got[5]["dhw"] is None
        assert got[4]["hotspot"] == 0.0 and got[5]["hotspot"] == 0.0
    zero = heat.dhw(grid, _field(spark, (2, 28.0)), empty="zero", keys=("cell",)).collect()
    assert [r["dhw"] for r in zero] == [0.0, 0.0]


def _plain_dhw(days, values, mmm, frame):
    out = []
    for i, day in enumerate(days):
        if frame == "days":
            window = [values[j] for j in range(i + 1) if day - days[j] <= 83]
        else:
            window = values[max(0, i - 83) : i + 1]
        hot = [v - mmm for v in window if v is not None and v - mmm >= 1]
        out.append(round(sum(hot) / 7, 6) if hot else None)
    return out


@pytest.mark.parametrize("frame", ["days", "rows"])
def test_dhw_across_blocks_matches_plain_python(spark, frame):
    """Long series with gaps, cut into several blocks, and one hot cell with most of the rows."""
    rng = random.Random(3)
    rows, wanted = [], {}
    for cell, length in ((1, 4000), (2, 300)):
        days = [d for d in range(length) if rng.random() < 0.6]
        values = [None if rng.random() < 0.05 else round(rng.uniform(26, 31), 3) for _ in days]
        rows += [(cell, d, v) for d, v in zip(days, values)]
        wanted[cell] = _plain_dhw(days, values, 28.0, frame)
    result = heat.dhw(_grid(spark, rows), _field(spark, (1, 28.0), (2, 28.0)), frame=frame, keys=("cell",))
    for cell in wanted:
        got = [None if r["dhw"] is None else round(r["dhw"], 6) for r in result.where(F.col("cell") == cell).orderBy("time").collect()]
        assert got == wanted[cell]


def test_dhw_frames_agree_on_dense_days_and_are_not_negative(spark):
    rng = random.Random(8)
    grid = _grid(spark, [(1, d, rng.uniform(26, 31)) for d in range(900)])
    field = _field(spark, (1, 28.0))
    days = heat.dhw(grid, field, keys=("cell",)).select("time", F.round("dhw", 6).alias("d"))
    rows = heat.dhw(grid, field, frame="rows", keys=("cell",)).select("time", F.round("dhw", 6).alias("d"))
    assert days.exceptAll(rows).count() == 0 and days.where("d < 0").count() == 0


@pytest.mark.parametrize("shards", [1, 4])
def test_dhw_shuffles_a_big_field_join_and_window_once(spark, shards):
    """Without broadcasts, the grid is exchanged once on the cell for both the join and the window; the field has copies only if asked for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        grid = spark.range(100).select((F.col("id") % 3).cast("int").alias("cell"), F.current_date().cast("timestamp_ntz").alias("time"), F.lit(1.0).alias("sst"))
        plan = heat.dhw(grid, _field(spark, (1, 28.0)), keys=("cell",), shards=shards)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("explode" in plan.split("SortMergeJoin")[1] and "_shard" in plan) == (shards > 1)


def test_tables_stored_by_cell_meet_without_an_exchange(spark, tmp_path):
    rng = random.Random(4)
    rows = _grid(spark, [(c, d, rng.uniform(26, 31)) for c in range(6) for d in range(300)])
    fields = _field(spark, *[(c, 28.0 + c / 10) for c in range(6)])
    want = heat.dhw(rows, fields, keys=("cell",))
    places = {name: f"{tmp_path}/{name}" for name in ("cell_grid", "cell_field")}
    grid = tables.write_by_cell(rows, "cell_grid", places["cell_grid"], ["cell"], 4, ["cell", "time"])
    field = tables.write_by_cell(fields, "cell_field", places["cell_field"], ["cell"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for again in (False, True):
            if again:  # as another session finds them
                schemas = [t.schema.simpleString()[7:-1].replace(":", " ") for t in (grid, field)]
                for name in places:
                    spark.sql(f"DROP TABLE {name}")
                grid = tables.read_by_cell(spark, "cell_grid", places["cell_grid"], schemas[0], ["cell"], 4, ["cell", "time"])
                field = tables.read_by_cell(spark, "cell_field", places["cell_field"], schemas[1], ["cell"], 4)
            for frame in (heat.dhw(grid, field, keys=("cell",)), heat.hotspot(grid, field, ("cell",))):
                plan = frame._jdf.queryExecution().executedPlan().toString()
                assert "Exchange" not in plan and "SortMergeJoin" in plan
            got = heat.dhw(grid, field, keys=("cell",)).select(*want.columns)
            assert got.count() == want.count() and got.exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in places:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_month_of_mmm_tie_and_missing(spark):
    rows = [(1, 2, 29.0), (1, 3, 29.0), (1, 4, 28.0), (2, 1, None)]
    lines = spark.createDataFrame(rows, "cell int, month int, prediction double")
    got = {r["cell"]: (r["mmm"], r["month_of_mmm"]) for r in clim.static_fields(lines, ("cell",)).collect()}
    assert got == {1: (29.0, 3), 2: (None, None)}


def test_regression_policies(spark):
    rows = [(1, 1985 + i, 1, 20 + 0.1 * i) for i in range(5)] + [(2, 1985, 1, 20.0), (2, 1986, 1, 21.0), (2, 1989, 1, None)]
    monthly = spark.createDataFrame(rows, "cell int, year int, month int, sst double")
    pair = {r["cell"]: r for r in clim.regress_climatology(monthly, keys=("cell",)).collect()}
    assert round(pair[1]["slope"], 9) == 0.1 and round(pair[2]["slope"], 9) == 1.0
    ref = {r["cell"]: r for r in clim.regress_climatology(monthly, "reference", ("cell",)).collect()}
    # Cell 2: covariance 0.25 over the variance of all five years (2), mean year 1987.
    assert round(ref[2]["slope"], 9) == 0.125 and round(ref[2]["intercept"], 6) == round(20.5 - 0.125 * 1987, 6)
    assert round(ref[1]["slope"], 9) == 0.1
    with pytest.raises(ValueError, match="nan_policy"):
        clim.regress_climatology(monthly, "other")


def test_epoch_midpoint():
    assert round(clim.epoch_midpoint(), 4) == 1988.2857


def test_time_slice_day_and_stamp(spark):
    rows = [(DAY0 + dt.timedelta(hours=h),) for h in (0, 12, 24, 36)]
    df = spark.createDataFrame(rows, "time timestamp_ntz")
    assert time_slice(df, "2000-01-01", "2000-01-01").count() == 2
    assert time_slice(df, "2000-01-01", "2000-01-02 00:00:00").count() == 3


def test_rolling_averages_match_plain_python(spark):
    rng = random.Random(1)
    values = [None if i in (100, 500) else rng.random() for i in range(700)]
    grid = _grid(spark, [(1, 2 * i, v) for i, v in enumerate(values)])
    got = series.rolling_averages(grid, (30, 90), ("cell",)).orderBy("time").collect()
    for i, row in enumerate(got):
        for width in (30, 90):
            past = values[i - width : i] if i >= width else [None]
            want = None if None in past else sum(past) / width
            have = row[f"mean_{width}"]
            assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-9)


def test_positions_and_lead_in(spark):
    grid = _grid(spark, [(c, d, 0.0) for c in (1, 2) for d in range(0, 3000, 7)])
    rows = with_position(grid, ("cell",)).orderBy("cell", "time").collect()
    assert [r["position"] for r in rows] == list(range(429)) * 2
    cut = with_lead_in(with_position(grid, ("cell",)), F.col("position"), 100, 20)
    assert cut.where("_own").count() == 858 and cut.where("not _own").count() == 2 * 4 * 20
    with pytest.raises(ValueError):
        with_lead_in(grid, F.lit(1), 10, 11)
