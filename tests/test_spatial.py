"""Sampling, tiles, series windows and polygons against brute force on small fixtures."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from thermocline.functions.geometry import BOUNDS, PLATE_CARREE_DEGREE
from thermocline.operators import polygons, sampling, series, tiles

AXIS = (0.0, 1.0, 2.0, 4.0)


def _field(spark, gaps=()):
    rows = [(a, b, 10 * a + b + a * b) for a in AXIS for b in AXIS if (a, b) not in gaps]
    return spark.createDataFrame(rows, "latitude double, longitude double, v double")


def _points(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "obs_id int, latitude double, longitude double")


def _values(df, column="v"):
    return [r[column] for r in df.orderBy("obs_id").collect()]


def test_bilinear_node_centre_outside_and_gap(spark):
    points = _points(spark, [(1.0, 2.0), (0.5, 0.5), (3.0, 3.0), (5.0, 5.0), (-1.0, 0.0), (None, 1.0)])
    got = _values(sampling.sample_grid(points, _field(spark), "linear", value="v"))
    # The field is bilinear, so interpolation and extrapolation are exact.
    assert got == [10 + 2 + 2, 5 + 0.5 + 0.25, 30 + 3 + 9, 50 + 5 + 25, -10.0, None]
    gap = _values(sampling.sample_grid(points, _field(spark, {(1.0, 1.0)}), "linear", value="v"))
    assert gap[1] is None and gap[2] == 42.0


def test_bilinear_equals_nearest_on_nodes(spark):
    points = _points(spark, [(a, b) for a in AXIS for b in AXIS])
    near = _values(sampling.sample_grid(points, _field(spark), value="v"))
    assert near == _values(sampling.sample_grid(points, _field(spark), "linear", value="v"))


def test_nearest_clamps_and_fills(spark):
    points = _points(spark, [(9.0, -9.0), (2.9, 3.1), (3.0, 0.4), (1.0, 1.0)])
    field = _field(spark, {(1.0, 1.0)})
    assert _values(sampling.sample_grid(points, field, value="v")) == [40.0, 20 + 4 + 8, 20.0, None]
    assert _values(sampling.sample_grid(points, field, fill="zero", value="v"))[3] == 0.0
    assert _values(sampling.sample_grid(points, field, fill=7, value="v"))[3] == 7.0
    mean = field.agg(F.avg("v")).first()[0]
    assert _values(sampling.sample_grid(points, field, fill="mean", value="v"))[3] == mean
    for bad in ({"fill": "other"}, {"method": "cubic"}):
        with pytest.raises(ValueError):
            sampling.sample_grid(points, field, value="v", **bad)


def test_tiles_golden(spark):
    got = tiles.tiles_for_bbox(spark, (5, 35), (10, 45)).collect()
    assert {(r["lat0"], r["lon0"]) for r in got} == {(a, b) for a in (0, 20) for b in (0, 20, 40)}
    assert all(r["lat1"] - r["lat0"] == 20 and r["lon1"] - r["lon0"] == 20 for r in got)
    assert tiles.tiles_for_bbox(spark, (20, 40), (0, 20)).count() == 1


def test_month_slices(spark):
    def slices(start, end):
        df = spark.createDataFrame([(dt.date.fromisoformat(start), dt.date.fromisoformat(end))], "s date, e date")
        return [(str(r["slice_start"]), str(r["slice_end"])) for r in tiles.month_slices(df, "s", "e").orderBy("slice_start").collect()]

    assert slices("2012-01-15", "2012-03-10") == [
        ("2012-01-15 12:00:00", "2012-01-31"), ("2012-02-01 12:00:00", "2012-02-29"), ("2012-03-01 12:00:00", "2012-03-10"),
    ]
    # The noon start of a one-day slice is not before its midnight end.
    assert slices("2012-01-01", "2012-02-01") == [("2012-01-01 12:00:00", "2012-01-31")]
    with pytest.raises(Exception, match="Start date must be before"):
        slices("2012-02-01", "2012-01-01")


def test_assign_tile_edges_and_errors(spark):
    grid = tiles.tiles_for_bbox(spark, (0, 40), (0, 40))
    points = _points(spark, [(20.0, 20.0), (0.0, 0.0), (40.0, 40.0), (25.0, 5.0), (50.0, 5.0)])
    got = _values(tiles.assign_tile(points, grid, "null"), "patch")
    assert got == ["patch_0_20_0_20", "patch_0_20_0_20", "patch_20_40_20_40", "patch_20_40_0_20", None]
    with pytest.raises(Exception, match="No tile contains point"):
        tiles.assign_tile(points, grid).collect()


def _square(name, x0, y0, x1, y1, ring=0):
    return [(name, ring, i, float(x), float(y)) for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def _vertices(spark, rows):
    return spark.createDataFrame(rows, "polygon_id string, ring_id int, seq int, lon double, lat double")


def test_square_inside_edge_outside_hole_and_overlap(spark):
    shapes = _square("a", 0, 0, 4, 4) + _square("a", 1, 1, 2, 2, ring=1) + _square("b", 3, 3, 6, 6)
    points = _points(spark, [(0.5, 0.5), (1.5, 1.5), (4.0, 0.0), (0.0, 2.0), (3.5, 3.5), (9.0, 9.0), (1.0, 1.5), (5.0, 3.0)])
    got = {(r["obs_id"], r["polygon_id"]) for r in polygons.join_polygons(points, _vertices(spark, shapes)).collect()}
    assert got == {(0, "a"), (2, "a"), (3, "a"), (4, "a"), (4, "b"), (6, "a"), (7, "b")}
    once = polygons.points_in_polygons(points, _vertices(spark, shapes)).collect()
    assert sorted((r["obs_id"], r["polygon_id"]) for r in once) == [(0, "a"), (2, "a"), (3, "a"), (4, "a"), (6, "a"), (7, "b")]


def _inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _gap(x, y, ring):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


def test_many_edges_against_brute_force(spark):
    """Star-shaped rings with more edges than one chunk holds, spanning many squares and bands."""
    rng = random.Random(11)
    rings = {}
    for name, n in (("p", 900), ("q", 40)):
        cx, cy = rng.uniform(-1, 1), rng.uniform(-1, 1)
        radii = [rng.uniform(0.4, 1.5) for _ in range(n)]
        rings[name] = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(radii)]
    vertices = _vertices(spark, [(p, 0, i, x, y) for p, ring in rings.items() for i, (x, y) in enumerate(ring)])
    pairs = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(500)]
    points = _points(spark, pairs)
    got = {(r["obs_id"], r["polygon_id"]) for r in polygons.join_polygons(points, vertices).collect()}
    assert got == {(i, p) for i, (y, x) in enumerate(pairs) for p, ring in rings.items() if _inside(x, y, ring)}
    metres = 20000.0
    reach = metres / PLATE_CARREE_DEGREE
    near = {(r["obs_id"], r["polygon_id"]) for r in polygons.points_within(points, vertices, metres, "meters").collect()}
    assert near == {
        (i, p) for i, (y, x) in enumerate(pairs) for p, ring in rings.items() if _inside(x, y, ring) or _gap(x, y, ring) <= reach
    }
    assert len(near) > len(got)
    with pytest.raises(ValueError, match="Unknown unit"):
        polygons.points_within(points, vertices, 1.0, "feet")


def test_vertex_gap_is_an_error(spark):
    broken = [r for r in _square("a", 0, 0, 1, 1) if r[2] != 2]
    with pytest.raises(Exception, match="not consecutive"):
        polygons.edges(_vertices(spark, broken)).collect()


def test_no_nested_loops_or_cartesian_products(spark):
    shapes = _vertices(spark, _square("a", 0, 0, 1, 1))
    points = _points(spark, [(0.5, 0.5)])
    dated = points.withColumn("date", F.lit(dt.date(2000, 1, 5)))
    grid = _daily(spark, [(0.0, 0.0), (0.0, 1.0)], range(40))
    frames = [
        sampling.sample_grid(points, _field(spark), value="v"),
        sampling.sample_grid(points, _field(spark), "linear", "mean", value="v"),
        sampling.sample_grid(points, grid.select("time", "latitude", "longitude", "sst"), fill="mean"),
        tiles.assign_tile(points, tiles.tiles_for_bbox(spark, (0, 20), (0, 20))),
        series.series_rows(dated, grid), series.series_rows(dated, grid, method="linear"), series.series_for(dated, grid),
        polygons.join_polygons(points, shapes), polygons.points_in_polygons(points, shapes),
        polygons.points_within(points, shapes, 0.1),
    ]
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for frame in frames:
            plan = frame.select("*")._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _daily(spark, cells, days):
    start = dt.datetime(1999, 12, 1)
    rows = [(start + dt.timedelta(days=d), a, b, a * 100 + b * 10 + d) for a, b in cells for d in days]
    return spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, sst double")


def test_series_window_bounds_and_sharing(spark):
    grid = _daily(spark, [(0.0, 0.0), (0.0, 1.0)], range(60))
    rows = [(1, 0.1, 0.2, "2000-01-10"), (2, -0.3, 0.4, "2000-01-10"), (3, 0.0, 0.9, "2000-01-01"), (4, 0.0, 0.0, "2010-01-01")]
    obs = spark.createDataFrame(rows, "obs_id int, latitude double, longitude double, d string").withColumn("date", F.to_date("d"))
    arrays = {r["obs_id"]: r["series"] for r in series.series_for(obs, grid, 5).collect()}
    assert [s["time"].day for s in arrays[1]] == [5, 6, 7, 8, 9, 10] and arrays[1] == arrays[2]
    assert [s["sst"] for s in arrays[3]] == [10.0 + d for d in (26, 27, 28, 29, 30, 31)]
    assert arrays[4] is None
    linear = series.series_rows(obs, grid, 5, "linear").where("obs_id = 1").orderBy("time").collect()
    assert [round(r["sst"], 6) for r in linear] == [2.0 + d for d in range(35, 41)]


def test_noon_stamps(spark):
    grid = _daily(spark, [(0.0, 0.0)], range(20)).withColumn("time", F.col("time") + F.expr("INTERVAL 12 HOURS"))
    obs = spark.createDataFrame([(1, 0.0, 0.0, dt.date(1999, 12, 10))], "obs_id int, latitude double, longitude double, date date")
    assert series.series_rows(obs, grid, 3).count() == 3
    assert series.series_rows(obs, grid, 3, truncate_time=True).count() == 4


def test_sequence_pads_and_cuts(spark):
    df = spark.createDataFrame([(1, [(1.0,), (None,), (3.0,)]), (2, [(float(i),) for i in range(9)])], "k int, series array<struct<sst:double>>")
    got = {r["k"]: r["sequence"] for r in series.to_sequence(df, 5).collect()}
    assert got == {1: [0.0, 0.0, 1.0, 0.0, 3.0], 2: [4.0, 5.0, 6.0, 7.0, 8.0]}


def _timed_field(spark):
    """Three steps; the middle one lacks the row of cell (1, 1), the last one its value."""
    rows = [
        (dt.datetime(2001, 1, day), a, b, None if (day, a, b) == (3, 1.0, 1.0) else day * 100.0 + 10 * a + b)
        for day in (1, 2, 3) for a in AXIS for b in AXIS if (day, a, b) != (2, 1.0, 1.0)
    ]
    return rows, spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, v double")


SPOTS = [(1.0, 1.0), (1.1, 0.9), (1.1, 0.9), (3.5, 2.5), (-2.0, 9.0), (None, 1.0), (2.0, None)]


def test_timed_sampling_of_nearest_cells_equals_brute_force(spark):
    rows, field = _timed_field(spark)
    known = {(t, a, b): v for t, a, b, v in rows}
    points = _points(spark, SPOTS).withColumns({"v": F.lit("clash"), "time": F.lit("clash")})
    sampled = sampling.sample_grid(points, field, value="v")
    assert sorted(sampled.columns) == ["latitude", "longitude", "obs_id", "time", "v"]
    got = sorted((r["obs_id"], r["time"], r["v"]) for r in sampled.collect())
    expected = []
    for i, (a, b) in enumerate(SPOTS):
        cell = None if a is None or b is None else tuple(min(AXIS, key=lambda x, v=v: (abs(x - v), x)) for v in (a, b))
        expected += [(i, t, cell and known.get((t, *cell))) for t in sorted({r[0] for r in rows})]
    assert got == sorted(expected)


def test_timed_bilinear_sampling_equals_a_sample_of_each_step(spark):
    rows, field = _timed_field(spark)
    points = _points(spark, SPOTS)
    got = {(r["obs_id"], r["time"]): r["v"] for r in sampling.sample_grid(points, field, "linear", value="v").collect()}
    assert len(got) == 3 * len(SPOTS)
    for step in sorted({r[0] for r in rows}):
        # Missing rows stand for missing values, so that each step has all axis entries.
        still = [(a, b, next((v for t, x, y, v in rows if (t, x, y) == (step, a, b)), None)) for a in AXIS for b in AXIS]
        one = spark.createDataFrame(still, "latitude double, longitude double, v double")
        for i, value in enumerate(_values(sampling.sample_grid(points, one, "linear", value="v"))):
            assert got[i, step] == (value if value is None else pytest.approx(value))


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_time_steps_are_joined_to_different_cells_and_not_to_points(spark, method):
    _, field = _timed_field(spark)
    sampled = sampling.sample_grid(_points(spark, SPOTS), field, method, value="v")
    lines = sampled._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "Generate explode(_steps" in line or "Generate explode(scalar" in line]
    assert len(at) == 1
    below = [line.lstrip(" :+-") for line in lines[at[0] + 1 : at[0] + 3]]
    assert any(line.startswith("Aggregate [_lat") for line in below)


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_timed_sampling_of_empty_tables(spark, method):
    _, field = _timed_field(spark)
    assert sampling.sample_grid(_points(spark, SPOTS), field.limit(0), method, value="v").count() == 0
    assert sampling.sample_grid(_points(spark, SPOTS).limit(0), field, method, value="v").count() == 0
