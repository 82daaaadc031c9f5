"""The edge index: outlines on the squares' own borders, ocean-sized and dense ones, and the shape of its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.functions.geometry import PLATE_CARREE_DEGREE
from thermocline.operators import polygons

VERTICES = "polygon_id string, ring_id int, seq int, lon double, lat double"


def vertex_table(spark, shapes):
    rows = [(name, ring, k, float(x), float(y)) for name, rings in shapes.items() for ring, outline in enumerate(rings) for k, (x, y) in enumerate(outline)]
    return spark.createDataFrame(rows, VERTICES)


def brute(points, shapes, reach=0.0):
    found = set()
    for key, (x, y) in enumerate(points):
        for name, rings in shapes.items():
            turns, near = 0, False
            for outline in rings:
                for (x1, y1), (x2, y2) in zip(outline, outline[1:] + outline[:1]):
                    if (y1 <= y) != (y2 <= y):
                        turns += x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
                    turn = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
                    near |= turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
                    if reach:
                        dx, dy = x2 - x1, y2 - y1
                        share = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                        near |= (x - x1 - share * dx) ** 2 + (y - y1 - share * dy) ** 2 <= reach * reach
            if turns % 2 or near:
                found.add((key, name))
    return found


def outlines(rng):
    circle = lambda n, x, y, r: [(x + r * np.cos(a), y + r * np.sin(a)) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    rough = [(x * f, y * f) for (x, y), f in zip(circle(400, 0, 0, 1), rng.uniform(0.4, 2.0, 400))]
    return {
        "box": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]],  # its sides are borders of squares
        "steps": [[(0.25, 0.0), (0.5, 0.0), (0.5, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]],
        "ring": [[(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0)], [(-1.5, -1.5), (-1.5, 1.5), (1.5, 1.5), (1.5, -1.5)]],
        "rough": [[(float(x) - 4, float(y) + 5) for x, y in rough]],
        "tiny": [[(2.11, 2.12), (2.13, 2.12), (2.12, 2.13)]],
        "line": [[(-2.0, 4.0), (2.0, 4.0)]],
        "bow": [[(5.0, 0.0), (7.0, 2.0), (7.0, 0.0), (5.0, 2.0)]],
    }


def test_positions_on_and_beside_square_borders(spark):
    rng = np.random.default_rng(12)
    shapes = outlines(rng)
    points = [(x / 4, y / 4) for x in range(-16, 32, 1) for y in range(-16, 25, 1)]
    points += [tuple(p) for p in rng.uniform((-7, -4), (8, 8), (1500, 2)).tolist()]
    points += [v for rings in shapes.values() for outline in rings for v in outline]
    table = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "obs_id long, longitude double, latitude double")
    got = {(r["obs_id"], r["polygon_id"]) for r in polygons.join_polygons(table, vertex_table(spark, shapes)).collect()}
    assert got == brute(points, shapes)


@pytest.mark.parametrize("degrees", [0.01, 0.3, 2.5])
def test_reach_beyond_a_square(spark, degrees):
    rng = np.random.default_rng(13)
    shapes = outlines(rng)
    points = [tuple(p) for p in rng.uniform((-9, -7), (11, 11), (900, 2)).tolist()]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "obs_id long, longitude double, latitude double")
    metres = degrees * PLATE_CARREE_DEGREE
    got = {(r["obs_id"], r["polygon_id"]) for r in polygons.points_within(table, vertex_table(spark, shapes), metres, "meters").collect()}
    assert got == brute(points, shapes, metres / PLATE_CARREE_DEGREE)


def test_an_ocean_and_a_dense_reef_stay_even(spark):
    corners = [(-180.0, -60.0), (180.0, -60.0), (180.0, 60.0), (-180.0, 60.0)]
    angles = np.linspace(0, 2 * np.pi, 60_000, endpoint=False)
    reef = [(10.0 + np.cos(a) * (1 + 0.2 * np.sin(900 * a)), 5.0 + np.sin(a) * (1 + 0.2 * np.sin(900 * a))) for a in angles]
    index, side = polygons._edge_index(vertex_table(spark, {"ocean": [corners], "reef": [reef]}), 0.0, "meters")
    assert side == polygons.SQUARE
    squares = index.groupBy("polygon_id", "_col", "_band").agg(F.count("x1").alias("edges"), F.sum("_inside").alias("inside")).cache()
    ocean = squares.where("polygon_id = 'ocean'").agg(F.count("*"), F.max("edges"), F.sum("inside"), F.sum((F.col("edges") == 0).cast("int"))).first()
    assert ocean[1] <= 3 and ocean[2] >= 1440 * 479 and ocean[3] >= 1438 * 478  # whole inside squares have no edge
    dense = squares.where("polygon_id = 'reef' and edges > 0").agg(F.max("edges"), F.sum("edges"), F.count("*")).first()
    assert dense[0] < dense[1] / dense[2] * 8
    inside = polygons.join_polygons(
        spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 5.0), (2, 170.1, -59.9), (3, 0.0, 60.1)], "obs_id long, longitude double, latitude double"),
        vertex_table(spark, {"ocean": [corners], "reef": [reef]}),
    )
    assert sorted((r["obs_id"], r["polygon_id"]) for r in inside.collect()) == [(0, "ocean"), (1, "ocean"), (1, "reef"), (2, "ocean")]


def test_positions_join_on_their_square_alone(spark):
    points = spark.createDataFrame([(0, 0.5, 0.5)], "obs_id long, longitude double, latitude double")
    plan = polygons.join_polygons(points, vertex_table(spark, outlines(np.random.default_rng(1))))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert not any("polygon_id" in line and "_band" in line for line in joins)
    assert sum("_col" in line and "_band" in line for line in joins) == 1
    assert "lambda" not in plan and "collect_list" not in plan
