"""Buffers against distances: areas in closed form, and points tried one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import polygon as P
from tilewright.functions.ring_columns import ring_buffer, ring_simplify
from tilewright.sources.geojson import parse_features


def _ring(*points):
    return np.array(points, float)


def _distance(p, ring):
    best = math.inf
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        d = b - a
        t = np.clip((p - a) @ d / max(d @ d, 1e-12), 0, 1)
        best = min(best, float(np.hypot(*(p - a - t * d))))
    return best


#: Area of a circle of radius 1 of 64 sides.
CIRCLE = 32 * math.sin(2 * math.pi / 64)


@pytest.mark.parametrize("d", [0.5, 1, 3])
def test_convex_rings_in_closed_form(d):
    for ring, size, around in ((_ring((0, 0), (4, 0), (4, 3), (0, 3)), 12, 14), (_ring((0, 0), (0, 4), (3, 0)), 6, 12)):
        # arcs of convex corners add up to a circle; those of odd angles have sides of their own
        assert P.area(P.buffer([ring], d)) == pytest.approx(size + around * d + CIRCLE * d * d, rel=2e-4)
    assert P.area(P.buffer([_ring((0, 0), (4, 0), (4, 3), (0, 3))], -d)) == pytest.approx(max(0, 4 - 2 * d) * max(0, 3 - 2 * d))
    assert P.area(P.buffer([_ring((1, 1), (6, 1))], d)) == pytest.approx(10 * d + CIRCLE * d * d) and P.area(P.buffer([_ring((1, 1))], d)) == pytest.approx(CIRCLE * d * d)


def test_concave_rings_point_by_point():
    r = random.Random(5)
    shapes = [_ring((0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)), _ring((0, 0), (10, 2), (3, 4), (9, 9), (1, 6))]
    shapes += [_ring(*[(5 + q * math.cos(k / 5 * math.pi), 5 + q * math.sin(k / 5 * math.pi)) for k, q in enumerate(r.choice([2, 3.5, 5]) for _ in range(10))]) for _ in range(8)]
    for ring in shapes:
        for d in (0.4, 1.2, 2.5, -0.3, -0.9):
            made = P.buffer([ring], d)
            sides = P._sides(made)
            for _ in range(150):
                p = np.array([r.uniform(-4, 14), r.uniform(-4, 14)])
                inside, far = bool(P._inside(p[None], P._sides([ring]))[0]), _distance(p, ring)
                want = (inside or far <= d) if d > 0 else (inside and far >= -d)
                # arcs lie inside their circle by a thousandth of its radius
                if abs(far - abs(d)) > 0.004 * abs(d) + 1e-6:
                    assert bool(P._inside(p[None], sides)[0]) == want, (ring.tolist(), d, p)


def test_a_gap_that_closes_leaves_a_hole():
    ring = _ring((0, 0), (20, 0), (20, 20), (9, 20), (9, 19), (19, 19), (19, 1), (1, 1), (1, 19), (8, 19), (8, 20), (0, 20))
    made = P.buffer([ring], 1)
    assert len(made) == 2 and sorted(np.sign([P.signed_area(r) for r in made]).tolist()) == [-1, 1]


def test_columns_and_the_last_rung(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, None), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "id long, ring array<struct<x:double,y:double>>")
    got = {r["id"]: r for r in df.select("id", ring_buffer("ring", -1.0).alias("less"), ring_simplify("ring", 0.1).alias("same")).collect()}
    assert sorted((p["x"], p["y"]) for p in got[1]["less"]) == [(1, 1), (1, 2), (3, 1), (3, 2)] and got[2]["less"] is got[2]["same"] is got[3]["less"] is None and len(got[1]["same"]) == 4
    thin = '{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [5, 0]]], [[[5, 0], [5, 5]]]]}, "properties": {"classification": {"name": "a"}}}'
    rows = parse_features(spark.createDataFrame([("s", 0, thin)], "image_id string, roi_idx int, json string")).collect()
    # two stadiums that share a quarter of both
    both = 2 * (10 + CIRCLE)
    assert len(rows) == 1 and 20 < rows[0]["area"] < both and (rows[0]["x0"], rows[0]["y0"], rows[0]["x1"], rows[0]["y1"]) == pytest.approx((-1, -1, 6, 6))
