import math
import random

import pytest

from websift.operators import geo_money as GM

R = GM.EARTH_RADIUS_KM


def distance(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def inside(row, point, km, mode):
    if mode == "circle":
        return distance(row, point) <= km
    dlat = math.degrees(km / R)
    dlon = 180 if abs(point[0]) + dlat >= 90 else math.degrees(math.asin(min(1, math.sin(km / R) / math.cos(math.radians(point[0])))))
    turn = abs(row[1] - point[1]) % 360
    return abs(row[0] - point[0]) <= dlat and min(turn, 360 - turn) <= dlon


@pytest.mark.parametrize("mode", ["circle", "box"])
def test_equals_all_pairs(spark, mode):
    rng = random.Random(4)
    spot = [(89.9, 10.0), (-89.99, -170.0), (10.0, 179.9), (10.0, -179.9), (0.0, 0.0), (90.0, 5.0), (-90.0, 0.0), (60.0, 180.0)]
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(1500)] + spot + [(10.1, 179.95)] * 300
    points = [(*rng.choice(spot), rng.choice([0.0, 5.0, 40.0, 700.0, 9000.0, 25000.0])) for _ in range(25)] \
        + [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(1, 2000)) for _ in range(15)]
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)] + [(-1, None, 0.0), (-2, 0.0, None), (-3, 95.0, 0.0)], "id long, lat double, lon double")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(-1, None, 0.0, 5.0), (-2, 0.0, 0.0, None), (-3, 0.0, 0.0, -1.0)],
                              "point_id long, lat double, lon double, km double")
    got = [(x.point_id, x.id) for x in GM.near_points(r, p, mode=mode).collect()]
    want = {(k, i) for k, (a, o, km) in enumerate(points) for i, x in enumerate(rows) if inside(x, (a, o), km, mode)}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables_and_turned_longitudes(spark):
    r = spark.createDataFrame([(1, 0.0, 540.0), (2, 0.0, -180.0), (3, 0.0, 0.0)], "id long, lat double, lon double")
    p = spark.createDataFrame([(1, 0.0, 180.0, 10.0)], "point_id long, lat double, lon double, km double")
    for mode in ("circle", "box"):
        assert {x.id for x in GM.near_points(r, p, mode=mode).collect()} == {1, 2}
        assert GM.near_points(r, p.where("false"), mode=mode).count() == 0
        assert GM.near_points(r.where("false"), p, mode=mode).count() == 0
