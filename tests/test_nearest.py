"""Nearest roads against all roads, near the map and far from it."""

import pytest
from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import Fixtures
from roadpulse.operators import spatial


@pytest.fixture(scope="module")
def base(spark):
    return Fixtures(spark, "/root/testdata/sf0.001").base_roads()


@pytest.fixture(scope="module")
def points(spark):
    # In the middle, beyond each side, 1,000 km away, and at the antipode's side of the world.
    rows = [(1, 116.305, 39.907), (2, 116.0, 39.9), (3, 116.4, 40.2), (4, 128.0, 39.9), (5, 116.3, 30.9), (6, 116.30, 39.90), (7, -60.0, -35.0)]
    return spark.createDataFrame(rows, "id long, lon double, lat double")


@pytest.mark.parametrize("metric", ["planar", "haversine"])
def test_nearest_as_among_all(spark, base, points, metric):
    from roadpulse.functions import geo

    kx, ky = geo.metres_per_degree(F.col("lat"))
    legs = spatial.road_segments(base).groupBy("base_gid", "oneway", "length_m").agg(
        F.collect_list(F.struct("leg", "lon1", "lat1", "lon2", "lat2", "before", "leg_length")).alias("legs"))
    every = points.withColumn("kx", kx).withColumn("ky", ky).join(legs, F.lit(True))
    rows = sorted((r["id"], r["dist"], r["base_gid"]) for r in spatial._closest(every, ["id"], metric).collect())
    tree = spatial.RoadTree(base)
    best = {}
    for ident, dist, gid in rows:
        best.setdefault(ident, []).append((dist, gid))
    got = spatial.nearest(points, tree, ["id"], metric).collect()
    want = {(i, gid) for i, found in best.items() for dist, gid in found if dist == found[0][0]}
    assert {(r["id"], r["base_gid"]) for r in got} == want
    for k in (3, 500):
        got = {(r["id"], r["place"]): (r["dist"], r["base_gid"]) for r in spatial.k_nearest(points, tree, k, ["id"], metric).collect()}
        assert got == {(i, n + 1): pair for i, found in best.items() for n, pair in enumerate(found[:k])}


def test_far_point_meets_few_roads(spark, base, points):
    opened = spatial._best_first(points, spatial.RoadTree(base), 1, ["id"], "planar").groupBy("id").count().collect()
    total = base.count()
    assert all(r["count"] <= total / 8 for r in opened), opened


def test_empty_map(spark, base, points):
    assert spatial.nearest(points, base.filter("false"), ["id"]).count() == 0
