"""Routes, load shedding, lines, components and the matcher's step where they are easy to get wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadpulse.catalog.fixtures import Fixtures
from roadpulse.functions import geo
from roadpulse.operators import density, matching, routing
from roadpulse.params import GridParams, MatchParams, TrafficParams
from roadpulse.plans.components import connected_components
from roadpulse.catalog.network import road_state
from roadpulse.operators import traffic
from roadpulse.sources import gps
from roadpulse.sources import roads as road_source
from roadpulse.streaming import pipeline

SF_DIR = "/root/testdata/sf0.001"
UNCHECKED = sorted(name for name in entry.queries() if name not in entry.oracle_sql() and not name.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def after_geodesic(spark):
    entry.queries()["F1_geodesic"](spark, SF_DIR).count()


@pytest.mark.parametrize("name", UNCHECKED[::-1])
def test_unchecked_query_runs_after_python_functions_were_used(spark, after_geodesic, name):
    assert entry.queries()[name](spark, SF_DIR).count() >= 0


def _road(ident, lat, length, cost):
    ends = [{"lon": 10.0, "lat": lat}, {"lon": 10.0001, "lat": lat}]
    return ident, ends, float(length), 10.0, float(cost)


def test_cheapest_route_within_the_bound(spark):
    schema = "id bigint, points array<struct<lon:double,lat:double>>, length_m double, maxspeed double, priority double"
    roads = spark.createDataFrame([_road(1, 70.0, 50, 1), _road(2, 70.0, 400, 1), _road(4, 70.0, 400, 1), _road(3, 70.0, 100, 50), _road(9, 70.0, 20, 1)], schema)
    follow = spark.createDataFrame([(1, 2), (2, 4), (4, 9), (1, 3), (3, 9)], "id bigint, succ_id bigint")
    cost = lambda length, speed, priority: priority
    wanted = spark.createDataFrame([(1, 9, 300.0), (1, 9, 1000.0), (1, 9, 50.0)], "src bigint, tgt bigint, bound double")
    got = {r["bound"]: r["path"] for r in routing.routes_between(wanted, roads, follow, cost).collect()}
    assert got == {300.0: [1, 3, 9], 1000.0: [1, 2, 4, 9]}
    source = spark.createDataFrame([(1,)], "src bigint")
    for bound, path in ((300.0, [3, 9]), (1000.0, [2, 4, 9])):
        far = {r["tgt"]: r["path"] for r in routing.reachable(roads, follow, source, bound, cost).collect()}
        assert far[9] == path


def test_dearer_chain_serves_long_ends(spark):
    """Chains of 900 m (cost 20) and 700 m (cost 25) within 1,000 m: with 180 m of ends only the second fits."""
    schema = "id bigint, points array<struct<lon:double,lat:double>>, length_m double, maxspeed double, priority double"
    roads = spark.createDataFrame([_road(1, 50.0, 100, 1), _road(2, 50.0, 900, 20), _road(3, 50.0, 700, 25), _road(9, 50.0, 100, 1)], schema)
    follow = spark.createDataFrame([(1, 2), (2, 9), (1, 3), (3, 9)], "id bigint, succ_id bigint")
    cost = lambda length, speed, priority: priority
    wanted = spark.createDataFrame([(1, 9, 1000.0, e) for e in (0.0, 100.0, 180.0, 300.0, 301.0)], "src bigint, tgt bigint, bound double, ends double")
    got = {r["ends"]: (r["path"], r["inner_cost"]) for r in routing.routes_between(wanted, roads, follow, cost).collect()}
    assert got == {0.0: ([1, 2, 9], 20.0), 100.0: ([1, 2, 9], 20.0), 180.0: ([1, 3, 9], 25.0), 300.0: ([1, 3, 9], 25.0)}
    front = routing.fronts_between(wanted, routing.RoadTiles(roads, follow, cost)).first()["front"]
    assert [(x["inner_cost"], x["inner_length"]) for x in front] == [(20.0, 900.0), (25.0, 700.0)]
    point = lambda road, fraction: dict(road=road, fraction=fraction, lon=0.0, lat=0.0, emission=1.0, cost=1.0, length=100.0)
    routes = {(1, 9): [(x["inner_cost"], x["inner_length"], x["path"]) for x in front]}
    assert matching._leg(point(1, 0.1), point(9, 0.9), routes, 1000.0) == (0.9 + 25 + 0.9, [1, 3, 9])
    assert matching._leg(point(1, 0.9), point(9, 0.5), routes, 1000.0) == (pytest.approx(0.1 + 20 + 0.5), [1, 2, 9])


@pytest.mark.parametrize("change", ["north", "slow"])
def test_routes_far_north_and_with_a_slow_road(spark, change):
    f = Fixtures(spark, SF_DIR)
    roads, follow = f.roads(), f.successors()
    if change == "north":
        wide = math.cos(math.radians(40)) / math.cos(math.radians(70))
        roads = roads.withColumn("points", F.transform("points", lambda p: F.struct((p.lon * wide).alias("lon"), (p.lat + 30).alias("lat"))))
    else:
        roads = roads.withColumn("maxspeed", F.when(F.col("id") == 6, 0.01).otherwise(F.col("maxspeed")))
    full = routing.reachable(roads, follow, roads.select(F.col("id").alias("src")), 700.0)
    price = routing.with_cost(roads).select(F.col("id").alias("tgt"), F.col("cost").alias("own"))
    wanted = full.select("src", "tgt", F.lit(700.0).alias("bound"))
    got = routing.routes_between(wanted, roads, follow, sources_per_group=20)
    both = full.join(got, ["src", "tgt"], "full").join(price, "tgt")
    assert both.filter("inner_cost IS NULL OR cost IS NULL OR abs(inner_cost + own - cost) > 1e-6").count() == 0


def test_step_survives_vanishing_emissions():
    p = MatchParams(sigma=2.0, squared_emission=True)
    gone = dict(road=1, fraction=0.5, lon=0.0, lat=0.0, emission=0.0, cost=1.0, length=10.0)
    there = {**gone, "road": 2, "emission": 1e-9}
    first, broke = matching.advance([], None, None, (0.0, 0.0), [gone, there], {}, p)
    assert [c["road"] for c in first] == [2] and not broke
    following, broke = matching.advance(first, 10.0, 0.0, (0.0, 0.0), [{**gone, "road": 2}], {}, p)
    assert following == [] and broke
    assert matching.advance([], None, None, (0.0, 0.0), [gone], {}, p) == ([], False)


def test_pair_lines_keep_missing_fields(spark):
    schema = ", ".join(f"{s}{c}" for s in ("pre_", "") for c in ("date string", "suid bigint", "utc bigint", "gid bigint", "offset double", "route array<bigint>")) + ", flag int"
    rows = [("d", 1, 2, 3, None, [4, 5], "d", 1, None, 7, 0.5, None, 1), (None, None, None, None, None, None, "e", 2, 3, 4, 1.0, [9], None)]
    pairs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, gps.parse_pairs(gps.format_pairs(pairs)).collect())) == sorted(map(str, pairs.collect()))


def test_shedding_counts_accepted_points_only(spark):
    rng, rows = random.Random(6), []
    for suid in range(30):
        for utc in sorted(rng.sample(range(0, 900), 40)):
            rows.append((suid, utc, rng.random() < 0.9, rng.randrange(2), 0, "d", utc // 300))
    cells = spark.createDataFrame(rows, "suid bigint, utc bigint, passenger boolean, x int, y int, date string, seq int")
    g, p = GridParams(capacity=25), TrafficParams()
    got = {(r["suid"], r["utc"]): r["dropped"] for r in density.shed_load(cells, 20, g, p).collect()}
    counts, state, want = {}, {}, {}
    for batch in sorted({r[1] // 20 for r in rows}):
        held = dict(counts)
        for suid, utc, passenger, x, y, date, seq in sorted(r for r in rows if r[1] // 20 == batch):
            s = state.setdefault(suid, dict(batch=None, dump=False, x=None, y=None, utc=None, passenger=None))
            if s["batch"] != batch:
                s |= dict(dump=held.get((date, seq, x, y), 0) >= g.capacity, x=x, y=y, batch=batch)
            leaves = s["utc"] is not None and (utc - s["utc"] > p.max_gap or passenger != s["passenger"] or (x, y) != (s["x"], s["y"]))
            unknown = s["utc"] is None and (x, y) == (s["x"], s["y"])
            drop = s["dump"] and not leaves and not unknown
            s["dump"] = drop
            want[suid, utc] = drop
            if not drop:
                s |= dict(utc=utc, passenger=passenger)
                counts[date, seq, x, y] = counts.get((date, seq, x, y), 0) + 1
    assert any(want.values()) and got == want


def test_exact_polyline_length(spark):
    lines = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 50.0)], None]
    df = spark.createDataFrame([(i, None if line is None else [{"lon": x, "lat": y} for x, y in line]) for i, line in enumerate(lines)],
                               "i int, points array<struct<lon:double,lat:double>>")
    got = {r["i"]: r["m"] for r in df.select("i", geo.polyline_length(F.col("points"), "wgs84").alias("m")).collect()}
    assert got[0] == pytest.approx(111319.4908 + 110574.3886, abs=1e-2) and got[1] == 0.0 and got[2] is None


def test_components_with_a_hot_root(spark):
    star = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(3000, 3040)] + [(9000 + i, 9001 + i) for i in range(7)]
    edges = spark.createDataFrame(star, "a bigint, b bigint")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert all(c == (0 if n < 9000 else 9000) for n, c in got.items()) and len(got) == 3041 + 8


def test_pair_stream_does_not_depend_on_its_batches(spark, tmp_path):
    """Pairs that move along one road: their observations don't depend on the state, so batches must not matter."""
    f = Fixtures(spark, SF_DIR)
    state, history = road_state(f), f.history()
    moving = f.pairs().filter("pre_gid = gid AND offset <> pre_offset")
    wide = moving.unionByName(moving.withColumn("utc", F.col("utc") + 700).withColumn("pre_utc", F.col("pre_utc") + 700))
    rows = spark.createDataFrame(wide.collect(), wide.schema)
    stream = pipeline.PairState(state, history, road_source.class_history(history), str(tmp_path))
    low, high = rows.agg(F.min("utc"), F.max("utc")).first()
    third = (high - low) // 3 + 1
    for i in range(3):
        stream(rows.filter((F.col("utc") - low >= i * third) & (F.col("utc") - low < (i + 1) * third)), i)
        stream(rows.filter((F.col("utc") - low >= i * third) & (F.col("utc") - low < (i + 1) * third)), i)  # a repeated batch changes nothing
    whole = traffic.road_speeds(rows, state)[0].filter("closed")
    key = lambda df: sorted((r["gid"], r["day"], r["seq"], round(r["avg_speed"], 6)) for r in df.collect())
    assert key(stream.closed()) == key(whole) and whole.count()
