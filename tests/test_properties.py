"""Brute-force and property checks on small inputs."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import Fixtures
from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.operators import clusters, evaluate, matching, prepare, routing, spatial, traffic
from roadpulse.plans import clamped
from roadpulse.plans.components import connected_components
from roadpulse.plans.ordered import with_previous, with_running_max
from roadpulse.sources.roads import parse_wkb_line, parse_wkt_line

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixtures(spark):
    return Fixtures(spark, SF_DIR)


def test_thinning_across_midnight_and_hot_vehicle(spark):
    rng = random.Random(1)
    rows, ident = [], 0
    for suid, share in ((1, 2000), (2, 300), (3, 50)):
        for _ in range(share):
            rows.append((ident, suid, rng.randrange(86400 * 2 - 600, 86400 * 3 + 600) if share < 2000 else 86400 * 2 - 1500 + ident * 3 // 2))
            ident += 1
    df = spark.createDataFrame(rows, "event_id bigint, suid bigint, utc bigint")
    got = {r.event_id for r in prepare.thin_traces(df).collect()}
    want, last = set(), {}
    for event, suid, utc in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if suid not in last or utc >= last[suid] + 10:
            want.add(event)
            last[suid] = utc
    assert got == want


def test_previous_row_across_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    got = with_previous(df, ["k"], F.floor(F.col("t") / 10), ["t"], ["t"]).collect()
    assert all((r.pre_t is None and r.t < 3) or r.pre_t == r.t - 3 for r in got)


def test_running_max_across_chunks(spark):
    rng = random.Random(2)
    values = [rng.randrange(100) for _ in range(500)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, t int, v int")
    got = {r.t: r.top for r in with_running_max(df, ["k"], F.floor(F.col("t") / 7), ["t"], "v", "top").collect()}
    assert got == {i: (max(values[:i]) if i else None) for i in range(500)}


def test_composed_updates_equal_sequential_ones(spark):
    rng = random.Random(3)
    steps = [(rng.random() * 10, rng.choice([0.0, 0.5, 0.9]), 1.5, rng.choice([5.0, 20.0])) for _ in range(60)]
    value = 7.0
    for a, b, lo, hi in steps:
        value = max(lo, min(hi, a + b * value))
    df = spark.createDataFrame([([dict(a=a, b=b, lo=lo, hi=hi) for a, b, lo, hi in steps],)], "fs array<struct<a:double,b:double,lo:double,hi:double>>")
    got = df.select(clamped.apply(clamped.compose(F.col("fs")), F.lit(7.0)).alias("v")).first().v
    assert got == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("days, per_day", [(1, 4), (365, 1), (5000, 1), (130, 3)])
def test_walk_over_many_days(spark, days, per_day):
    """Each row holds a day or a block of days, and the values are those of a walk slice by slice."""
    rng = random.Random(days)
    steps = {k: sorted(rng.sample(range(1 + 7 * per_day, (days + 7) * per_day + 1), max(1, days * per_day // 2))) for k in (1, 2)}
    rows, want = [], {}
    for k, slots in steps.items():
        value = 7.0
        for slot in slots:
            a, b, lo, hi = rng.random() * 10, rng.choice([0.0, 0.5, 0.9]), 1.5, rng.choice([5.0, 20.0])
            value = max(lo, min(hi, a + b * value))
            rows.append((k, slot, (a, b, lo, hi)))
            want[k, slot] = value
    slices = spark.createDataFrame(rows, "road int, slot bigint, f struct<a:double,b:double,lo:double,hi:double>")
    start = spark.createDataFrame([(1, 7.0), (2, 7.0), (3, 7.0)], "road int, v double")
    got = {(r.road, r.slot): r.v for r in clamped.walk(slices, start, ["road"], "slot", per_day).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_allocated_times_sum_to_interval(fixtures):
    elements = traffic.route_elements(fixtures.pairs(), fixtures.road_state())
    parts = traffic.allocate(elements)
    back = parts.join(elements.select("suid", "utc", "pos", "coverage", "interval"), ["suid", "utc", "pos"])
    total = back.groupBy("suid", "utc", "interval").agg(
        F.sum(F.col("road_time") * F.col("coverage") + F.coalesce("turning_time", F.lit(0.0))).alias("t"))
    assert total.filter(F.abs(F.col("t") - F.col("interval")) > 1e-6).count() == 0


def test_modulo_examples(spark):
    cases = [(5.0, 3.0, 2.0), (5.0, -3.0, 2.0), (1.3, 0.5, 0.3), (1.3, -0.5, 0.3), (-5.0, 3.0, 1.0), (-5.0, -3.0, 1.0), (-1.3, 0.5, 0.2), (-1.3, -0.5, 0.2)]
    row = spark.range(1).select(*[S.ring_modulo(F.lit(a), m).alias(f"c{i}") for i, (a, m, _) in enumerate(cases)]).first()
    assert [round(v, 9) for v in row] == [c[2] for c in cases]


def test_cluster_over_midnight(spark):
    minutes = [23 * 60 + 57, 23 * 60 + 59, 1, 3, 700]
    df = spark.createDataFrame([(float(60 * m),) for m in minutes], "x double")
    found = clusters.ring_clusters(clusters.ring_values(df, 86400.0), 180.0, 2, 86400.0)
    rows = found.collect()
    assert len({r.cluster for r in rows}) == 1 and len(rows) == 4
    bounds = clusters.ring_bounds(found, 180.0, 86400.0).first()
    assert (bounds.left, bounds.right) == (86220.0, 180.0)


def test_density_steps_brute_force(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 12.0, 14.0, 50.0)], "x double")
    got = sorted((r.x, r.y) for r in clusters.density_steps(clusters.ring_values(df, 100.0), 3.0, 100.0).collect())
    # 10..14 is one cluster at levels 1 and 2, 50 a cluster at level 1; closed by steps down.
    assert got == [(0.0, 0), (10.0, 2), (14.0, 0), (50.0, 0), (50.0, 1)]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(spark.range(n + 1).withColumnRenamed("id", "node"), edges).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(n)}, n: n}


def test_candidate_at_start_of_following_road_goes(spark):
    cands = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.0), (1, 12, 0.3)], "s int, road_id bigint, fraction double")
    succ = spark.createDataFrame([(10, 11), (11, 13), (12, 14)], "id bigint, succ_id bigint")
    assert {r.road_id for r in spatial.minimise(cands, succ, ["s"]).collect()} == {10, 12}


def test_wkb_and_wkt(spark):
    raw = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 1.0, 2.0, 3.0, 4.0)
    df = spark.createDataFrame([(bytearray(raw), "LINESTRING(1 2, 3 4)")], "g binary, t string")
    row = df.select(parse_wkb_line("g").alias("a"), parse_wkt_line(F.col("t")).alias("b")).first()
    assert [tuple(p) for p in row.a] == [tuple(p) for p in row.b] == [(1.0, 2.0), (3.0, 4.0)]


def test_geodesic_known_values():
    # One degree along the equator and along the meridian from the equator.
    got = geo.inverse_geodesic([0.0, 0.0, 5.0], [0.0, 0.0, 50.0], [1.0, 0.0, 5.0], [0.0, 1.0, 50.0])
    assert got[0] == pytest.approx(111319.4908, abs=1e-3)
    assert got[1] == pytest.approx(110574.3886, abs=1e-3)
    assert got[2] == 0.0


def test_routes_agree_with_frontier(fixtures):
    roads, succ = fixtures.roads(), fixtures.successors()
    sources = roads.select(F.col("id").alias("src"))
    full = routing.reachable(roads, succ, sources, 500.0)
    got = routing.routes_between(full.select("src", "tgt", F.lit(500.0).alias("bound")), roads, succ, sources_per_group=20)
    price = routing.with_cost(roads).select(F.col("id").alias("tgt"), F.col("cost").alias("own"))
    both = full.join(got, ["src", "tgt"], "full").join(price, "tgt")
    assert both.filter(F.col("inner_cost").isNull() | F.col("cost").isNull() | (F.abs(F.col("inner_cost") + F.col("own") - F.col("cost")) > 1e-6)).count() == 0


def test_matching_finds_the_truth(fixtures):
    truth = fixtures.matched().select("suid", "utc", S.base_id(F.col("gid")).alias("want"))
    got = fixtures.traces().select("suid", "utc", S.base_id(F.col("road_id")).alias("got"))
    rows = truth.join(got, ["suid", "utc"])
    assert rows.count() == fixtures.samples().count()
    assert rows.filter("want = got").count() / rows.count() > 0.9


def test_matched_routes_are_valid_paths(fixtures):
    from roadpulse.operators.roads import invalid_paths

    paths = fixtures.traces().filter("path IS NOT NULL").select("suid", "utc", "path", F.lit(0.0).alias("start_fraction"), F.lit(1.0).alias("end_fraction"))
    assert invalid_paths(paths, fixtures.successors(), ["suid", "utc"]).count() == 0


def test_error_of_equal_sequences_is_zero(fixtures):
    seq = evaluate.road_sequence(fixtures.traces(), fixtures.roads(), ["suid", "date"])
    errors = evaluate.match_error(seq, seq, evaluate.align(seq, seq, ["suid", "date"]), ["suid", "date"])
    assert errors.filter(F.abs("error") > 1e-9).count() == 0


def test_window_emits_one_point_per_sample():
    def vector(n, preds):
        return [dict(road=i, fraction=0.5, seq=-float(i), pred=p) for i, p in zip(range(n), preds)]

    window = []
    assert matching.window_update(window, vector(2, [None, None]), {"utc": 0}, matching.MatchParams()) is None
    # Both continue from the first candidate, so it alone is left and is emitted.
    out = matching.window_update(window, vector(2, [0, 0]), {"utc": 10}, matching.MatchParams())
    assert out["utc"] == 0 and out["candidate"]["road"] == 0
    assert [c["pred"] for c in window[0]["vector"]] == [None, None]
    for i in range(2, 9):
        out = matching.window_update(window, vector(2, [0, 1]), {"utc": 10 * i}, matching.MatchParams())
    assert len(window) == 7 and out["utc"] == 10
    matching.slide(window, vector(2, [0, 1]), {"utc": 90}, k=3)
    assert len(window) == 4


def test_wkb_numbers_are_exact(spark):
    """Doubles of every kind come back bit by bit; what is no line of numbers is null."""
    rng = random.Random(17)
    numbers = [0.0, -0.0, 1.0, -1.5, 116.30217, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.pi, -39.9]
    numbers += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64) & ~(1 << 62)))[0] for _ in range(200)]
    little = lambda xs: struct.pack("<BII", 1, 2, len(xs) // 2) + struct.pack(f"<{len(xs)}d", *xs)
    big = lambda xs: struct.pack(">BII", 0, 2, len(xs) // 2) + struct.pack(f">{len(xs)}d", *xs)
    broken = [None, b"", b"\x01", little([1.0, 2.0])[:-1], little([1.0, float("nan")]), little([float("inf"), 1.0]), little([]), struct.pack("<BIIdd", 1, 1, 1, 1.0, 2.0)]
    df = spark.createDataFrame([(bytearray(g) if g is not None else None,) for g in [little(numbers), big(numbers), *broken]], "g binary")
    got = [r.p for r in df.select(parse_wkb_line("g").alias("p")).collect()]
    for line in got[:2]:
        assert [struct.pack("<d", x) for v in line for x in v] == [struct.pack("<d", x) for x in numbers]
    assert got[2:] == [None] * len(broken)
