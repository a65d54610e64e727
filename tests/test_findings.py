"""Tests of the findings of round 3."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from roadpulse.catalog import network
from roadpulse.catalog.fixtures import Fixtures
from roadpulse.operators import routing, spatial, traffic
from roadpulse.plans import clamped

SF_DIR = "/root/testdata/sf0.001"


def test_a_cut_chain_hides_no_cheaper_one(spark):
    """Road 4 is reached cheapest by 900 m, from where 9 is out of reach; the way by road 3 still is the cheapest to 9."""
    schema = "id bigint, points array<struct<lon:double,lat:double>>, length_m double, maxspeed double, priority double"
    ends = [{"lon": 10.0, "lat": 50.0}, {"lon": 10.0001, "lat": 50.0}]
    roads = spark.createDataFrame([(i, ends, float(l), 10.0, float(c)) for i, l, c in (
        (1, 100, 1), (2, 900, 1), (3, 100, 5), (4, 150, 1), (5, 200, 50), (9, 100, 1))], schema)
    follow = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 9), (1, 5), (5, 9)], "id bigint, succ_id bigint")
    wanted = spark.createDataFrame([(1, 9, 1000.0, 0.0)], "src bigint, tgt bigint, bound double, ends double")
    got = routing.routes_between(wanted, roads, follow, lambda length, speed, priority: priority).first()
    assert (got["path"], got["inner_cost"], got["inner_length"]) == ([1, 3, 4, 9], 6.0, 250.0)


def test_routes_of_a_step_are_named_by_places(spark):
    """Pairs of roads that end and start in the same places share one route."""
    routed = Fixtures(spark, SF_DIR).routed().filter("prev IS NOT NULL")
    pairs, routes = routed.agg(F.sum(F.size("prev.roads") * F.size("cs")), F.sum(F.size("routes"))).first()
    assert 0 < routes < pairs / 2


def test_pipeline_drops_what_simhash_links(spark):
    """1 and 2 have the same SimHash and few shingles in common, 2 and 3 the same shingles and another SimHash."""
    words = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    rows = [(3, f"{words('p', 11)} {words('p', 11)} {words('v', 60)}"), (1, f"{words('p', 11)} " * 200 + words("u", 60)),
            (2, f"{words('p', 11)} " * 200 + words("v", 60)), (4, words("x", 80)), (None, words("y", 80)), (None, words("y", 80))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()) == ["1", "4", "None"]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), SF_DIR).count() == 0


def test_allocation_prices_each_element_once(spark):
    """The totals come from the same elements, not from a second explosion of the routes."""
    f = Fixtures(spark, SF_DIR)
    found = traffic.allocate(traffic.route_elements(f.pairs(), network.road_state(f)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_nearby_samples_do_not_walk_the_hierarchy(spark, monkeypatch):
    f = Fixtures(spark, SF_DIR)
    walked = []
    whole = spatial._best_first
    monkeypatch.setattr(spatial, "_best_first", lambda samples, *more: walked.append(samples.count()) or whole(samples, *more))
    samples = f.samples().select("event_id", "lon", "lat")
    far = spark.createDataFrame([(-1, 100.0, 10.0), (-2, 116.3, 39.95)], "event_id long, lon double, lat double")
    got = spatial.k_nearest(samples.unionByName(far), f.base_roads(), 3, ["event_id"])
    want = spatial.k_nearest(samples.unionByName(far), spatial.RoadTree(f.base_roads()), 3, ["event_id"])
    key = lambda df: sorted((r["event_id"], r["place"], r["base_gid"], round(r["dist"], 6)) for r in df.collect())
    assert key(got) == key(want) and walked[0] < 0.1 * samples.count()


def test_smoothing_deals_rows_once(spark):
    rows = spark.range(10).selectExpr("id % 2 AS road", "id % 3 AS slot", "id AS _chunk", "id AS o").withColumn("f", clamped.identity())
    found = clamped.per_slice(rows, ["road"], "slot", "_chunk", ["o"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.count() == 6


def test_pipeline_seeks_what_hangs_together_once(spark, monkeypatch):
    """Bands put sets together, then the links of both rules are settled in one search, by a single key a text."""
    from roadpulse.llm import near_copies, shingles, simhash
    from roadpulse.plans import components

    searched = []
    whole = components.connected_components
    for module in (simhash, shingles, near_copies):
        monkeypatch.setattr(module, "connected_components", lambda nodes, edges: searched.append(1) or whole(nodes, edges), raising=False)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = near_copies.components(docs)
    assert found.count() == docs.count() and len(searched) == 2


def test_id_filter_is_as_large_as_its_ids_need(spark):
    from roadpulse.llm import common

    assert common.filter_bits(5_000) <= 1 << 18 and common.filter_bits(None) == common.filter_bits(1 << 40) == common.FILTER_BITS
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("_id"))
    passed = {r["_id"] for r in spark.range(3000).select(F.col("id").alias("_id")).where(common.id_filter(ids, "_id", 1000)).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1020


def test_cheapest_chains_by_place_are_those_of_all_rounds(spark):
    """Costs, lengths and chains of the search over lists, held against rounds over all roads until nothing changes."""
    import random

    import pandas as pd

    rng = random.Random(5)
    ends = [(rng.randrange(60), rng.randrange(60)) for _ in range(240)]
    price = [(float(rng.randrange(1, 9)), float(rng.randrange(1, 9))) for _ in ends]
    follow = [[j for j, (a, _) in enumerate(ends) if a == b] for _, b in ends]
    net = routing._Network(pd.DataFrame(dict(id=range(240), cost=[c for c, _ in price], length_m=[l for _, l in price], next=follow)))
    start = net.end[0]
    least = {start: (0.0, 0.0)}
    for _ in range(240):
        for place, (c, l) in list(least.items()):
            for cost, length, to, _road in net.ways(place):
                least[to] = min(least.get(to, (float("inf"),)), (c + cost, l + length))
    settled, costs, lengths, road, before = net.cheapest(start, [(-1,)], float("inf"))
    assert {p: (costs[p], lengths[p]) for p in range(len(settled)) if settled[p]} == least
    for place in least:
        if place != start:
            assert least[place] == (least[before[place]][0] + price[road[place]][0], least[before[place]][1] + price[road[place]][1])


def test_matched_tables_are_not_dealt_twice(spark):
    from roadpulse.catalog import fixtures

    class Own(Fixtures):
        OWN = frozenset({"routed"})

        @fixtures.stored
        def routed(self):
            return self.spark.range(100).repartition(1, "id")

    assert len(Own(spark, SF_DIR).routed().inputFiles()) == 1


def test_written_tables_leave_no_shuffles_and_their_drop_spares_others(spark, tmp_path):
    import os

    import pytest

    from roadpulse.plans import lineage

    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = shuffles()
    table, other = lineage.kept(made.repartition(3, "s")), lineage.cut(made.repartition(3, "s"))
    assert shuffles() <= before and table.schema == made.schema and sorted(table.collect()) == sorted(other.collect())
    beside = str(tmp_path / "beside")
    table.write.parquet(beside)
    lineage.drop(table.unionByName(spark.read.parquet(beside)))
    assert os.path.exists(beside) and not any(os.path.exists(f.removeprefix("file:")) for f in table.inputFiles())
    with pytest.raises(ValueError):
        lineage.delete(spark, beside)


def test_smoothing_moves_what_rows_are_made_from(spark):
    """Pairs in time order meet the state once, and are dealt to their slices once, without the functions made of them."""
    rows = spark.createDataFrame([(5, 100, 1, 0, "speed", 8.0, None, None, 50.0, 20.0)],
                                 "road long, utc long, suid long, pos int, kind string, value double, next_road long, turning_time double, length double, max_speed double")
    found = traffic.timed_slices(traffic.timed_updates(rows), traffic.ORDER, traffic.minute_chunk())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert [(r.road, r.slot) for r in found.collect()] == [(5, 1)]


def test_a_batch_of_pairs_leaves_nothing_it_kept(spark):
    """Two batches, the second two days later and with a turn of the first; only what the stream writes is left."""
    import os

    from roadpulse.plans import lineage
    from roadpulse.sources import roads as sources
    from roadpulse.streaming import pipeline

    folder = lineage.shared_dir(spark).removeprefix("file:")
    kept = lambda: {name for name in os.listdir(folder) if name.startswith("kept-")}
    f = Fixtures(spark, SF_DIR)
    pairs, history, start = f.pairs(), f.history(), network.road_state(f)
    before = kept()
    state = pipeline.PairState(start, history, sources.class_history(history), lineage.scratch_path(spark, "batches"))
    shift = lambda days: pairs.withColumn("utc", F.col("utc") + days * 86400).withColumn("pre_utc", F.col("pre_utc") + days * 86400)
    state(pairs, 0)
    state(shift(2).unionByName(shift(3)), 1)
    assert kept() <= before
    whole = traffic.road_speeds(pairs, start)[0].filter("closed")
    assert state.closed().filter(F.col("day") == whole.agg(F.min("day")).first()[0]).count() >= whole.count() > 0
    assert state.turnings().count() > 0
