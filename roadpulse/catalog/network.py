"""Queries on roads, topology, paths and scalar road functions."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import CLASS_IDS, Fixtures, sql, sql_planar
from roadpulse.catalog.registry import query
from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.operators import roads as R
from roadpulse.params import ROAD_CLASS_PRIORITY
from roadpulse.plans.lineage import scratch_path
from roadpulse.sources import roads as RS

SECONDS = "length_m * 3.6e0 / least(maxspeed, 130)"
TP = f"({SECONDS} * greatest(1e0, priority))"


@query("S6_scan_ways", sql("""
    SELECT gid, osm_id, class_id, source, target, reverse_cost, maxspeed_forward, maxspeed_backward FROM ways""", "ways"))
def _(f):
    return f.ways().select(
        "gid", "osm_id", "class_id", "source", "target", "reverse_cost",
        F.col("maxspeed_forward").cast("double").alias("maxspeed_forward"),
        F.col("maxspeed_backward").cast("double").alias("maxspeed_backward"))


BOX = (116.305, 39.903, 116.311, 39.912)


@query("S7_filter_box_and_class", sql(f"""
    SELECT base_gid FROM base_roads WHERE class_id NOT IN (101, 113)
      AND greatest(lon0, lon1, lon2) >= {BOX[0]}e0 AND greatest(lat0, lat1, lat2) >= {BOX[1]}e0
      AND least(lon0, lon1, lon2) <= {BOX[2]}e0 AND least(lat0, lat1, lat2) <= {BOX[3]}e0""", "base_roads"))
def _(f):
    base = RS.base_roads(f.ways(), f.road_class(), excluded=(101, 113))
    return RS.in_box(RS.with_bounds(base), BOX).select("base_gid")


RING = [(116.3005, 39.9005), (116.3125, 39.9035), (116.3095, 39.9125), (116.3025, 39.9095)]
_TURN = "sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))".format


@query("S7_filter_polygon", sql(f"""
    SELECT base_gid FROM base_roads WHERE base_gid IN (
      SELECT base_gid FROM spots, sides WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
      GROUP BY base_gid, place HAVING count(*) % 2 = 1)
    OR base_gid IN (
      SELECT base_gid FROM lines, sides
      WHERE {_TURN(ax='a1', ay='b1', bx='a2', by='b2', cx='x1', cy='y1')} * {_TURN(ax='a1', ay='b1', bx='a2', by='b2', cx='x2', cy='y2')} <= 0
        AND {_TURN(ax='x1', ay='y1', bx='x2', by='y2', cx='a1', cy='b1')} * {_TURN(ax='x1', ay='y1', bx='x2', by='y2', cx='a2', cy='b2')} <= 0)""",
    "base_roads",
    sides="SELECT * FROM (VALUES " + ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(RING, RING[1:] + RING[:1])) + ") v(x1, y1, x2, y2)",
    spots="SELECT base_gid, 0 AS place, lon0 AS lon, lat0 AS lat FROM base_roads UNION ALL SELECT base_gid, 1, lon1, lat1 FROM base_roads "
          "UNION ALL SELECT base_gid, 2, lon2, lat2 FROM base_roads",
    lines="SELECT base_gid, lon0 AS a1, lat0 AS b1, lon1 AS a2, lat1 AS b2 FROM base_roads UNION ALL SELECT base_gid, lon1, lat1, lon2, lat2 FROM base_roads"))
def _(f):
    return RS.in_polygon(RS.with_bounds(f.base_roads()), RING).select("base_gid")


@query("S8_road_classes", sql("""
    SELECT w.class_id, c.priority, c.maxspeed, count(*) AS roads FROM ways w JOIN road_class c USING (class_id)
    GROUP BY ALL""", "ways", "road_class"))
def _(f):
    """Classes read back from their JSON form, counted on the road table."""
    text = json.dumps({"tags": [{"values": [{"id": c, "priority": p, "maxspeed": 33} for c, p in ROAD_CLASS_PRIORITY]}]})
    classes = RS.flatten_road_classes(f.spark.createDataFrame([(text,)], "value string"))
    return f.ways().join(classes, "class_id").groupBy("class_id", "priority", "maxspeed").agg(F.count(F.lit(1)).alias("roads"))


HISTORY = "SELECT gid, seq, class_id, round(average_speed, 6) AS average_speed, round(time, 6) AS time FROM history"


@query("S9_history", sql(HISTORY, "history"))
def _(f):
    return f.history().select(
        "gid", F.col("seq").cast("bigint").alias("seq"), "class_id",
        F.round("average_speed", 6).alias("average_speed"), F.round("time", 6).alias("time"))


@query("S10_listed_roads", sql("SELECT id FROM roads WHERE base_gid IN (SELECT gid FROM ways WHERE class_id IN (113, 114))", "roads", "ways"))
def _(f):
    overpass = f.ways().filter(F.col("class_id").isin(113, 114)).select(F.col("gid").alias("base_gid"))
    return RS.restrict_to(f.roads(), overpass, "base_gid").select("id")


@query("J16_restriction_lists", sql("""
    SELECT a.id, a.succ_id FROM successors a JOIN roads r ON r.id = a.id JOIN roads s ON s.id = a.succ_id
    WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.class_id IN (113, 114) AND w.gid = r.base_gid)
      AND NOT (r.class_id = 105 AND s.class_id = 106)""", "successors", "roads", "ways"))
def _(f):
    roads = f.roads()
    overpass = f.ways().filter(F.col("class_id").isin(113, 114)).select(F.col("gid").alias("base_gid"))
    allowed = RS.restrict_to(roads, overpass, "base_gid", keep=False).select("id")
    a = roads.filter(F.col("class_id") == 105).select("id", F.col("target").alias("node"))
    b = roads.filter(F.col("class_id") == 106).select(F.col("id").alias("succ_id"), F.col("source").alias("node"))
    connectors = a.join(b, "node").select("id", "succ_id")
    return f.successors().join(allowed, "id", "left_semi").join(connectors, ["id", "succ_id"], "left_anti")


ROAD_ROWS = """SELECT id, base_gid, source, target, class_id, CAST(maxspeed AS DOUBLE) AS maxspeed, round(length_m, 6) AS length_m FROM roads"""


@query("K9_S11_road_snapshot", sql(ROAD_ROWS, "roads"))
def _(f):
    path = scratch_path(f.spark, "roads")
    f.roads().write.parquet(path)
    return f.spark.read.parquet(path).select(
        "id", "base_gid", "source", "target", "class_id", "maxspeed", F.round("length_m", 6).alias("length_m"))


@query("G12_split_directions", sql(
    "SELECT id, base_gid, forward, source, target, round(lon0, 6) AS lon0, round(lat2, 6) AS lat2 FROM roads", "roads"))
def _(f):
    return R.split_directions(f.base_roads()).select(
        "id", "base_gid", "forward", "source", "target",
        F.round(F.element_at("points", 1).lon, 6).alias("lon0"), F.round(F.element_at("points", -1).lat, 6).alias("lat2"))


@query("P15_P16_P17_settle_roads", sql("""
    SELECT base_gid, class_id, priority, CAST(speed_forward AS DOUBLE) AS speed_forward, oneway,
      CASE WHEN oneway THEN -1000e0 ELSE 1000e0 END AS reverse_cost_m FROM base_roads""", "base_roads"))
def _(f):
    return f.base_roads().select("base_gid", "class_id", "priority", "speed_forward", "oneway", "reverse_cost_m")


@query("P15_known_classes", sql("SELECT gid FROM ways WHERE class_id IN (101, 102, 104)", "ways"))
def _(f):
    few = f.road_class().filter(F.col("class_id").isin(101, 102, 104))
    return RS.base_roads(f.ways(), few).select(F.col("base_gid").alias("gid"))


@query("P16_default_speed", sql(
    "SELECT base_gid, CAST(speed_backward AS DOUBLE) AS speed_backward, priority FROM base_roads WHERE speed_forward = 33", "base_roads"))
def _(f):
    return f.base_roads().filter(F.col("speed_forward") == 33).select("base_gid", "speed_backward", "priority")


@query("P17_one_way", sql("SELECT base_gid FROM base_roads WHERE oneway", "base_roads"))
def _(f):
    return f.base_roads().filter("oneway").select("base_gid")


@query("J1_successors", sql("SELECT id, succ_id FROM successors", "successors"))
def _(f):
    return f.successors()


@query("U3_edit_edges", sql("""
    SELECT id, source, target FROM roads WHERE class_id <> 101 UNION ALL
    SELECT id + 1000000000, target, source FROM roads WHERE class_id = 102""", "roads"))
def _(f):
    edges = f.roads().select("id", "source", "target", "class_id")
    fewer = R.remove_edges(edges, edges.filter(F.col("class_id") == 101).select("id"))
    more = edges.filter(F.col("class_id") == 102).select(
        (F.col("id") + 1000000000).alias("id"), F.col("target").alias("source"), F.col("source").alias("target"), "class_id")
    return R.add_edges(fewer, more.unionByName(fewer.limit(0))).select("id", "source", "target")


@query("U4_set_difference", sql("""
    SELECT id FROM roads WHERE id NOT IN (SELECT succ_id FROM successors s JOIN roads r ON r.id = s.id WHERE r.class_id = 105)""",
    "roads", "successors"))
def _(f):
    reached = f.successors().join(f.roads().filter(F.col("class_id") == 105).select("id"), "id", "left_semi")
    return f.roads().select("id").join(reached.select(F.col("succ_id").alias("id")), "id", "left_anti")


@query("A1_class_history", sql("SELECT class_id, seq, round(average_speed, 6) AS average_speed FROM class_history", "class_history"))
def _(f):
    return RS.class_history(f.history()).select(
        "class_id", F.col("seq").cast("bigint").alias("seq"), F.round("average_speed", 6).alias("average_speed"))


def road_state(f: Fixtures):
    return f.road_state()


@query("J8_initial_state", sql("""
    SELECT gid, class_id, round(max_speed, 6) AS max_speed, round(avg_speed, 6) AS avg_speed, round(time, 6) AS time
    FROM road_state""", "road_state"))
def _(f):
    history = f.history()
    state = R.initial_state(f.roads(), history, RS.class_history(history))
    return state.select(
        "gid", "class_id", *[F.round(c, 6).alias(c) for c in ("max_speed", "avg_speed", "time")])


@query("F8_directed_ids", sql("SELECT id, id // 2 AS base_gid, id % 2 = 0 AS forward FROM roads", "roads"))
def _(f):
    pairs = f.roads().select(S.directed_id(F.col("base_gid"), F.col("forward")).alias("id"))
    return pairs.select("id", S.base_id(F.col("id")).alias("base_gid"), S.is_forward(F.col("id")).alias("forward"))


@query("F9_edge_costs", sql(f"""
    SELECT id, round(length_m, 6) AS distance, round({SECONDS}, 6) AS seconds, round({TP}, 6) AS weighted,
      round({TP} * 0.25e0, 6) AS quarter FROM roads""", "roads"))
def _(f):
    three = [F.col("length_m"), F.col("maxspeed"), F.col("priority")]
    return f.roads().select(
        "id", F.round(S.cost_distance(*three), 6).alias("distance"), F.round(S.cost_time(*three), 6).alias("seconds"),
        F.round(S.cost_time_priority(*three), 6).alias("weighted"),
        F.round(S.cost_time_priority(*three) * 0.25, 6).alias("quarter"))


@query("X3_own_cost", sql("SELECT id, round(length_m * priority, 6) AS cost FROM roads", "roads"))
def _(f):
    return R.with_cost(f.roads(), lambda length, maxspeed, priority: length * priority).select("id", F.round("cost", 6).alias("cost"))


@query("F4_polyline_length", sql("SELECT base_gid, round(length_m, 6) AS planar FROM base_roads", "base_roads"))
def _(f):
    return f.base_roads().select("base_gid", F.round(geo.polyline_length(F.col("points")), 6).alias("planar"))


@query("F7_reverse_polyline", sql("SELECT base_gid, round(lon2, 6) AS lon, round(lat2, 6) AS lat FROM base_roads", "base_roads"))
def _(f):
    first = F.element_at(geo.reverse_polyline(F.col("points")), 1)
    return f.base_roads().select("base_gid", F.round(first.lon, 6).alias("lon"), F.round(first.lat, 6).alias("lat"))


# Paths of the trajectory pairs: key (suid, utc), the road ids, and both fractions.
PATHS = """SELECT suid, utc, route AS path, pre_offset AS start_fraction, "offset" AS end_fraction FROM raw_pairs"""


def paths(f: Fixtures):
    return f.raw_pairs().select(
        "suid", "utc", F.col("route").alias("path"), F.col("pre_offset").alias("start_fraction"), F.col("offset").alias("end_fraction"))


_PARTS = "SELECT suid, utc, path, start_fraction, end_fraction, unnest(path) AS id, unnest(range(len(path))) AS pos FROM paths"
_SHARE = """(1e0 - (CASE WHEN pos = 0 THEN start_fraction ELSE 0e0 END) - (CASE WHEN pos = len(path) - 1 THEN 1e0 - end_fraction ELSE 0e0 END))"""


@query("G2_G5_path_totals", sql(f"""
    SELECT suid, utc, round(sum({_SHARE} * {TP}), 5) AS cost, round(sum({_SHARE} * length_m), 5) AS length_m,
      round(sum({_SHARE} * {SECONDS}), 5) AS seconds FROM parts JOIN roads USING (id) GROUP BY suid, utc""",
    "raw_pairs", "roads", paths=PATHS, parts=_PARTS))
def _(f):
    return R.path_totals(paths(f), f.roads(), ["suid", "utc"]).select(
        "suid", "utc", *[F.round(c, 5).alias(c) for c in ("cost", "length_m", "seconds")])


BROKEN = """SELECT suid, utc, start_fraction, end_fraction,
    CASE WHEN utc % 5 = 0 AND len(path) > 2 THEN list_concat(path[1:1], path[3:]) ELSE path END AS path FROM paths"""


@query("G3_invalid_paths", sql("""
    SELECT DISTINCT suid, utc FROM (
      SELECT suid, utc, id, lead(id) OVER (PARTITION BY suid, utc ORDER BY pos) AS succ_id FROM (
        SELECT suid, utc, unnest(path) AS id, unnest(range(len(path))) AS pos FROM broken)) s
    WHERE succ_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM successors x WHERE x.id = s.id AND x.succ_id = s.succ_id)""",
    "raw_pairs", "successors", paths=PATHS, broken=BROKEN))
def _(f):
    cut = F.concat(F.slice("path", 1, 1), F.slice("path", F.lit(3), F.greatest(F.size("path") - 2, F.lit(0))))
    broken = paths(f).withColumn(
        "path", F.when((F.pmod("utc", F.lit(5)) == 0) & (F.size("path") > 2), cut).otherwise(F.col("path")))
    return R.invalid_paths(broken, f.successors(), ["suid", "utc"])


@query("G4_join_paths", sql("""
    SELECT a.suid, a.utc, array_to_string(CASE WHEN a.path[len(a.path)] = b.path[1] THEN list_concat(a.path, b.path[2:]) END, ',') AS path
    FROM (SELECT *, path AS p FROM paths) a JOIN (
      SELECT suid, pre_utc, route AS path FROM raw_pairs) b ON b.suid = a.suid AND b.pre_utc = a.utc""",
    "raw_pairs", paths=PATHS))
def _(f):
    a = paths(f)
    b = f.raw_pairs().select(
        "suid", F.col("pre_utc").alias("utc"), F.col("route").alias("next_path"), F.col("pre_offset").alias("next_start"))
    joined = R.join_paths(F.col("path"), F.col("next_path"), F.col("end_fraction"), F.col("next_start"))
    return a.join(b, ["suid", "utc"]).select(
        "suid", "utc", F.array_join(F.transform(joined, lambda x: x.cast("string")), ",").alias("path"))


@query("G5_route_texts", sql("""
    SELECT suid, utc, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS roads,
      round(sum(length_m), 5) AS whole_length FROM parts JOIN roads USING (id) GROUP BY suid, utc""",
    "raw_pairs", "roads", paths=PATHS, parts=_PARTS))
def _(f):
    parts = R.explode_path(paths(f), ["suid", "utc"]).join(f.roads().select("id", "length_m"), "id")
    listed = parts.groupBy("suid", "utc").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "length_m"))).alias("p"), F.sum("length_m").alias("whole"))
    ids, _lengths = R.path_texts(F.transform("p", lambda x: x.id), F.transform("p", lambda x: x.length_m))
    return listed.select("suid", "utc", ids.alias("roads"), F.round("whole", 5).alias("whole_length"))


@query("G5_route_geometry")
def _(f):
    return R.path_geometry(paths(f), f.roads(), ["suid", "utc"]).select("suid", "utc", geo.wkt_line(F.col("points")).alias("wkt"))


# -- stored copies, as the readers find them ------------------------------------------

def _wkb(points):
    """WKB line strings for the stored copy, every other one with its most significant byte first."""

    @F.pandas_udf("binary")
    def packed(lines: pd.Series, gid: pd.Series) -> pd.Series:
        return pd.Series([
            struct.pack("<BII" if g % 2 else ">BII", g % 2, 2, len(line)) + struct.pack(("<" if g % 2 else ">") + f"{2 * len(line)}d", *[x for v in line for x in (v["lon"], v["lat"])])
            for line, g in zip(lines, gid)])

    return packed(points, F.col("gid"))


@query("S6_stored_ways", sql("""
    SELECT gid, osm_id, CAST(class_id AS SMALLINT) AS class_id, source, target, reverse_cost, lon0, lat0, lon1, lat1, lon2, lat2 FROM ways""", "ways"))
def _(f):
    """The road table read back from a copy with WKB polylines."""
    path = scratch_path(f.spark, "wkb-ways")
    kinds = {c.name: c.dataType for c in RS.WAYS_SCHEMA}
    f.ways().withColumn("geom", _wkb(F.col("points"))).withColumns(
        {c: F.col(c).cast(kinds[c]) if c in f.ways().columns else F.lit(None).cast(kinds[c]) for c in kinds if c != "geom"}).select(*kinds).write.parquet(path)
    point = lambda i, c: F.element_at("points", i + 1)[c].alias(f"{c}{i}")
    return RS.read_ways(f.spark, path).select("gid", "osm_id", "class_id", "source", "target", "reverse_cost", *[point(i, c) for i in range(3) for c in ("lon", "lat")])


@query("S3_stored_day", sql("SELECT suid, utc, lat, lon, head, passenger FROM gps", "gps"))
def _(f):
    """A day table read back from a copy with status texts."""
    from roadpulse.sources import gps as G

    path = scratch_path(f.spark, "day")
    f.raw_gps().write.parquet(path)
    return G.read_gps_table(f.spark, path)


@query("S9_stored_history", sql(
    "SELECT gid, CAST(seq AS INTEGER) AS seq, base_gid, class_id, round(average_speed, 6) AS average_speed FROM history", "history"))
def _(f):
    """History read back from a copy."""
    path = scratch_path(f.spark, "history-copy")
    f.history().write.parquet(path)
    return RS.read_history(f.spark, path).select("gid", "seq", "base_gid", "class_id", F.round("average_speed", 6).alias("average_speed"))
