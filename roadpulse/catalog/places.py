"""Queries on geometry, spatial joins and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import (
    Fixtures, sql, sql_haversine, sql_kx, sql_ky, sql_planar,
)
from roadpulse.catalog.registry import query
from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.operators import clusters as C
from roadpulse.operators import spatial as SP

SEGS = f"""
  SELECT base_gid, oneway, length_m, 0 AS leg, lon0 AS x1, lat0 AS y1, lon1 AS x2, lat1 AS y2, 0e0 AS before, len1 AS leg_length FROM base_roads
  UNION ALL
  SELECT base_gid, oneway, length_m, 1, lon1, lat1, lon2, lat2, len1, {sql_planar('lon1', 'lat1', 'lon2', 'lat2')} FROM base_roads"""
POINTS = f"SELECT event_id, suid, utc, lon, lat, {sql_kx('lat')} AS kx, {sql_ky('lat')} AS ky FROM samples"
PROJECTED = """
  SELECT *, sqrt(pow((x1 + (x2 - x1) * t - lon) * kx, 2) + pow((y1 + (y2 - y1) * t - lat) * ky, 2)) AS dist FROM (
    SELECT *, greatest(0e0, least(1e0, CASE WHEN dx * dx + dy * dy > 0 THEN (px * dx + py * dy) / (dx * dx + dy * dy) ELSE 0e0 END)) AS t FROM (
      SELECT p.event_id, p.lon, p.lat, p.kx, p.ky, s.*, (x2 - x1) * kx AS dx, (y2 - y1) * ky AS dy,
        (p.lon - x1) * kx AS px, (p.lat - y1) * ky AS py
      FROM points p JOIN segs s ON {near}))"""
CLOSEST = """
  SELECT event_id, base_gid, oneway, fraction, dist FROM (
    SELECT *, (before + t * leg_length) / length_m AS fraction,
      row_number() OVER (PARTITION BY event_id, base_gid ORDER BY dist, leg) AS place FROM projected)
  WHERE place = 1"""
NEAR = "abs(p.lat - (y1 + y2) / 2) < 0.004e0 AND abs(p.lon - (x1 + x2) / 2) < 0.004e0"
LOCAL = dict(segs=SEGS, points=POINTS, projected=PROJECTED.format(near=NEAR), closest=CLOSEST)
GLOBAL = dict(segs=SEGS, points=POINTS, projected=PROJECTED.format(near="TRUE"), closest=CLOSEST)
DIRECTED = """
  SELECT event_id, base_gid * 2 AS road_id, fraction, dist FROM closest WHERE dist < 100
  UNION ALL SELECT event_id, base_gid * 2 + 1, 1 - fraction, dist FROM closest WHERE dist < 100 AND NOT oneway"""


@query("J2_radius_join", sql("SELECT event_id, road_id, round(fraction, 6) AS fraction, round(dist, 5) AS dist FROM directed",
                             "samples", "base_roads", **LOCAL, directed=DIRECTED))
def _(f):
    found = SP.radius_candidates(f.samples(), f.base_roads(), 100.0, ["event_id"])
    return found.select("event_id", "road_id", F.round("fraction", 6).alias("fraction"), F.round("dist", 5).alias("dist"))


SPHERE = f"""
  SELECT event_id, base_gid, oneway, fraction, dist FROM (
    SELECT *, (before + t * leg_length) / length_m AS fraction, row_number() OVER (PARTITION BY event_id, base_gid ORDER BY dist, leg) AS place
    FROM (SELECT * EXCLUDE (dist), {sql_haversine('lon', 'lat', '(x1 + (x2 - x1) * t)', '(y1 + (y2 - y1) * t)')} AS dist FROM projected))
  WHERE place = 1"""


@query("X4_radius_on_the_sphere", sql("SELECT event_id, road_id, round(fraction, 6) AS fraction, round(dist, 4) AS dist FROM directed",
                                      "samples", "base_roads", **{**LOCAL, "closest": SPHERE}, directed=DIRECTED))
def _(f):
    found = SP.radius_candidates(f.samples(), f.base_roads(), 100.0, ["event_id"], metric="haversine")
    return found.select("event_id", "road_id", F.round("fraction", 6).alias("fraction"), F.round("dist", 4).alias("dist"))


@query("X4_nearest_on_the_sphere", sql("""
    SELECT event_id, round(min(dist), 4) AS dist FROM closest GROUP BY event_id""", "samples", "base_roads", **{**GLOBAL, "closest": SPHERE}))
def _(f):
    found = SP.nearest(f.samples(), f.base_roads(), ["event_id"], metric="haversine")
    return found.groupBy("event_id").agg(F.round(F.min("dist"), 4).alias("dist"))


@query("J3_nearest_road", sql("""
    SELECT event_id, base_gid, round(dist, 5) AS dist FROM (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY dist) AS place FROM closest)
    WHERE place = 1""", "samples", "base_roads", **GLOBAL))
def _(f):
    return SP.nearest(f.samples(), f.base_roads(), ["event_id"]).select("event_id", "base_gid", F.round("dist", 5).alias("dist"))


@query("J4_O4_k_nearest", sql("""
    SELECT event_id, base_gid, round(dist, 5) AS dist, place FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, base_gid) AS place FROM closest) WHERE place <= 3""",
    "samples", "base_roads", **GLOBAL))
def _(f):
    return SP.k_nearest(f.samples(), f.base_roads(), 3, ["event_id"]).select(
        "event_id", "base_gid", F.round("dist", 5).alias("dist"), "place")


@query("J5_minimise_candidates", sql("""
    SELECT event_id, road_id, round(fraction, 6) AS fraction FROM directed c
    WHERE NOT (fraction = 0 AND EXISTS (
        SELECT 1 FROM directed o JOIN successors s ON s.id = o.road_id WHERE o.event_id = c.event_id AND s.succ_id = c.road_id))
      AND NOT (fraction = 1 AND NOT EXISTS (
        SELECT 1 FROM successors s WHERE s.id = c.road_id AND NOT EXISTS (
          SELECT 1 FROM directed o WHERE o.event_id = c.event_id AND o.road_id = s.succ_id AND o.fraction <> 0)))""",
    "samples", "base_roads", "successors", **LOCAL, directed=DIRECTED))
def _(f):
    found = SP.radius_candidates(f.samples(), f.base_roads(), 100.0, ["event_id"])
    return SP.minimise(found, f.successors(), ["event_id"]).select("event_id", "road_id", F.round("fraction", 6).alias("fraction"))


DISTINCT = "SELECT CAST(lon * 10000000 + lat AS BIGINT) AS id, lon / 1e5 AS lon, lat / 1e5 AS lat FROM (SELECT DISTINCT lon, lat FROM gps)"


def positions(f: Fixtures):
    """Distinct positions, named by their coordinates."""
    spots = f.gps().select("lon", "lat").distinct()
    return spots.select(
        (F.col("lon").cast("bigint") * 10000000 + F.col("lat")).alias("id"), (F.col("lon") / 1e5).alias("lon"), (F.col("lat") / 1e5).alias("lat"))


PAIRS = f"""
  SELECT a.id AS a, b.id AS b, {sql_planar('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS dist FROM spots a JOIN spots b
    ON a.id < b.id AND abs(a.lat - b.lat) < 0.0003e0 AND abs(a.lon - b.lon) < 0.0004e0"""
EPS, MINIMUM = 20.0, 5


@query("J15_point_pairs", sql(f"SELECT a, b, round(dist, 5) AS dist FROM near WHERE dist < {EPS}", "gps", spots=DISTINCT, near=PAIRS))
def _(f):
    return SP.point_pairs(positions(f), EPS).withColumn("dist", F.round("dist", 5))


PLANE = dict(
    spots=DISTINCT, near=PAIRS,
    links=f"SELECT a, b, dist FROM near WHERE dist < {EPS} UNION ALL SELECT b, a, dist FROM near WHERE dist < {EPS}",
    cores=f"SELECT s.id FROM spots s LEFT JOIN links l ON l.a = s.id GROUP BY s.id HAVING count(l.b) + 1 >= {MINIMUM}",
    core_links="SELECT a, b FROM links WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)",
    reach="SELECT id AS a, id AS b FROM cores UNION SELECT r.a, l.b FROM reach r JOIN core_links l ON l.a = r.b",
    labels="SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a",
)


@query("G9_density_clusters", sql("""
    SELECT id, cluster, TRUE AS core FROM labels UNION ALL
    SELECT l.a, arg_min(c.cluster, (l.dist, l.b)), FALSE FROM links l JOIN labels c ON c.id = l.b
    WHERE l.a NOT IN (SELECT id FROM cores) GROUP BY l.a""", "gps", **PLANE))
def _(f):
    return C.density_clusters(positions(f), EPS, MINIMUM)


@query("A17_road_components", sql("""
    SELECT e.id, c.component FROM some_roads e JOIN (
      SELECT r.a AS node, min(n.least) AS component FROM reach r JOIN nodes n ON n.node = r.b GROUP BY r.a) c ON c.node = e.source""",
    "roads",
    some_roads="SELECT id, source, target FROM roads WHERE class_id % 3 <> 0",
    nodes="SELECT source AS node, min(id) AS least FROM some_roads GROUP BY source",
    linked="""SELECT source AS a, target AS b FROM some_roads WHERE target IN (SELECT node FROM nodes)
      UNION SELECT target, source FROM some_roads WHERE target IN (SELECT node FROM nodes)""",
    reach="SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b"))
def _(f):
    return C.road_components(f.roads().filter(F.pmod("class_id", F.lit(3)) != 0).select("id", "source", "target"))


# -- times of day -----------------------------------------------------------------

RING, RING_EPS = 86400.0, 30.0
TIMES = "SELECT fmod(epoch_us(ts) / 1e6, 86400e0) AS x FROM events"
SPOTS = "SELECT x, count(*) AS n FROM times GROUP BY x"
COUNTS = f"""SELECT x, CAST(sum(n) OVER (ORDER BY x RANGE BETWEEN {RING_EPS!r}e0 PRECEDING AND {RING_EPS!r}e0 FOLLOWING) AS BIGINT) AS neighbours FROM vals"""
ROUNDED_TIMES = "SELECT floor(y) + floor((y - floor(y)) * 1e10 + 0.5e0) / 1e10 AS x FROM (SELECT fmod(epoch_us(ts) / 1e6, 86400e0) AS y FROM events)"
RING_SPREAD = f"SELECT x FROM vals UNION ALL SELECT x - {RING!r}e0 FROM vals UNION ALL SELECT x + {RING!r}e0 FROM vals"
RING_COUNTS = f"""SELECT x, neighbours FROM (
    SELECT x, k, CAST(sum(n) OVER (ORDER BY x + k * {RING!r}e0 RANGE BETWEEN {RING_EPS!r}e0 PRECEDING AND {RING_EPS!r}e0 FOLLOWING) AS BIGINT) AS neighbours
    FROM vals, (VALUES (-1), (0), (1)) t(k)) WHERE k = 0"""


def times(f: Fixtures):
    return f.events().select((F.col("epoch") % F.lit(RING)).alias("x"))


@query("W12_line_counts", sql("SELECT round(x, 6) AS x, neighbours FROM counts", times=TIMES, vals=SPOTS, counts=COUNTS))
def _(f):
    return C.line_counts(C.distinct_values(times(f)), RING_EPS).withColumn("x", F.round("x", 6))


@query("W13_ring_counts", sql("SELECT round(x, 6) AS x, neighbours FROM counts", times=ROUNDED_TIMES, vals=SPOTS, counts=RING_COUNTS))
def _(f):
    return C.ring_counts(C.ring_values(times(f), RING), RING_EPS, RING).withColumn("x", F.round("x", 6))


CORE_MIN = 3
LINE = dict(
    times=TIMES, vals=SPOTS, counts=COUNTS,
    cores=f"SELECT x FROM counts WHERE neighbours >= {CORE_MIN}",
    runs=f"""SELECT x, max(start) OVER (ORDER BY x) AS cluster FROM (
      SELECT x, CASE WHEN lag(x) OVER (ORDER BY x) IS NULL OR x - lag(x) OVER (ORDER BY x) > {RING_EPS!r}e0 THEN x END AS start FROM cores)""",
)


@query("G10_line_clusters", sql(f"""
    SELECT round(x, 6) AS x, TRUE AS core, round(cluster, 6) AS cluster FROM runs UNION ALL
    SELECT round(c.x, 6), FALSE, round(arg_min(r.cluster, (abs(r.x - c.x), r.x)), 6) FROM counts c JOIN runs r ON abs(r.x - c.x) <= {RING_EPS!r}e0
    WHERE c.neighbours < {CORE_MIN} GROUP BY c.x""", **LINE))
def _(f):
    found = C.line_clusters(C.distinct_values(times(f)), RING_EPS, CORE_MIN)
    return found.select(F.round("x", 6).alias("x"), "core", F.round("cluster", 6).alias("cluster"))


RING_CTES = dict(
    times=ROUNDED_TIMES, vals=SPOTS, counts=RING_COUNTS,
    cores=f"SELECT x FROM counts WHERE neighbours >= {CORE_MIN}",
    runs0=LINE["runs"],
    edge="SELECT min(x) AS first_core, max(x) AS last_core, max(cluster) AS last_run FROM runs0",
    runs=f"""SELECT x, CASE WHEN first_core + {RING!r}e0 - last_core <= {RING_EPS!r}e0 AND cluster = first_core THEN last_run ELSE cluster END AS cluster
      FROM runs0, edge""",
    spread=f"SELECT x + k * {RING!r}e0 AS y, cluster FROM runs, (VALUES (-1), (0), (1)) t(k)",
    members=f"""SELECT x, TRUE AS core, cluster FROM runs UNION ALL
      SELECT c.x, FALSE, arg_min(s.cluster, (abs(s.y - c.x), s.y)) FROM counts c JOIN spread s ON abs(s.y - c.x) <= {RING_EPS!r}e0
      WHERE c.neighbours < {CORE_MIN} GROUP BY c.x""",
)


def ring(f: Fixtures):
    return C.ring_clusters(C.ring_values(times(f), RING), RING_EPS, CORE_MIN, RING)


@query("G11_ring_clusters", sql("SELECT round(x, 6) AS x, core, round(cluster, 6) AS cluster FROM members", **RING_CTES))
def _(f):
    return ring(f).select(F.round("x", 6).alias("x"), "core", F.round("cluster", 6).alias("cluster"))


GAPS = f"""
  SELECT cluster, x, p, CASE WHEN x >= p THEN x - p ELSE {RING!r}e0 - p + x END AS gap, size FROM (
    SELECT cluster, x, coalesce(lag(x) OVER (PARTITION BY cluster ORDER BY x), max(x) OVER (PARTITION BY cluster)) AS p,
      count(*) OVER (PARTITION BY cluster) AS size FROM members)"""
BUFFER = 10.0


def _ring_sql(v: str) -> str:
    return f"fmod(fmod({v}, {RING!r}e0) + {RING!r}e0, {RING!r}e0)"


@query("W14_ring_bounds", sql(f"""
    SELECT round(c.cluster, 6) AS cluster, round({_ring_sql(f'w.x - {BUFFER!r}e0')}, 6) AS "left", round({_ring_sql(f'w.p + {BUFFER!r}e0')}, 6) AS "right"
    FROM (SELECT DISTINCT cluster FROM members) c LEFT JOIN (
      SELECT cluster, arg_max(x, (gap, -x)) AS x, arg_max(p, (gap, -x)) AS p FROM gaps WHERE gap > {RING_EPS!r}e0 OR size = 1 GROUP BY cluster) w
    ON w.cluster = c.cluster""", **RING_CTES, gaps=GAPS))
def _(f):
    found = C.ring_bounds(ring(f), RING_EPS, RING, BUFFER)
    return found.select(*[F.round(c, 6).alias(c) for c in ("cluster", "left", "right")])


@query("W15_density_steps")
def _(f):
    return C.density_steps(C.ring_values(times(f), RING), RING_EPS, RING, BUFFER)


@query("F13_ring_functions", sql(f"""
    SELECT event_id, round({_ring_sql('value - 50')}, 6) AS wrapped,
      CASE WHEN abs(value - 10) < 1e-10 THEN 0 WHEN value < 10 THEN -1 ELSE 1 END AS compared,
      CASE WHEN {_ring_sql('value')} >= 86390e0 OR {_ring_sql('value')} < 20e0 THEN TRUE ELSE FALSE END AS inside,
      round(CASE WHEN 5 >= value THEN 5 - value ELSE {RING!r}e0 - value + 5 END, 6) AS apart FROM events"""))
def _(f):
    value = F.col("value")
    return f.table("events").select(
        "event_id", F.round(S.ring_modulo(value - 50, RING), 6).alias("wrapped"),
        S.tolerant_compare(value, F.lit(10.0)).alias("compared"),
        S.ring_between(F.lit(86390.0), F.lit(20.0), value, RING).alias("inside"),
        F.round(S.ring_distance(value, F.lit(5.0), RING), 6).alias("apart"))


# -- geometry ------------------------------------------------------------------------

STEPS = """SELECT suid, utc, lon, lat, lag(lon) OVER w AS lon_before, lag(lat) OVER w AS lat_before FROM samples
  WINDOW w AS (PARTITION BY suid ORDER BY utc)"""


def steps(f: Fixtures):
    from roadpulse.plans.ordered import day_chunk, with_previous

    return with_previous(f.samples(), ["suid"], day_chunk(), ["utc"], ["lon", "lat"]).filter(F.col("pre_lon").isNotNull())


@query("F1_haversine", sql(f"""
    SELECT suid, utc, round({sql_haversine('lon_before', 'lat_before', 'lon', 'lat')}, 4) AS metres FROM steps WHERE lon_before IS NOT NULL""",
    "samples", steps=STEPS))
def _(f):
    metres = geo.haversine(*[F.col(c) for c in ("pre_lon", "pre_lat", "lon", "lat")])
    return steps(f).select("suid", "utc", F.round(metres, 4).alias("metres"))


@query("X4_planar_distance", sql(f"""
    SELECT suid, utc, round({sql_planar('lon_before', 'lat_before', 'lon', 'lat')}, 4) AS metres FROM steps WHERE lon_before IS NOT NULL""",
    "samples", steps=STEPS))
def _(f):
    metres = geo.distance(*[F.col(c) for c in ("pre_lon", "pre_lat", "lon", "lat")], metric="planar")
    return steps(f).select("suid", "utc", F.round(metres, 4).alias("metres"))


@query("F1_geodesic")
def _(f):
    metres = geo.distance(*[F.col(c) for c in ("pre_lon", "pre_lat", "lon", "lat")], metric="wgs84")
    return steps(f).select("suid", "utc", F.round(metres, 3).alias("metres"))


@query("F2_closest_fraction", sql("SELECT event_id, base_gid, round(fraction, 6) AS fraction FROM closest WHERE dist < 60",
                                  "samples", "base_roads", **LOCAL))
def _(f):
    found = SP.base_radius(f.samples(), SP.road_segments(f.base_roads()), 60.0, ["event_id"])
    return found.select("event_id", "base_gid", F.round("fraction", 6).alias("fraction"))


@query("F3_interpolate", sql("""
    SELECT base_gid, round(CASE WHEN goal <= len1 THEN lon0 + (lon1 - lon0) * (goal / len1) ELSE lon1 + (lon2 - lon1) * ((goal - len1) / (length_m - len1)) END, 7) AS lon,
      round(CASE WHEN goal <= len1 THEN lat0 + (lat1 - lat0) * (goal / len1) ELSE lat1 + (lat2 - lat1) * ((goal - len1) / (length_m - len1)) END, 7) AS lat
    FROM (SELECT *, length_m * 0.3e0 AS goal FROM base_roads)""", "base_roads"))
def _(f):
    spot = geo.along_polyline(F.col("points"), F.lit(0.3))
    return f.base_roads().select("base_gid", F.round(spot.lon, 7).alias("lon"), F.round(spot.lat, 7).alias("lat"))


@query("F4_haversine_length", sql(f"""
    SELECT base_gid, round({sql_haversine('lon0', 'lat0', 'lon1', 'lat1')} + {sql_haversine('lon1', 'lat1', 'lon2', 'lat2')}, 4) AS metres FROM base_roads""",
    "base_roads"))
def _(f):
    return f.base_roads().select("base_gid", F.round(geo.polyline_length(F.col("points"), "haversine"), 4).alias("metres"))


@query("F5_envelope", sql(f"""
    SELECT event_id, round(lon - d / cos(radians(lat)), 7) AS min_lon, round(lat - d, 7) AS min_lat,
      round(lon + d / cos(radians(lat)), 7) AS max_lon, round(lat + d, 7) AS max_lat
    FROM (SELECT *, degrees(100e0 / {geo.MEAN_RADIUS!r}e0) AS d FROM samples)""", "samples"))
def _(f):
    box = geo.envelope(F.col("lon"), F.col("lat"), F.lit(100.0))
    return f.samples().select("event_id", *[F.round(box[c], 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("F6_crossings", sql("""
    SELECT a, b, round(ax1 + t * (ax2 - ax1), 7) AS lon, round(ay1 + t * (ay2 - ay1), 7) AS lat FROM (
      SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / d AS t, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / d AS u FROM (
        SELECT p.base_gid AS a, q.base_gid AS b, p.x1 AS ax1, p.y1 AS ay1, p.x2 AS ax2, p.y2 AS ay2, q.x1 AS bx1, q.y1 AS by1, q.x2 AS bx2, q.y2 AS by2,
          (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) AS d
        FROM stretched p JOIN stretched q ON p.base_gid < q.base_gid AND abs(p.x1 - q.x1) < 0.01e0 AND abs(p.y1 - q.y1) < 0.01e0) WHERE abs(d) > 1e-18)
    WHERE t > 1e-9 AND t < 1 - 1e-9 AND u > 1e-9 AND u < 1 - 1e-9""", "base_roads", segs=SEGS,
    stretched="""SELECT base_gid, lon0 AS x1, lat0 AS y1, lon1 AS x2, lat1 AS y2 FROM base_roads UNION ALL
      SELECT base_gid, lon1, lat1, lon2 + (lon2 - lon1) * 0.37e0, lat2 + (lat2 - lat1) * 0.37e0 FROM base_roads"""))
def _(f):
    """Roads made longer at their end, so that they cross the next ones."""
    a, b, c = (F.element_at("points", i) for i in (1, 2, 3))
    end = F.struct((c.lon + (c.lon - b.lon) * 0.37).alias("lon"), (c.lat + (c.lat - b.lat) * 0.37).alias("lat"))
    longer = f.base_roads().withColumn("points", F.array(a, b, end))
    return SP.crossings(longer).select(
        F.col("base_gid").alias("a"), F.col("other_gid").alias("b"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))
