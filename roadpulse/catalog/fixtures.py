"""Road network and traces derived from the given tables by arithmetic.

Each table exists twice: as a Spark DataFrame and as the SQL text of a common
table expression, so that a query and its check start from equal inputs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.operators import matching
from roadpulse.operators import pairs as pairing
from roadpulse.operators import prepare
from roadpulse.operators import roads as road_ops
from roadpulse.params import ROAD_CLASS_MAXSPEED, ROAD_CLASS_PRIORITY, MatchParams
from roadpulse.plans.lineage import delete, scratch_path, write
from roadpulse.sources import roads as road_source

EPOCH = 1704067200
DAY_END = EPOCH + 86400
LON0, LAT0, STEP = 116.3, 39.9, 0.002
DATE_TEXT = "_2024_01_01"

CLASS_IDS = [c for c, _ in ROAD_CLASS_PRIORITY]


_stored: dict[tuple[str, str, str], str] = {}


def stored(build):
    """Keeps a derived table as Parquet for the life of the application.

    The stages of the pipeline hand tables to each other, so a stage is
    computed once and read with column pruning by the queries that need it.
    """

    @functools.wraps(build)
    def read(self: Fixtures) -> DataFrame:
        own = type(self).__name__ if build.__name__ in self.OWN else ""
        key = (self.spark.sparkContext.applicationId, self.dir, own + build.__name__)
        if key not in _stored:
            path = scratch_path(self.spark, build.__name__)
            write(build(self), path)
            tasks = self.spark.sparkContext.defaultParallelism
            # Small tables end in few files, and would be read back in as few tasks. Large ones are not dealt once more.
            if build.__name__ not in self.DEALT and len(self.spark.read.parquet(path).inputFiles()) < tasks:
                few, path = path, scratch_path(self.spark, build.__name__)
                write(self.spark.read.parquet(few).repartition(tasks), path)
                delete(self.spark, few)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])

    return read


class Fixtures:
    #: Stored tables that a subclass builds in its own way.
    OWN: frozenset[str] = frozenset()
    #: Stored tables that the matcher has dealt out already; another shuffle would copy all routes and paths once more.
    DEALT: frozenset[str] = frozenset({"routed", "traces", "thin_traces_matched"})

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @functools.cached_property
    def dims(self) -> tuple[int, int, int]:
        """Grid side, roads per row, and half the number of roads."""
        n = self.table("part").count()
        g = int((n / 2) ** 0.5)
        return g, g - 1, g * (g - 1)

    def events(self) -> DataFrame:
        """Events with ``epoch``, exact microseconds as a double."""
        micros = F.expr(
            "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
        )
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value", (micros / 1e6).alias("epoch")
        )

    def road_class(self) -> DataFrame:
        return road_source.default_road_classes(self.spark)

    @stored
    def ways(self) -> DataFrame:
        g, line, half = self.dims
        k = F.col("p_partkey")
        flat = k < half
        # Roads of rows, then of columns; what is left of the parts crosses grid squares from the first one on.
        slant = k >= 2 * half
        k2 = k - half
        k3 = k - 2 * half
        row = F.when(flat, F.floor(k / line)).when(slant, F.floor(k3 / line)).otherwise(k2 - F.floor(k2 / line) * line)
        column = F.when(flat, k - F.floor(k / line) * line).when(slant, k3 - F.floor(k3 / line) * line).otherwise(F.floor(k2 / line))
        shaped = self.table("part").select(
            k.alias("gid"), "p_size", flat.alias("flat"), slant.alias("slant"), row.cast("long").alias("r"), column.cast("long").alias("c"))
        shift = F.lit(0.0001) * (F.pmod("p_size", F.lit(3)) - 1)
        lon = F.lit(LON0) + F.lit(STEP) * F.col("c")
        lat = F.lit(LAT0) + F.lit(STEP) * F.col("r")
        half_step = F.lit(STEP / 2)
        start = F.struct(lon.alias("lon"), lat.alias("lat"))
        middle = F.struct(
            F.when(F.col("flat") | F.col("slant"), lon + half_step).otherwise(lon + shift).alias("lon"),
            F.when(F.col("flat"), lat + shift).otherwise(lat + half_step).alias("lat"),
        )
        lon_end = F.lit(LON0) + F.lit(STEP) * F.when(F.col("flat") | F.col("slant"), F.col("c") + 1).otherwise(F.col("c"))
        lat_end = F.lit(LAT0) + F.lit(STEP) * F.when(F.col("flat"), F.col("r")).otherwise(F.col("r") + 1)
        end = F.struct(lon_end.alias("lon"), lat_end.alias("lat"))
        classes = F.array(*[F.lit(c).cast("short") for c in CLASS_IDS])
        speed = F.when(F.pmod("p_size", F.lit(3)) != 0, 20 + F.pmod("p_size", F.lit(13))).cast("float")
        return shaped.select(
            "gid",
            (F.col("gid") + 1000000).alias("osm_id"),
            F.element_at(classes, (F.pmod("p_size", F.lit(28)) + 1).cast("int")).alias("class_id"),
            (F.col("r") * g + F.col("c")).alias("source"),
            (F.col("r") * g + F.col("c") + F.when(F.col("flat"), 1).when(F.col("slant"), g + 1).otherwise(g)).alias("target"),
            F.when(~F.col("flat") & (F.pmod("p_size", F.lit(5)) == 0), F.lit(-1.0)).otherwise(F.lit(1.0)).alias("reverse_cost"),
            speed.alias("maxspeed_forward"),
            speed.alias("maxspeed_backward"),
            F.array(start, middle, end).alias("points"),
        )

    def base_roads(self) -> DataFrame:
        return road_source.base_roads(self.ways(), self.road_class())

    @stored
    def roads(self) -> DataFrame:
        return road_ops.split_directions(self.base_roads())

    def successors(self) -> DataFrame:
        return road_ops.successors(self.roads())

    def raw_gps(self) -> DataFrame:
        """Day table with status text instead of a flag, one row per event."""
        g, line, _ = self.dims
        utc = F.lit(EPOCH) + F.floor((F.col("epoch") - EPOCH) / 100)
        e = self.events().withColumn("utc", utc.cast("long"))
        wave = ((F.col("utc") - EPOCH) * (5 + F.pmod("user_id", F.lit(10))) / F.lit(170.7)) % F.lit(2.0 * line)
        e = e.withColumn("m", wave).withColumn("x", F.when(F.col("m") <= line, F.col("m")).otherwise(2.0 * line - F.col("m")))
        row = F.pmod("user_id", F.lit(g))
        lon = F.round((F.lit(LON0) + F.lit(STEP) * F.col("x")) * 1e5) + (F.pmod(F.col("event_id") * 37, F.lit(21)) - 10)
        lat = F.round((F.lit(LAT0) + F.lit(STEP) * row) * 1e5) + (F.pmod(F.col("event_id") * 53, F.lit(21)) - 10)
        return e.select(
            "event_id",
            F.lit(DATE_TEXT).alias("date"),
            (F.col("user_id") + 1000).alias("suid"),
            "utc",
            lat.cast("int").alias("lat"),
            lon.cast("int").alias("lon"),
            F.when(F.col("m") <= line, 90).otherwise(270).cast("int").alias("head"),
            F.when(F.col("event_type") != "error", "重车").otherwise("空车").alias("ostdesc"),
            "m", "x", row.alias("r"),
        )

    @stored
    def gps(self) -> DataFrame:
        return self.raw_gps().select(
            "event_id", "date", "suid", "utc", "lat", "lon", "head",
            F.col("ostdesc").contains("重车").alias("passenger"),
        )

    def gps_lines(self) -> DataFrame:
        """Text form, with broken lines mixed in: every 97th loses its last field."""
        g = self.gps()
        full = F.concat_ws(" ", "date", "suid", "utc", "lat", "lon", "head", F.col("passenger").cast("string"))
        short = F.concat_ws(" ", "date", "suid", "utc", "lat", "lon", "head")
        return g.select("event_id", F.when(F.pmod("event_id", F.lit(97)) == 96, short).otherwise(full).alias("value"))

    @stored
    def samples(self) -> DataFrame:
        """GPS in degrees, thinned."""
        return prepare.thin_traces(prepare.decode_coordinates(self.gps()))

    def truth(self) -> DataFrame:
        _, line, _ = self.dims
        cell = F.least(F.floor("x"), F.lit(line - 1)).cast("long")
        base = F.col("r") * line + cell
        forward = F.col("m") <= line
        part = F.col("x") - cell
        return self.raw_gps().select(
            "event_id", "date", "suid", "utc",
            S.directed_id(base, forward).alias("gid"),
            F.when(forward, part).otherwise(1 - part).alias("offset"),
            F.col("ostdesc").contains("重车").alias("passenger"),
        )

    @stored
    def matched(self) -> DataFrame:
        return prepare.thin_traces(self.truth())

    @stored
    def raw_pairs(self) -> DataFrame:
        """Consecutive matched points with the route along the row."""
        cut = pairing.usable_pairs(pairing.pair_up(self.matched(), ["gid", "offset", "passenger"]))
        moved = cut.filter(F.pmod("pre_gid", F.lit(2)) == F.pmod("gid", F.lit(2)))
        a, b = S.base_id(F.col("pre_gid")), S.base_id(F.col("gid"))
        forward = S.is_forward(F.col("gid"))
        ahead = (
            F.when(forward, b > a).otherwise(b < a) | ((a == b) & (F.col("offset") >= F.col("pre_offset")))
        )
        step = F.sequence(F.col("pre_gid"), F.col("gid"), F.when(forward, F.lit(2)).otherwise(F.lit(-2)).cast("long"))
        return moved.filter(ahead).select(
            "date", "suid", "pre_utc", "pre_gid", "pre_offset", "utc", "gid", "offset",
            F.when(a == b, F.array("gid")).otherwise(step).alias("route"),
            F.col("passenger"),
        )

    @stored
    def pairs(self) -> DataFrame:
        return pairing.flag_pairs(self.raw_pairs(), F.floor(F.col("utc") / 20))

    @stored
    def history(self) -> DataFrame:
        roads = self.table("part").count()
        speeds = (
            self.table("lineitem")
            .select(
                (F.pmod("l_partkey", F.lit(roads)) * 2).alias("gid"),
                (1 + F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(288))).cast("int").alias("seq"),
                "l_quantity",
            )
            .groupBy("gid", "seq")
            .agg((1.5 + 0.6 * F.avg("l_quantity")).alias("average_speed"))
        )
        attributes = self.roads().select(F.col("id").alias("gid"), "base_gid", F.col("length_m").alias("length"), "class_id")
        return speeds.join(attributes, "gid").withColumn("time", F.col("length") / F.col("average_speed"))

    @stored
    def road_state(self) -> DataFrame:
        history = self.history()
        return road_ops.initial_state(self.roads(), history, road_source.class_history(history))

    @stored
    def vectors(self) -> DataFrame:
        """Candidates of every sample."""
        return matching.vectors(matching.candidates(self.samples(), self.base_roads(), self.roads(), self.successors()))

    @stored
    def routed(self) -> DataFrame:
        """Candidates with the routes from the previous sample."""
        return matching.with_routes(matching.with_predecessor(self.vectors()), self.roads(), self.successors())

    @stored
    def traces(self) -> DataFrame:
        return matching.decode_traces(self.routed())

    @stored
    def thin_traces_matched(self) -> DataFrame:
        """Matching of samples at least 60 seconds apart."""
        p = MatchParams(min_interval=60)
        vecs = matching.thin_vectors(self.vectors(), p)
        return matching.decode_traces(matching.with_routes(matching.with_predecessor(vecs), self.roads(), self.successors(), p), p)

    def arrivals(self) -> DataFrame:
        """Road observations of eight roads in arrival order over three days, every 7th one late."""
        e = self.events()
        utc = F.lit(EPOCH) + F.floor((F.col("epoch") - EPOCH) / 10).cast("long")
        kind = F.when(F.pmod("event_id", F.lit(11)) == 0, "jam").when(F.col("event_type") == "view", "route").otherwise("speed")
        return e.select(
            F.pmod("user_id", F.lit(8)).alias("road"), "event_id",
            F.when(F.pmod("event_id", F.lit(7)) == 0, utc - 400).otherwise(utc).alias("utc"),
            kind.alias("kind"),
            F.when(kind == "route", F.col("value") + 5).otherwise(F.col("value") / 9.7).alias("value"),
        )


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def sql_kx(lat: str) -> str:
    return (
        f"({geo.AXIS!r}e0 * pi() / 180e0 * cos(radians({lat})) / sqrt(1e0 - {geo.ECC2!r} * sin(radians({lat})) * sin(radians({lat}))))"
    )


def sql_ky(lat: str) -> str:
    w = f"(1e0 - {geo.ECC2!r} * sin(radians({lat})) * sin(radians({lat})))"
    return f"({geo.AXIS!r}e0 * pi() / 180e0 * (1e0 - {geo.ECC2!r}) / ({w} * sqrt({w})))"


def sql_planar(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    mid = f"(({lat1} + {lat2}) / 2e0)"
    return (
        f"sqrt(pow(({lon2} - {lon1}) * {sql_kx(mid)}, 2) + pow(({lat2} - {lat1}) * {sql_ky(mid)}, 2))"
    )


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2e0 * {geo.MEAN_RADIUS!r}e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2))))"
    )


def sql_seq(utc: str, start: str, end: str) -> str:
    raw = f"(288 - CAST(trunc(CAST({end} - ({utc}) AS DOUBLE) / 300) AS BIGINT))"
    return (
        f"least(288, CASE WHEN {raw} = 0 AND ({utc}) = {start} THEN 1 "
        f"WHEN {raw} <= 0 THEN ((({raw} - 1) % 288) + 288) % 288 + 1 ELSE {raw} END)"
    )


def sql_day_seq(utc: str) -> str:
    return sql_seq(utc, f"(({utc}) - ({utc}) % 86400)", f"(({utc}) - ({utc}) % 86400 + 86400)")


_class_values = ", ".join(f"({c}, {p!r}e0, {ROAD_CLASS_MAXSPEED})" for c, p in ROAD_CLASS_PRIORITY)
_class_list = "[" + ", ".join(str(c) for c in CLASS_IDS) + "]"

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "dims": ((), """
        SELECT g, g - 1 AS l, g * (g - 1) AS h, n FROM (
          SELECT CAST(floor(sqrt(count(*) / 2e0)) AS BIGINT) AS g, count(*) AS n FROM part)"""),
    "road_class": ((), f"SELECT * FROM (VALUES {_class_values}) v(class_id, priority, maxspeed)"),
    "ways": (("dims",), f"""
        SELECT gid, gid + 1000000 AS osm_id, {_class_list}[p_size % 28 + 1] AS class_id,
          r * g + c AS source, r * g + c + (CASE WHEN flat THEN 1 WHEN slant THEN g + 1 ELSE g END) AS target,
          CASE WHEN NOT flat AND p_size % 5 = 0 THEN -1e0 ELSE 1e0 END AS reverse_cost,
          CASE WHEN p_size % 3 <> 0 THEN CAST(20 + p_size % 13 AS DOUBLE) END AS maxspeed_forward,
          CASE WHEN p_size % 3 <> 0 THEN CAST(20 + p_size % 13 AS DOUBLE) END AS maxspeed_backward,
          116.3e0 + 0.002e0 * c AS lon0, 39.9e0 + 0.002e0 * r AS lat0,
          CASE WHEN flat OR slant THEN 116.3e0 + 0.002e0 * c + 0.001e0 ELSE 116.3e0 + 0.002e0 * c + 0.0001e0 * (p_size % 3 - 1) END AS lon1,
          CASE WHEN flat THEN 39.9e0 + 0.002e0 * r + 0.0001e0 * (p_size % 3 - 1) ELSE 39.9e0 + 0.002e0 * r + 0.001e0 END AS lat1,
          116.3e0 + 0.002e0 * (CASE WHEN flat OR slant THEN c + 1 ELSE c END) AS lon2,
          39.9e0 + 0.002e0 * (CASE WHEN flat THEN r ELSE r + 1 END) AS lat2
        FROM (SELECT p_partkey AS gid, p_size, p_partkey < h AS flat, p_partkey >= 2 * h AS slant, g,
                CASE WHEN p_partkey < h THEN p_partkey // l WHEN p_partkey >= 2 * h THEN (p_partkey - 2 * h) // l ELSE (p_partkey - h) % l END AS r,
                CASE WHEN p_partkey < h THEN p_partkey % l WHEN p_partkey >= 2 * h THEN (p_partkey - 2 * h) % l ELSE (p_partkey - h) // l END AS c
              FROM part, dims)"""),
    "base_roads": (("ways", "road_class"), f"""
        SELECT w.gid AS base_gid, osm_id, w.class_id, source, target, reverse_cost < 0 AS oneway,
          c.priority, coalesce(maxspeed_forward, c.maxspeed) AS speed_forward,
          coalesce(maxspeed_backward, c.maxspeed) AS speed_backward,
          {sql_planar('lon0', 'lat0', 'lon1', 'lat1')} AS len1,
          {sql_planar('lon0', 'lat0', 'lon1', 'lat1')} + {sql_planar('lon1', 'lat1', 'lon2', 'lat2')} AS length_m,
          lon0, lat0, lon1, lat1, lon2, lat2
        FROM ways w JOIN road_class c ON w.class_id = c.class_id"""),
    "roads": (("base_roads",), """
        SELECT base_gid * 2 AS id, base_gid, TRUE AS forward, source, target, class_id, priority,
          speed_forward AS maxspeed, length_m, lon0, lat0, lon1, lat1, lon2, lat2 FROM base_roads
        UNION ALL
        SELECT base_gid * 2 + 1, base_gid, FALSE, target, source, class_id, priority,
          speed_backward, length_m, lon2, lat2, lon1, lat1, lon0, lat0 FROM base_roads WHERE NOT oneway"""),
    "successors": (("roads",), "SELECT a.id, b.id AS succ_id FROM roads a JOIN roads b ON a.target = b.source"),
    "raw_gps": (("dims",), f"""
        SELECT event_id, '{DATE_TEXT}' AS date, user_id + 1000 AS suid, utc,
          CAST(round((39.9e0 + 0.002e0 * (user_id % g)) * 1e5) + (event_id * 53 % 21 - 10) AS BIGINT) AS lat,
          CAST(round((116.3e0 + 0.002e0 * x) * 1e5) + (event_id * 37 % 21 - 10) AS BIGINT) AS lon,
          CASE WHEN m <= l THEN 90 ELSE 270 END AS head,
          CASE WHEN event_type <> 'error' THEN '重车' ELSE '空车' END AS ostdesc, m, x, user_id % g AS r
        FROM (SELECT *, CASE WHEN m <= l THEN m ELSE 2e0 * l - m END AS x FROM (
          SELECT *, fmod((utc - {EPOCH}) * (5 + user_id % 10) / 170.7e0, 2e0 * l) AS m FROM (
            SELECT event_id, user_id, event_type,
              {EPOCH} + CAST(floor((epoch_us(ts) / 1e6 - {EPOCH}) / 100) AS BIGINT) AS utc, g, l
            FROM events, dims)))"""),
    "gps": (("raw_gps",), "SELECT event_id, date, suid, utc, lat, lon, head, contains(ostdesc, '重车') AS passenger FROM raw_gps"),
    "gps_lines": (("gps",), """
        SELECT event_id, CASE WHEN event_id % 97 = 96 THEN concat_ws(' ', date, suid, utc, lat, lon, head)
          ELSE concat_ws(' ', date, suid, utc, lat, lon, head, passenger) END AS value FROM gps"""),
    "truth": (("raw_gps", "dims"), """
        SELECT event_id, date, suid, utc, 2 * (r * l + c) + (CASE WHEN m <= l THEN 0 ELSE 1 END) AS gid,
          CASE WHEN m <= l THEN x - c ELSE 1 - (x - c) END AS "offset", contains(ostdesc, '重车') AS passenger
        FROM (SELECT raw_gps.*, l, CAST(least(floor(x), l - 1) AS BIGINT) AS c FROM raw_gps, dims)"""),
    "numbered": (("raw_gps",), """
        SELECT event_id, suid, utc, row_number() OVER (PARTITION BY suid ORDER BY utc, event_id) AS rn FROM raw_gps"""),
    "thinned": (("numbered",), """
        SELECT event_id, suid, rn, utc, utc AS last, TRUE AS kept FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.event_id, n.suid, n.rn, n.utc, CASE WHEN n.utc >= t.last + 10 THEN n.utc ELSE t.last END,
          n.utc >= t.last + 10
        FROM thinned t JOIN numbered n ON n.suid = t.suid AND n.rn = t.rn + 1"""),
    "kept": (("thinned",), "SELECT event_id FROM thinned WHERE kept"),
    "samples": (("gps", "kept"), """
        SELECT event_id, date, suid, utc, lat / 1e5 AS lat, lon / 1e5 AS lon, head, passenger
        FROM gps WHERE event_id IN (SELECT event_id FROM kept)"""),
    "matched": (("truth", "kept"), "SELECT * FROM truth WHERE event_id IN (SELECT event_id FROM kept)"),
    "paired": (("matched",), """
        SELECT date, suid, utc, gid, "offset", passenger,
          lag(utc) OVER w AS pre_utc, lag(gid) OVER w AS pre_gid, lag("offset") OVER w AS pre_offset,
          lag(passenger) OVER w AS pre_passenger
        FROM matched WINDOW w AS (PARTITION BY suid ORDER BY utc)"""),
    "raw_pairs": (("paired",), """
        SELECT date, suid, pre_utc, pre_gid, pre_offset, utc, gid, "offset", passenger,
          CASE WHEN pre_gid // 2 = gid // 2 THEN [gid] WHEN gid % 2 = 0 THEN range(pre_gid, gid + 1, 2)
            ELSE range(pre_gid, gid - 1, -2) END AS route
        FROM paired
        WHERE pre_utc IS NOT NULL AND utc - pre_utc <= 600 AND passenger = pre_passenger AND gid % 2 = pre_gid % 2
          AND (CASE WHEN gid % 2 = 0 THEN gid // 2 > pre_gid // 2 ELSE gid // 2 < pre_gid // 2 END
            OR (gid // 2 = pre_gid // 2 AND "offset" >= pre_offset))"""),
    "road_use": (("raw_pairs",), """
        SELECT utc // 20 AS batch, road, count(*) AS n FROM (SELECT utc, unnest(route) AS road FROM raw_pairs) GROUP BY ALL"""),
    "pairs": (("raw_pairs", "road_use"), """
        SELECT p.*, f.flag FROM raw_pairs p JOIN (
          SELECT e.suid, e.utc, CASE WHEN max(u.n) = 1 THEN 1 ELSE 0 END AS flag
          FROM (SELECT suid, utc, unnest(route) AS road FROM raw_pairs) e
          JOIN road_use u ON u.batch = e.utc // 20 AND u.road = e.road GROUP BY e.suid, e.utc
        ) f ON f.suid = p.suid AND f.utc = p.utc"""),
    "history": (("dims", "roads"), """
        SELECT h.gid, h.seq, h.average_speed, r.base_gid, r.length_m AS length, r.class_id, r.length_m / h.average_speed AS time
        FROM (SELECT 2 * (l_partkey % n) AS gid, 1 + (l_orderkey * 7 + l_linenumber) % 288 AS seq,
                1.5e0 + 0.6e0 * avg(l_quantity) AS average_speed
              FROM lineitem, dims GROUP BY 1, 2) h JOIN roads r ON r.id = h.gid"""),
    "class_history": (("history",), "SELECT class_id, seq, avg(average_speed) AS average_speed FROM history GROUP BY class_id, seq"),
    "road_state": (("roads", "history", "class_history"), """
        SELECT gid, base_gid, class_id, length, max_speed, avg_speed, length / avg_speed AS time FROM (
          SELECT r.id AS gid, r.base_gid, r.class_id, r.length_m AS length, least(r.maxspeed, 33.33e0) AS max_speed,
            greatest(1.5e0, CASE WHEN h.average_speed > 0 THEN h.average_speed WHEN c.average_speed > 0 THEN c.average_speed ELSE 10e0 END) AS avg_speed
          FROM roads r LEFT JOIN history h ON h.gid = r.id AND h.seq = 288
          LEFT JOIN class_history c ON c.class_id = r.class_id AND c.seq = 288)"""),
    "arrivals": ((), f"""
        SELECT road, event_id, utc, kind, CASE WHEN kind = 'route' THEN value + 5 ELSE value / 9.7e0 END AS value FROM (
          SELECT user_id % 8 AS road, event_id, value,
            {EPOCH} + CAST(floor((epoch_us(ts) / 1e6 - {EPOCH}) / 10) AS BIGINT) - (CASE WHEN event_id % 7 = 0 THEN 400 ELSE 0 END) AS utc,
            CASE WHEN event_id % 11 = 0 THEN 'jam' WHEN event_type = 'view' THEN 'route' ELSE 'speed' END AS kind
          FROM events)"""),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """A statement whose common table expressions are ``names`` and what they need.

    ``extra`` holds further expressions, added in the order given.
    """
    done: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in done]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
