"""Queries on sources, cleaning, thinning, density and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import DAY_END, EPOCH, Fixtures, sql, sql_seq
from roadpulse.catalog.registry import query
from roadpulse.functions import scalar as S
from roadpulse.operators import density as D
from roadpulse.operators import pairs as pairing
from roadpulse.operators import prepare as P
from roadpulse.params import GridParams
from roadpulse.sources import gps as G

GRID = GridParams()
SEQ = sql_seq("utc", str(EPOCH), str(DAY_END))
CELL = f"""
  SELECT *, CASE WHEN rx = 100 THEN 99 ELSE rx END AS x, CASE WHEN ry = 100 THEN 99 ELSE ry END AS y FROM (
    SELECT *, CAST(trunc((lon - {GRID.min_lon!r}e0) / {GRID.lon_step!r}e0) AS INTEGER) AS rx,
      CAST(trunc((lat - {GRID.min_lat!r}e0) / {GRID.lat_step!r}e0) AS INTEGER) AS ry, {SEQ} AS seq FROM samples)"""


def with_seq(df):
    return df.withColumn("seq", S.slice_number(F.col("utc"), F.lit(EPOCH), F.lit(DAY_END)))


def cells(f: Fixtures):
    return P.with_cell(with_seq(f.samples()))


@query("S1_parse_gps_lines", sql(
    "SELECT event_id, date, suid, utc, lat, lon, head, passenger FROM gps WHERE event_id % 97 <> 96", "gps"))
def _(f):
    return G.complete(G.parse_gps(f.gps_lines(), ["event_id"]))


@query("S1_bad_lines", sql("SELECT event_id, suid, utc FROM gps WHERE event_id % 97 = 96", "gps"))
def _(f):
    return G.quarantined(G.parse_gps(f.gps_lines(), ["event_id"])).select("event_id", "suid", "utc")


@query("S3_day_table_scan", sql(
    "SELECT suid, utc, lat, lon, head, contains(ostdesc, '重车') AS passenger FROM raw_gps ORDER BY utc, event_id", "raw_gps"))
def _(f):
    raw = f.raw_gps()
    return raw.orderBy("utc", "event_id").select(
        "suid", "utc", "lat", "lon", "head", P.passenger_flag(F.col("ostdesc")).alias("passenger"))


@query("S4_day_bounds", sql("SELECT min(utc) AS start_utc, max(utc) AS end_utc FROM gps", "gps"))
def _(f):
    return G.day_bounds(f.gps())


@query("S5_parse_pair_lines", sql("""
    SELECT date AS pre_date, suid AS pre_suid, pre_utc, pre_gid, round(pre_offset, 6) AS pre_offset, NULL AS pre_route,
      date, suid, utc, gid, round("offset", 6) AS "offset", array_to_string(route, '-') AS route, flag FROM pairs""", "pairs"))
def _(f):
    parsed = G.parse_pairs(G.format_pairs(_pair_rows(f)))
    return parsed.withColumn("pre_route", F.array_join("pre_route", "-")).withColumn(
        "route", F.array_join("route", "-")).withColumn("pre_offset", F.round("pre_offset", 6)).withColumn(
        "offset", F.round("offset", 6))


def _pair_rows(f):
    return f.pairs().select(
        "date", "suid", "utc", "gid", "offset", "route", "flag",
        F.col("date").alias("pre_date"), F.col("suid").alias("pre_suid"), "pre_utc", "pre_gid", "pre_offset",
        F.lit(None).cast("array<bigint>").alias("pre_route"))


@query("K5_format_pair_lines", sql("""
    SELECT suid, utc, concat_ws(' ', date, suid, pre_utc, pre_gid) AS before, round(pre_offset, 6) AS before_offset, 'null' AS before_route,
      concat_ws(' ', date, suid, utc, gid) AS now, round("offset", 6) AS now_offset, array_to_string(route, ',') || ',' AS now_route, flag FROM pairs""", "pairs"))
def _(f):
    """Full lines, cut again at their separators; digits of an offset differ between writers, so it is compared as a number."""
    lines = G.format_pairs(_pair_rows(f))
    halves = F.split("value", ";")
    before, now = (F.split(F.get(halves, F.lit(i)), " ") for i in (0, 1))
    number = lambda half, i: F.get(half, F.lit(i))
    return lines.select(
        number(now, 1).cast("bigint").alias("suid"), number(now, 2).cast("bigint").alias("utc"),
        F.array_join(F.slice(before, 1, 4), " ").alias("before"), F.round(number(before, 4).cast("double"), 6).alias("before_offset"),
        number(before, 5).alias("before_route"),
        F.array_join(F.slice(now, 1, 4), " ").alias("now"), F.round(number(now, 4).cast("double"), 6).alias("now_offset"),
        number(now, 5).alias("now_route"), F.get(halves, F.lit(2)).cast("int").alias("flag"))


@query("P1_decode_coordinates", sql("SELECT event_id, lat / 1e5 AS lat, lon / 1e5 AS lon FROM gps", "gps"))
def _(f):
    return P.decode_coordinates(f.gps()).select("event_id", "lat", "lon")


@query("P2_local_time", sql(
    "SELECT event_id, utc, strftime(make_timestamp((utc + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS local_time FROM gps", "gps"))
def _(f):
    return f.gps().select("event_id", "utc", P.local_time_text(F.col("utc")).alias("local_time"))


@query("P3_passenger_flag", sql("SELECT contains(ostdesc, '重车') AS passenger, count(*) AS n FROM raw_gps GROUP BY 1", "raw_gps"))
def _(f):
    return f.raw_gps().groupBy(P.passenger_flag(F.col("ostdesc")).alias("passenger")).agg(F.count(F.lit(1)).alias("n"))


@query("P4_key_by_vehicle", sql(
    "SELECT suid, count(*) AS n, min(utc) AS first_utc, max(utc) AS last_utc FROM gps GROUP BY suid", "gps"))
def _(f):
    return f.gps().groupBy("suid").agg(
        F.count(F.lit(1)).alias("n"), F.min("utc").alias("first_utc"), F.max("utc").alias("last_utc"))


@query("P5_grid_cells", sql("SELECT event_id, x, y FROM cell", "samples", cell=CELL))
def _(f):
    return cells(f).select("event_id", "x", "y")


@query("P6_inside_grid", sql(
    "SELECT event_id, x, y FROM cell WHERE x BETWEEN 0 AND 99 AND y BETWEEN 0 AND 99", "samples",
    cell=CELL.replace(f"{GRID.min_lon!r}e0", "116.305e0")))
def _(f):
    g = GridParams(min_lon=116.305, max_lon=116.305 + (GRID.max_lon - GRID.min_lon))
    shifted = P.with_cell(with_seq(f.samples()), GridParams(
        min_lon=116.305, max_lon=116.305 + GRID.lon_step * 100))
    return P.inside_grid(shifted, g).select("event_id", "x", "y")


@query("P7_until", sql(f"SELECT event_id, suid, utc FROM gps WHERE utc <= {EPOCH + 9000}", "gps"))
def _(f):
    return P.until(f.gps(), EPOCH + 9000).select("event_id", "suid", "utc")


@query("P8_sample_vehicles", sql("SELECT event_id, suid, utc FROM gps WHERE suid % 3 = 0", "gps"))
def _(f):
    return P.sample_vehicles(f.gps()).select("event_id", "suid", "utc")


@query("P9_drop_null_records", sql("SELECT count(*) AS n FROM gps WHERE event_id % 97 <> 96", "gps"))
def _(f):
    return G.parse_gps(f.gps_lines()).filter(F.col("passenger").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("P10_thin_traces", sql("SELECT event_id, suid, utc FROM samples", "samples"))
def _(f):
    return P.thin_traces(P.decode_coordinates(f.gps())).select("event_id", "suid", "utc")


@query("P11_shed_load")
def _(f):
    return D.shed_load(cells(f), batch_seconds=60, g=GridParams(capacity=3))


@query("A16_dropped_counts")
def _(f):
    return D.dropped_counts(D.shed_load(cells(f), batch_seconds=60, g=GridParams(capacity=3)))


PAIRED = "SELECT suid, utc, gid, pre_utc, pre_gid FROM paired WHERE pre_utc IS NOT NULL"


def paired(f):
    return pairing.pair_up(f.matched(), ["gid", "offset", "passenger"])


@query("J12_pair_up", sql(PAIRED, "paired"))
def _(f):
    return paired(f).select("suid", "utc", "gid", "pre_utc", "pre_gid")


@query("P12_cut_long_gaps", sql(PAIRED + " AND utc - pre_utc <= 600", "paired"))
def _(f):
    return pairing.cut_long_gaps(paired(f)).select("suid", "utc", "gid", "pre_utc", "pre_gid")


@query("P13_cut_status_changes", sql(PAIRED + " AND passenger = pre_passenger", "paired"))
def _(f):
    return pairing.cut_status_changes(paired(f)).select("suid", "utc", "gid", "pre_utc", "pre_gid")


@query("P14_split_by_flag", sql(
    "SELECT 'parallel' AS part, suid, utc FROM pairs WHERE flag = 1 UNION ALL SELECT 'serial', suid, utc FROM pairs WHERE flag = 0", "pairs"))
def _(f):
    one, zero = G.split_by_flag(f.pairs())
    return one.select(F.lit("parallel").alias("part"), "suid", "utc").unionByName(
        zero.select(F.lit("serial").alias("part"), "suid", "utc"))


@query("P21_subsample", sql("""
    SELECT s.event_id, s.suid, s.utc FROM samples s JOIN (
      SELECT suid, min(utc) AS lo, max(utc) AS hi FROM samples GROUP BY suid) e ON e.suid = s.suid
    WHERE s.utc = lo OR s.utc = hi OR (s.utc - lo) % 7 = 0""", "samples"))
def _(f):
    return P.subsample(f.samples(), 7, ["suid"]).select("event_id", "suid", "utc")


def costs(f):
    """Latencies in ms: the event value scaled so that some exceed the limit."""
    base = with_seq(f.gps()).join(f.table("events").select("event_id", "value"), "event_id")
    return base.select("event_id", "seq", (F.floor(F.col("value") * 30000) - 60000).cast("bigint").alias("cost"))


COSTS = f"""SELECT g.event_id, {SEQ} AS seq, CAST(floor(e.value * 30000) AS BIGINT) - 60000 AS cost
  FROM gps g JOIN events e ON e.event_id = g.event_id"""


@query("P24_latency_filter", sql("SELECT * FROM costs WHERE cost > 0 AND cost <= 1500000", "gps", costs=COSTS))
def _(f):
    return P.positive_costs(costs(f))


@query("A7_mean_latency", sql("""
    SELECT seq, CAST(floor(avg(CASE WHEN cost > 0 THEN cost END)) AS BIGINT) AS mean_cost FROM costs
    WHERE cost <= 1500000 GROUP BY seq""", "gps", costs=COSTS))
def _(f):
    return D.mean_cost(costs(f).filter(F.col("cost") <= 1500000), ["seq"])


@query("W1_slice_number", sql(f"""
    SELECT event_id, {SEQ} AS seq, {sql_seq('utc', str(EPOCH + 7200), str(EPOCH + 20000))} AS short_day FROM gps""", "gps"))
def _(f):
    short = S.slice_number(F.col("utc"), F.lit(EPOCH + 7200), F.lit(EPOCH + 20000))
    return with_seq(f.gps()).select("event_id", "seq", short.alias("short_day"))


@query("A2_bounds_and_counts", sql("""
    SELECT (SELECT min(utc) FROM gps) AS start_utc, (SELECT max(utc) FROM gps) AS end_utc,
      (SELECT max(id) FROM roads) AS max_road, (SELECT count(DISTINCT base_gid) FROM roads) AS base_roads,
      (SELECT count(*) FROM roads) AS directed_roads""", "gps", "roads"))
def _(f):
    roads = f.roads().agg(
        F.max("id").alias("max_road"), F.countDistinct("base_gid").alias("base_roads"), F.count(F.lit(1)).alias("directed_roads"))
    # Both sides are one row, so they meet on a constant key.
    one = F.lit(1).alias("k")
    return G.day_bounds(f.gps()).select("*", one).join(roads.select("*", one), "k").drop("k")


@query("A3_group_and_sort", sql("""
    SELECT suid, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY utc, event_id) AS events
    FROM samples GROUP BY suid, utc // 86400""", "samples"))
def _(f):
    ordered = f.samples().groupBy("suid", F.floor(F.col("utc") / 86400).alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("utc", "event_id"))).alias("rows"))
    return ordered.select(
        "suid", F.size("rows").cast("bigint").alias("n"),
        F.array_join(F.transform("rows", lambda r: r.event_id.cast("string")), ",").alias("events"))


DENSITY = "SELECT date, seq, x, y, count(*) AS n FROM cell GROUP BY ALL"


@query("A4_density", sql(DENSITY, "samples", cell=CELL))
def _(f):
    return D.density(cells(f))


@query("A5_hot_cells", sql(DENSITY + " HAVING count(*) >= 3", "samples", cell=CELL))
def _(f):
    return D.hot_cells(D.density(cells(f)), 3)


@query("A6_road_use", sql("SELECT batch, road, n FROM road_use", "road_use"))
def _(f):
    return pairing.road_use(f.raw_pairs(), F.floor(F.col("utc") / 20))


@query("A6_pair_flags", sql("SELECT suid, utc, flag FROM pairs", "pairs"))
def _(f):
    return pairing.flag_pairs(f.raw_pairs(), F.floor(F.col("utc") / 20)).select("suid", "utc", "flag")


@query("A19_one_per_batch", sql("""
    SELECT suid, utc // 20 AS batch, arg_min(event_id, (utc, event_id)) AS event_id, min(utc) AS utc FROM gps GROUP BY 1, 2""", "gps"))
def _(f):
    return P.one_per_batch(f.gps(), F.floor(F.col("utc") / 20)).select("suid", "batch", "event_id", "utc")


@query("A20_batch_sizes", sql(
    "SELECT utc // 20 AS batch, count(DISTINCT suid) AS vehicles, count(*) AS points FROM gps GROUP BY 1", "gps"))
def _(f):
    return D.batch_sizes(f.gps(), F.floor(F.col("utc") / 20))


@query("O1_global_order", sql("SELECT event_id, suid, utc FROM gps ORDER BY utc, event_id", "gps"))
def _(f):
    return f.gps().orderBy("utc", "event_id").select("event_id", "suid", "utc")


@query("O2_order_in_batch", sql("""
    SELECT batch, suid, utc, row_number() OVER (PARTITION BY batch ORDER BY utc, suid) AS place
    FROM (SELECT *, utc // 20 AS batch FROM pairs)""", "pairs"))
def _(f):
    # A batch is 20 seconds of a stream; the place of a pair is the number of earlier
    # seconds' pairs plus its place within its second.
    rows = f.pairs().select(F.floor(F.col("utc") / 20).alias("batch"), "suid", "utc")
    seconds = rows.groupBy("batch", "utc").agg(F.count(F.lit(1)).alias("n"))
    before = seconds.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("utc", "n"))).alias("all")).select(
        "batch",
        F.inline(F.transform("all", lambda s: F.struct(
            s.utc.alias("utc"),
            F.aggregate(F.filter("all", lambda o: o.utc < s.utc), F.lit(0).cast("bigint"), lambda acc, o: acc + o.n).alias("before")))))
    inside = F.row_number().over(_window("batch", "utc", "suid"))
    return rows.withColumn("inside", inside).join(before, ["batch", "utc"]).select(
        "batch", "suid", "utc", (F.col("before") + F.col("inside")).alias("place"))


def _window(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys[:-1]).orderBy(keys[-1])


@query("O3_sort_trace", sql("""
    SELECT suid, count(*) AS n, string_agg(CAST(utc AS VARCHAR), ',' ORDER BY utc) AS times FROM samples
    GROUP BY suid, utc // 86400""", "samples"))
def _(f):
    per_day = f.samples().groupBy("suid", F.floor(F.col("utc") / 86400).alias("day")).agg(
        F.array_sort(F.collect_list("utc")).alias("times"))
    return per_day.select("suid", F.size("times").cast("bigint").alias("n"), F.array_join(
        F.transform("times", lambda t: t.cast("string")), ",").alias("times"))


@query("U1_union_streams", sql("""
    SELECT event_id, suid FROM gps WHERE suid % 3 = 0 UNION ALL SELECT event_id, suid FROM gps WHERE suid % 3 = 1""", "gps"))
def _(f):
    g = f.gps().select("event_id", "suid")
    return P.sample_vehicles(g, 3, 0).unionByName(P.sample_vehicles(g, 3, 1))


@query("U2_distinct_points", sql("SELECT DISTINCT lat, lon FROM gps", "gps"))
def _(f):
    return f.gps().select("lat", "lon").dropDuplicates()


@query("F15_text_functions", sql("""
    SELECT event_id, strptime(substr(date, 2), '%Y_%m_%d')::DATE AS day, contains(ostdesc, '车') AS has_mark,
      concat_ws(' ', date, suid, utc) AS joined FROM raw_gps""", "raw_gps"))
def _(f):
    return f.raw_gps().select(
        "event_id", F.to_date("date", "_yyyy_MM_dd").alias("day"), F.col("ostdesc").contains("车").alias("has_mark"),
        F.concat_ws(" ", "date", "suid", "utc").alias("joined"))


@query("J13_attach_samples", sql("""
    SELECT m.suid, m.utc, m.gid, g.head, g.passenger FROM matched m JOIN gps g ON g.event_id = m.event_id""", "matched", "gps"))
def _(f):
    found = f.matched().select("suid", F.col("event_id").alias("sample_id"), "gid")
    samples = f.gps().select("suid", F.col("event_id").alias("sample_id"), "utc", "head", "passenger")
    return pairing.attach_samples(found, samples).select("suid", "utc", "gid", "head", "passenger")
