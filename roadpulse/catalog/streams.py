"""Queries that run as streams over files derived from the given tables."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import Fixtures, sql
from roadpulse.catalog.network import road_state
from roadpulse.catalog.registry import query
from roadpulse.catalog.traffic import ARRIVAL_CHUNK, FULL, MERGED, TURNED, WRITTEN, fold_sql, rounded
from roadpulse.operators import pairs as pairing
from roadpulse.operators import prepare as P
from roadpulse.plans.lineage import scratch_path
from roadpulse.sources import gps as G
from roadpulse.sources import roads as RS
from roadpulse.streaming import pipeline as ST

PARTS = 4
LINE_SCHEMA = "event_id bigint, value string"


def stream_query(name: str, check: str | None = None):
    """Registers a query whose state store gets as many partitions as there are cores."""

    def add(fn):
        def call(f: Fixtures):
            conf, key = f.spark.conf, "spark.sql.shuffle.partitions"
            before = conf.get(key)
            conf.set(key, str(f.spark.sparkContext.defaultParallelism))
            try:
                return fn(f)
            finally:
                conf.set(key, before)

        return query(name, check)(call)

    return add


def feed(f: Fixtures, name: str, table, order: str) -> str:
    """The table as files that arrive one after the other in ``order``."""
    path = scratch_path(f.spark, name)
    low, high = table.agg(F.min(order), F.max(order)).first()
    width = (high - low) // PARTS + 1
    for part in range(PARTS):
        piece = table.filter(F.floor((F.col(order) - low) / width) == part)
        piece.coalesce(1).write.mode("append").parquet(path)
    return path


def sample_stream(f: Fixtures):
    path = f.sample_feed()
    return f.spark.readStream.schema(f.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _sample_feed(self: Fixtures) -> str:
    from roadpulse.catalog import fixtures

    key = (self.spark.sparkContext.applicationId, self.dir, "sample_feed")
    if key not in fixtures._stored:
        fixtures._stored[key] = feed(self, "feed", P.decode_coordinates(self.gps()), "utc")
    return fixtures._stored[key]


Fixtures.sample_feed = _sample_feed


def state(f: Fixtures, name: str) -> str:
    return scratch_path(f.spark, name)


@stream_query("S2_line_stream", sql("SELECT event_id, suid, utc, lat, lon FROM gps WHERE event_id % 97 <> 96", "gps"))
def _(f):
    path = feed(f, "lines", f.gps_lines(), "event_id")
    lines = f.spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    parsed = G.complete(G.parse_gps(lines, ["event_id"]))
    out = scratch_path(f.spark, "parsed")
    ST.run(parsed.writeStream.format("parquet").option("path", out), state(f, "state"))
    return f.spark.read.parquet(out).select("event_id", "suid", "utc", "lat", "lon")


def text_files(f: Fixtures) -> str:
    """The lines as text files, broken ones among them, parted by a stream; run once for the queries below."""
    from roadpulse.catalog import fixtures

    key = (f.spark.sparkContext.applicationId, f.dir, "text_files")
    if key not in fixtures._stored:
        path, out = scratch_path(f.spark, "text"), scratch_path(f.spark, "parted")
        f.gps_lines().select("value").repartition(PARTS).write.text(path)
        ST.run(ST.lines_stage(G.stream_lines(f.spark, path), out), state(f, "state"))
        fixtures._stored[key] = out
    return fixtures._stored[key]


@stream_query("S2_text_files", sql("SELECT date, suid, utc, lat, lon, head, passenger FROM gps WHERE event_id % 97 <> 96", "gps"))
def _(f):
    """Rows of a stream of text files."""
    return f.spark.read.parquet(os.path.join(text_files(f), "rows")).drop("batch_id")


@stream_query("S2_broken_lines", sql(
    "SELECT concat_ws(' ', date, suid, utc, lat, lon, head) AS value FROM gps WHERE event_id % 97 = 96", "gps"))
def _(f):
    """Lines of the same files that have a field too few."""
    return f.spark.read.parquet(os.path.join(text_files(f), "broken")).select("value")


# A feed out of order: four files of points from all over the day. Rows an hour behind the newest of the files before the
# last one are late.
LATE_AFTER = 3600
SHUFFLED = """
  SELECT event_id, suid, utc, place, CAST((place - lo) // w AS BIGINT) AS batch FROM (SELECT *, (event_id * 7919) % 100003 AS place FROM gps),
    (SELECT min((event_id * 7919) % 100003) AS lo, (max((event_id * 7919) % 100003) - min((event_id * 7919) % 100003)) // 4 + 1 AS w FROM gps)"""
MARKS = f"""
  SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - {LATE_AFTER} AS mark
  FROM (SELECT batch, max(utc) AS newest FROM shuffled GROUP BY batch)"""
TOLD = """
  SELECT s.*, coalesce(s.utc <= m.mark, false) AS late FROM shuffled s JOIN marks m USING (batch)"""
SEEN = """
  SELECT suid, batch, max(newest) OVER (PARTITION BY suid ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT suid, batch, max(utc) AS newest FROM told WHERE NOT late GROUP BY suid, batch)"""
FATES = """
  SELECT t.event_id, t.suid, t.utc, t.batch, s.seen, CASE WHEN late THEN 'late' WHEN t.utc < s.seen THEN 'out_of_order' ELSE 'in_order' END AS fate
  FROM told t LEFT JOIN seen s ON s.suid = t.suid AND s.batch = t.batch AND NOT t.late"""
LATE = dict(shuffled=SHUFFLED, marks=MARKS, told=TOLD, seen=SEEN, fates=FATES)


def shuffled_run(f: Fixtures) -> tuple[str, ST.BatchMetrics]:
    """Fates of the shuffled feed and the metrics of its batches; run once for the queries below."""
    from roadpulse.catalog import fixtures

    key = (f.spark.sparkContext.applicationId, f.dir, "shuffled")
    if key not in fixtures._stored:
        points = P.decode_coordinates(f.gps()).withColumn("place", F.pmod(F.col("event_id") * 7919, F.lit(100003)))
        path, out = feed(f, "shuffled", points, "place"), scratch_path(f.spark, "fates")
        metrics = ST.BatchMetrics(f.spark, scratch_path(f.spark, "late-metrics"))
        stream = f.spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("place")
        f.spark.streams.addListener(metrics)
        try:
            fates = ST.fate_stream(stream, f"{LATE_AFTER} seconds")
            ST.run(fates.writeStream.foreachBatch(lambda batch, i: ST.write_batch(batch, out, i)), state(f, "state"))
            f.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        finally:
            f.spark.streams.removeListener(metrics)
        fixtures._stored[key] = out, metrics
    return fixtures._stored[key]


@stream_query("T6_stream_fates", sql("SELECT batch AS batch_id, fate, count(*) AS n FROM fates GROUP BY ALL", "gps", **LATE))
def _(f):
    """Late, out-of-order and ordered rows of every batch of a shuffled feed: from the metrics, and from the state's side output."""
    out, metrics = shuffled_run(f)
    fate = F.when(F.col("fate") == "out_of_order", "out_of_order").otherwise("in_order").alias("fate")
    told = f.spark.read.parquet(out).groupBy(F.col("batch_id").cast("bigint").alias("batch_id"), fate).agg(F.count(F.lit(1)).alias("n"))
    late = metrics.table().filter(F.col("dropped") > 0).select("batch_id", F.lit("late").alias("fate"), F.col("dropped").alias("n"))
    return told.unionByName(late)


@stream_query("T7_order_errors", sql("SELECT event_id, suid, utc, seen FROM fates WHERE fate = 'out_of_order'", "gps", **LATE))
def _(f):
    """Rows older than one of their vehicle from an earlier batch, as error rows."""
    out, _ = shuffled_run(f)
    return f.spark.read.parquet(out).filter("fate = 'out_of_order'").select("event_id", "suid", "utc", "seen")


def sliding(f: Fixtures, k: int = -1, age: int = 0):
    path = feed(f, "slide", f.samples().select("suid", "utc"), "utc")
    stream = f.spark.readStream.schema("suid bigint, utc bigint").option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(f.spark, "windows")
    ST.run(ST.slide_stream(stream, k, age).writeStream.format("parquet").option("path", out), state(f, "state"))
    return f.spark.read.parquet(out)


SLIDE = "SELECT suid, utc, count(*) OVER w AS n, min(utc) OVER w AS oldest FROM samples WINDOW w AS (PARTITION BY suid ORDER BY utc {frame} AND CURRENT ROW)"


@stream_query("W11_window_by_count", sql(SLIDE.format(frame="ROWS BETWEEN 6 PRECEDING"), "samples"))
def _(f):
    """Sliding window of the last seven samples of a vehicle."""
    return sliding(f, k=6)


@stream_query("W11_window_by_age", sql(SLIDE.format(frame="RANGE BETWEEN 900 PRECEDING"), "samples"))
def _(f):
    """Sliding window of a vehicle's samples of the last fifteen minutes."""
    return sliding(f, age=900)


@stream_query("T1_micro_batches", sql(f"""
    SELECT CAST((utc - lo) // w AS BIGINT) AS batch_id, count(*) AS n FROM gps, (SELECT min(utc) AS lo, (max(utc) - min(utc)) // {PARTS} + 1 AS w FROM gps)
    GROUP BY 1""", "gps"))
def _(f):
    """Rows per micro-batch."""
    out = scratch_path(f.spark, "counts")
    each = lambda batch, i: ST.write_batch(batch.agg(F.count(F.lit(1)).alias("n")), out, i)
    ST.run(sample_stream(f).writeStream.foreachBatch(each), state(f, "state"))
    return f.spark.read.parquet(out).select(F.col("batch_id").cast("bigint").alias("batch_id"), "n")


@stream_query("T2_T3_J14_X2_vehicle_state", sql("SELECT event_id, suid, utc FROM samples", "samples"))
def _(f):
    """Thinning with state per vehicle gives what the batch job gives."""
    out = scratch_path(f.spark, "thin")
    ST.run(ST.thin_stream(sample_stream(f)).writeStream.format("parquet").option("path", out), state(f, "state"))
    return f.spark.read.parquet(out).select("event_id", "suid", "utc")


@stream_query("T4_T5_T10_road_slices", sql(
    "SELECT gid, day, seq, round(avg_speed, 6) AS avg_speed, round(time, 6) AS time FROM road_slices WHERE closed",
    "arrivals", "road_state", **fold_sql("arrivals", "event_id")))
def _(f):
    """Slices closed by a stream of road observations in arrival order."""
    path = feed(f, "arrivals", f.arrivals(), "event_id")
    stream = f.spark.readStream.schema(f.arrivals().schema).option("maxFilesPerTrigger", 1).parquet(path)
    roads = ST.RoadState(road_state(f), scratch_path(f.spark, "roads"), ["event_id"], ARRIVAL_CHUNK)
    ST.run(stream.writeStream.foreachBatch(roads), state(f, "state"))
    return rounded(roads.closed(), "avg_speed", "time").select("gid", "day", "seq", "avg_speed", "time")


def pair_stream(f: Fixtures) -> ST.PairState:
    """All pairs as one micro-batch, so that the batch form's rows are expected; run once for the queries below."""
    from roadpulse.catalog import fixtures

    key = (f.spark.sparkContext.applicationId, f.dir, "pair_stream")
    done = key in fixtures._stored
    root = fixtures._stored.setdefault(key, scratch_path(f.spark, "pair-state"))
    history = f.history()
    state_of = ST.PairState(road_state(f), history, RS.class_history(history), root)
    if not done:
        path = feed(f, "pairs", f.pairs(), "utc")
        stream = f.spark.readStream.schema(f.pairs().schema).parquet(path)
        ST.run(stream.writeStream.foreachBatch(state_of), state(f, "state"))
    return state_of


@stream_query("T4_T10_K1_K3_pair_stream", sql(WRITTEN, "pairs", "road_state", **FULL))
def _(f):
    """Sensed and inferred rows from a stream of pairs."""
    return rounded(pair_stream(f).real_rows(), "time", "average_speed").select(
        "date", F.col("seq").cast("bigint").alias("seq"), "gid", "base_gid", "class_id", "time", "average_speed", "is_sensed")


@stream_query("K2_pair_stream_turnings", TURNED)
def _(f):
    """Turning rows of closed slices from a stream of pairs."""
    return rounded(pair_stream(f).turnings(), "time").select("day", F.col("seq").cast("bigint").alias("seq"), "gid", "next_gid", "time")


@stream_query("K4_pair_stream_history", sql(
    "SELECT gid, seq, round(average_speed, 6) AS average_speed FROM merged", "pairs", "road_state", **{**FULL, "merged": MERGED}))
def _(f):
    """History after a stream of pairs."""
    return rounded(pair_stream(f).history(), "average_speed").select("gid", F.col("seq").cast("bigint").alias("seq"), "average_speed")


@stream_query("T5_windowed_counts", sql("""
    SELECT (utc // 300) * 300 AS start, count(*) AS n FROM gps GROUP BY 1""", "gps"))
def _(f):
    """Tumbling five-minute windows with a watermark of one slice."""
    timed = sample_stream(f).withColumn("ts", F.timestamp_seconds("utc"))
    counts = timed.withWatermark("ts", "5 minutes").groupBy(F.window("ts", "5 minutes")).agg(F.count(F.lit(1)).alias("n"))
    out = scratch_path(f.spark, "windows")
    each = lambda batch, i: ST.write_batch(batch.select(F.unix_seconds("window.start").alias("start"), "n"), out, i)
    ST.run(counts.writeStream.outputMode("update").foreachBatch(each), state(f, "state"))
    # In update mode a window is reported again while it grows; the last report holds.
    return f.spark.read.parquet(out).groupBy("start").agg(F.max_by("n", "batch_id").alias("n"))


@stream_query("T7_order_violations", sql("""
    SELECT count(*) AS violations FROM (
      SELECT utc, max(utc) OVER (PARTITION BY suid ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM gps) WHERE utc < seen""", "gps"))
def _(f):
    """Points older than one of their vehicle that arrived before, with the day arriving in reverse."""
    from roadpulse.plans.ordered import with_running_max

    arrival = f.gps().select("suid", "utc", (-F.col("event_id")).alias("place"))
    seen = with_running_max(arrival, ["suid"], F.floor(F.col("place") / 500), ["place"], "utc", "seen")
    return seen.filter(F.col("utc") < F.col("seen")).agg(F.count(F.lit(1)).alias("violations"))


@stream_query("T8_static_join", sql("""
    SELECT a.event_id, a.road, r.class_id FROM arrivals a JOIN roads r ON r.id = a.road""", "arrivals", "roads"))
def _(f):
    """Stream of observations joined with the static road table."""
    path = feed(f, "arrivals", f.arrivals(), "event_id")
    stream = f.spark.readStream.schema(f.arrivals().schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = stream.join(f.roads().select(F.col("id").alias("road"), "class_id"), "road").select("event_id", "road", "class_id")
    out = scratch_path(f.spark, "joined")
    ST.run(joined.writeStream.format("parquet").option("path", out), state(f, "state"))
    return f.spark.read.parquet(out)


@stream_query("T9_cached_batch", sql("SELECT count(*) AS points, sum(CASE WHEN passenger THEN 1 ELSE 0 END)::BIGINT AS loaded FROM gps", "gps"))
def _(f):
    """Two results from one micro-batch that is kept while both are computed."""
    out = scratch_path(f.spark, "twice")

    def each(batch, i):
        kept = batch.persist()
        points = kept.agg(F.count(F.lit(1)).alias("points"))
        loaded = kept.filter("passenger").agg(F.count(F.lit(1)).alias("loaded"))
        ST.write_batch(points.select("points", F.lit(0).cast("bigint").alias("loaded")).unionByName(
            loaded.select(F.lit(0).cast("bigint").alias("points"), "loaded")), out, i)
        kept.unpersist()

    ST.run(sample_stream(f).writeStream.foreachBatch(each), state(f, "state"))
    return f.spark.read.parquet(out).agg(F.sum("points").alias("points"), F.sum("loaded").alias("loaded"))


@stream_query("T11_modulo_partitions", sql("SELECT suid % 5 AS part, count(*) AS n FROM gps GROUP BY 1", "gps"))
def _(f):
    placed = ST.by_modulo(f.gps().select("suid"), "suid", 5).select(F.spark_partition_id().cast("bigint").alias("part"))
    return placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@stream_query("T12_idle_timeout", sql("SELECT event_id, suid, utc FROM samples", "samples"))
def _(f):
    """Thinning that forgets vehicles idle for an hour of processing time; none is idle that long in this run."""
    out = scratch_path(f.spark, "thin")
    thin = ST.thin_stream(sample_stream(f), ttl_ms=3_600_000)
    ST.run_rows(thin.writeStream.format("parquet").option("path", out), state(f, "state"), f.gps().count())
    return f.spark.read.parquet(out).select("event_id", "suid", "utc")


@stream_query("T12_expired_visits", sql("""
    SELECT suid, min(utc) AS first, max(utc) AS last, count(*) AS n FROM gps, (SELECT (min(utc) + max(utc)) // 2 AS half FROM gps) WHERE utc < half GROUP BY suid""", "gps"))
def _(f):
    """Visits of the first half of the day: all vehicles are idle for longer than the timeout before the second half comes."""
    points = f.gps().select("suid", "utc")
    low, high = points.agg(F.min("utc"), F.max("utc")).first()
    half = (low + high) // 2
    path, out, at = scratch_path(f.spark, "halves"), scratch_path(f.spark, "visits"), state(f, "state")
    for part in (points.filter(F.col("utc") < half), points.filter(F.col("utc") >= half)):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = f.spark.readStream.schema("suid bigint, utc bigint").parquet(path)
        ST.run_rows(ST.visit_stream(stream, 1000).writeStream.format("parquet").option("path", out), at, part.count())
        time.sleep(2)
    # A vehicle that did not start anew would have one visit over both halves.
    return f.spark.read.parquet(out).filter(F.col("first") < half)


@stream_query("K7_batch_metrics", sql(f"""
    SELECT CAST((utc - lo) // w AS BIGINT) AS batch_id, count(*) AS rows, CAST((utc - lo) // w AS BIGINT) AS ordinal, TRUE AS timed
    FROM gps, (SELECT min(utc) AS lo, (max(utc) - min(utc)) // {PARTS} + 1 AS w FROM gps) GROUP BY ALL""", "gps"))
def _(f):
    """Rows of each batch as a listener has written them; times vary and are only compared with each other."""
    metrics = ST.BatchMetrics(f.spark, scratch_path(f.spark, "metrics"))
    f.spark.streams.addListener(metrics)
    try:
        counts = sample_stream(f).groupBy("date").count()
        ST.run(counts.writeStream.outputMode("complete").format("noop"), state(f, "state"))
        # Reports arrive on their own thread, in order; an empty query's report comes after them.
        f.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        f.spark.streams.removeListener(metrics)
    timed = (F.col("total_ms") >= F.col("processing_ms")) & (F.col("scheduling_ms") >= 0)
    return metrics.table().select("batch_id", "rows", "ordinal", timed.alias("timed"))


@stream_query("K8_memory_sink", sql("SELECT date, passenger, count(*) AS n FROM gps GROUP BY ALL", "gps"))
def _(f):
    """Small summary of each batch kept for display."""
    name = "echo_" + os.path.basename(scratch_path(f.spark, "m")).replace("-", "_")
    counts = sample_stream(f).groupBy("date", "passenger").agg(F.count(F.lit(1)).alias("n"))
    ST.run(counts.writeStream.outputMode("complete").format("memory").queryName(name), state(f, "state"))
    return f.spark.table(name)


@stream_query("G8_W9_W10_match_online")
def _(f):
    return f.online().select("suid", "utc", "gid", F.round("offset", 6).alias("offset"), "broke")


@stream_query("G8_online_pairs")
def _(f):
    """Pairs of consecutive converged points with the sample's passenger flag."""
    meta = f.samples().select("suid", "utc", "passenger")
    points = f.online().join(meta, ["suid", "utc"])
    paired = pairing.usable_pairs(pairing.pair_up(points, ["gid", "offset", "passenger"]))
    return paired.select("suid", "utc", "pre_gid", "gid", F.array_join(F.transform("route", lambda x: x.cast("string")), ",").alias("route"))


def _online(self: Fixtures):
    from roadpulse.catalog import fixtures

    key = (self.spark.sparkContext.applicationId, self.dir, "online")
    if key not in fixtures._stored:
        root = scratch_path(self.spark, "online")
        ST.match_online(sample_stream(self), self.base_roads(), self.roads(), self.successors(), root, files=4 * ST.HANDED_FILES)
        fixtures._stored[key] = os.path.join(root, "matched")
    return self.spark.read.schema(ST.CONVERGED_SCHEMA).parquet(fixtures._stored[key])


Fixtures.online = _online
