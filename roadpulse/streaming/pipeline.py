"""Structured Streaming form of the pipeline.

Samples are thinned with state per vehicle, get candidates and routes as
ordinary joins in each micro-batch, and are decoded with state per vehicle. The
stages hand batches over through Parquet folders on shared storage, written
once under the batch id.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from roadpulse.functions import geo
from roadpulse.operators import matching as M
from roadpulse.operators import traffic as TR
from roadpulse.operators.routing import ROUTES
from roadpulse.params import MatchParams, TrafficParams
from roadpulse.plans import clamped
from roadpulse.plans.lineage import cut, drop, kept, shuffles_dropped
from roadpulse.session import ship
from roadpulse.sources.gps import complete, parse_gps, quarantined
from roadpulse.streaming.processors import (
    CONVERGED_SCHEMA, PREVIOUS_SCHEMA, SLIDE_SCHEMA, VISIT_SCHEMA, FateProcessor, IdleProcessor, MatchProcessor, PreviousProcessor,
    SlideProcessor, ThinProcessor,
)


def triggered(writer: DataStreamWriter, interval: str | None = None) -> DataStreamWriter:
    """Micro-batches every ``interval`` ("1 second", "10 seconds", "20 seconds"), or all available data once."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def start(writer: DataStreamWriter, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    return triggered(writer.option("checkpointLocation", checkpoint), interval).start()


def run(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = start(writer, checkpoint)
    query.awaitTermination()
    return query


def run_rows(writer: DataStreamWriter, checkpoint: str, rows: int) -> StreamingQuery:
    """Runs until ``rows`` input rows are processed, then stops.

    A query that expires state by the clock starts batches without data as
    well, so it does not end by itself when all data is read. Rows are summed
    per batch id from each new progress report; the list of recent ones is
    short and forgets.
    """
    query = start(writer, checkpoint, "1 second")
    seen: dict[int, int] = {}
    while query.isActive and sum(seen.values()) < rows:
        query.awaitTermination(1)
        seen |= {p.batchId: p.numInputRows for p in query.recentProgress if p.numInputRows}
    query.stop()
    return query


def batch_folder(path: str, batch_id: int) -> str:
    return os.path.join(path, f"batch_id={batch_id}")


def _committed(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Stores a batch once. A repeated batch has the same rows, so what was committed stays, and its readers with it."""
    folder = batch_folder(path, batch_id)
    if not _committed(df.sparkSession, folder):
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").parquet(folder)


def by_modulo(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Places key k on partition k mod ``parts``."""
    return df.repartitionById(parts, F.pmod(F.col(key), F.lit(parts)).cast("int"))


# -- per-vehicle state ------------------------------------------------------------

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of vehicles that share an entry of the state.
VEHICLE_GROUPS = 1024


def keyed_state(df: DataFrame, processor, schema, ttl_ms: int | None = None, event_time: bool = False, key: str = "suid") -> DataFrame:
    """State per vehicle, or per ``key``; the state store has to be RocksDB for this operator.

    With ``event_time`` rows behind the watermark of ``df`` are dropped and counted by the engine before they reach the state.
    """
    spark = df.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    ship(spark)
    # The state's worker beside the driver reads no shipped files; it finds the package by its path.
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    mode = "EventTime" if event_time else "ProcessingTime" if ttl_ms else "None"
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", mode)


def in_groups(rows: DataFrame) -> DataFrame:
    """Adds the group of each vehicle: a call of the state costs far more than the few rows of one vehicle."""
    return rows.withColumn("_group", F.when(F.col("suid").isNotNull(), F.pmod(F.hash("suid"), F.lit(VEHICLE_GROUPS))))


def thin_stream(samples: DataFrame, p: TrafficParams = TrafficParams(), ttl_ms: int | None = None) -> DataFrame:
    """Thinned samples; ``ttl_ms`` forgets vehicles idle for that long."""
    processor = ThinProcessor(samples.columns, p, ttl_ms)
    if ttl_ms:  # a vehicle expires on its own
        return keyed_state(samples, processor, samples.schema, ttl_ms)
    return keyed_state(in_groups(samples), processor, samples.schema, key="_group")


def fate_stream(samples: DataFrame, delay: str | None = None, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Every sample with its fate, see :class:`FateProcessor`; with ``delay`` rows older than the watermark are left out.

    The engine counts what it leaves out in its progress reports; :class:`BatchMetrics` keeps the count of every batch.
    """
    schema = T.StructType([*samples.schema.fields, T.StructField("fate", T.StringType()), T.StructField("seen", T.LongType())])
    timed = samples.withColumn("_at", F.timestamp_seconds("utc")).withWatermark("_at", delay) if delay else samples
    return keyed_state(in_groups(timed), FateProcessor(samples.columns, p), schema, event_time=bool(delay), key="_group")


def visit_stream(samples: DataFrame, ttl_ms: int) -> DataFrame:
    """Visits of vehicles that were idle for ``ttl_ms``, see :class:`IdleProcessor`."""
    return keyed_state(samples, IdleProcessor(ttl_ms), VISIT_SCHEMA, ttl_ms)


def slide_stream(samples: DataFrame, k: int = -1, age: int = 0) -> DataFrame:
    """Sliding windows of vehicles, see :class:`SlideProcessor`."""
    return keyed_state(samples, SlideProcessor(k, age), SLIDE_SCHEMA)


def lines_stage(lines: DataFrame, path: str):
    """Writer that parts a stream of text lines into GPS rows below ``path/rows`` and broken lines below ``path/broken``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_gps(batch, ["value"]).persist()
        write_batch(complete(parsed).drop("value"), os.path.join(path, "rows"), batch_id)
        write_batch(quarantined(parsed).select("value"), os.path.join(path, "broken"), batch_id)
        parsed.unpersist()

    return lines.writeStream.foreachBatch(each)


#: Files that a stage hands over per batch.
HANDED_FILES = 8


def candidates_stage(thinned: DataFrame, ways: M.MatchMap, path: str, p: MatchParams = MatchParams()):
    """Writer that stores the candidates of every batch of thinned samples."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # Written first, because the state must be read once per batch.
        vecs = M.vectors(ways.candidates(cut(batch), p))
        listed = vecs.select("*", F.transform("cs", lambda c: c.road_id).alias("roads"), F.to_json("cs").alias("cs_json")).drop("cs")
        # A vehicle's rows of a batch go to one file: the next stage may take the files in several batches of its own.
        write_batch(listed.repartition(HANDED_FILES, "suid"), path, batch_id)

    return thinned.writeStream.foreachBatch(each)


VECTOR_SCHEMA = "suid bigint, date string, utc bigint, slon double, slat double, roads array<bigint>, cs_json string"
CS_SCHEMA = "array<struct<road_id:bigint,fraction:double,lon:double,lat:double,dist:double,emission:double,road_cost:double,road_length:double>>"


def routes_stage(vecs: DataFrame, ways: M.MatchMap, path: str, p: MatchParams = MatchParams(), ttl_ms: int | None = None):
    """Writer that finds the routes from each vehicle's previous sample."""
    paired = keyed_state(vecs, PreviousProcessor(ttl_ms), PREVIOUS_SCHEMA, ttl_ms)

    def each(batch: DataFrame, batch_id: int) -> None:
        prev = F.struct(
            F.col("pre_utc").alias("utc"), F.col("pre_slon").alias("slon"), F.col("pre_slat").alias("slat"), F.col("pre_roads").alias("roads"))
        # Written first, because the state must be read once per batch.
        kept = cut(batch.select(
            *M.SAMPLE, F.from_json("cs_json", CS_SCHEMA).alias("cs"), F.when(F.col("pre_utc").isNotNull(), prev).alias("prev")))
        write_batch(M.with_routes(kept, ways.tiles, p=p).repartition(HANDED_FILES, "suid"), path, batch_id)

    return paired.writeStream.foreachBatch(each)


def match_stream(routed: DataFrame, p: MatchParams = MatchParams(), ttl_ms: int | None = None) -> DataFrame:
    """Converged points of the online matcher."""
    return keyed_state(routed, MatchProcessor(p, ttl_ms), CONVERGED_SCHEMA, ttl_ms)


def read_batches(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """Stream over the batches another stage has written, oldest first, ``files`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


ROUTED_SCHEMA = (
    f"suid bigint, date string, utc bigint, slon double, slat double, cs {CS_SCHEMA}, "
    "prev struct<utc:bigint,slon:double,slat:double,roads:array<bigint>>, "
    f"routes {ROUTES}, straight double"
)


def match_online(
    samples: DataFrame, base: DataFrame, roads: DataFrame, succ: DataFrame, root: str, p: MatchParams = MatchParams(),
    interval: str | None = None, files: int = 8,
) -> DataFrame | list[StreamingQuery]:
    """Thinning, candidates, routes and matching as three queries that hand over through folders below ``root``.

    With an ``interval`` all three run at once, each taking what the one before it has written; the running queries are
    returned. Without one, the available stream is drained stage by stage and the converged points are returned. State is
    carried over the micro-batches of every stage, so the points do not depend on how the input is cut into batches.
    What is read of the roads is prepared once, before the first batch.
    """
    spark = samples.sparkSession
    ways = M.MatchMap(base, roads, succ, p)
    folder = lambda name: os.path.join(root, name)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("vectors", "routed"):  # a stage may start before the one before it has written
        made = path(folder(name))
        made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)
    stages = [
        (lambda: candidates_stage(thin_stream(samples), ways, folder("vectors"), p), "state-thin"),
        (lambda: routes_stage(read_batches(spark, folder("vectors"), VECTOR_SCHEMA, files), ways, folder("routed"), p), "state-routes"),
        (lambda: match_stream(read_batches(spark, folder("routed"), ROUTED_SCHEMA, files), p).writeStream.format("parquet").option(
            "path", folder("matched")), "state-match"),
    ]
    if interval:
        return [start(writer(), folder(state), interval) for writer, state in stages]
    for writer, state in stages:
        run(writer(), folder(state))
    return spark.read.schema(CONVERGED_SCHEMA).parquet(folder("matched"))


# -- road state ----------------------------------------------------------------------

class RoadState:
    """Road speeds carried from batch to batch as a versioned table.

    A batch reads the version before it, smooths its observations with the same
    operators as a batch run, appends the slices that closed, and writes the
    next version. Versions are named by batch id, so a batch that is run again
    after a failure starts from the same state.
    """

    def __init__(self, roads: DataFrame, root: str, order: list[str], chunk, p: TrafficParams = TrafficParams()):
        self.roads = roads
        self.root = root
        self.order = order
        self.chunk = chunk
        self.p = p

    def _state(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.roads.withColumn("open_slot", F.lit(None).cast("bigint"))
        return self.roads.sparkSession.read.parquet(batch_folder(os.path.join(self.root, "state"), batch_id - 1))

    def _smoothed(self, obs: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Updates, and a function for each road and slice."""
        admitted = TR.admit(obs, self.order, self.chunk(), self.p, state.select(F.col("gid").alias("road"), "open_slot"))
        updates = cut(TR.speed_updates(admitted, state, self.p))
        return updates, cut(clamped.per_slice(updates, ["road"], "slot", "_chunk", self.order))

    def _advance(self, obs: DataFrame, state: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Writes the next version; returns the updates, the slices they end and those that closed."""
        updates, slices = self._smoothed(obs, state)
        touched = slices.select("road").distinct()
        carried = (
            state.filter(F.col("open_slot").isNotNull()).select(F.col("gid").alias("road"), F.col("open_slot").alias("slot"))
            .join(touched, "road", "left_semi").join(slices.select("road", "slot"), ["road", "slot"], "left_anti")
            .withColumn("f", clamped.identity())
        )
        start = state.select(F.col("gid").alias("road"), F.col("avg_speed").alias("v"))
        whole = slices.unionByName(carried)
        limits = tuple(whole.agg(F.min("slot"), F.max("slot")).first())
        walked = clamped.walk(whole, start, ["road"], "slot", TR.SLICES_PER_DAY, limits=None if None in limits else limits)
        ends = kept(walked)
        # A stream would fill the disk with what its batches have kept.
        drop(walked, slices)
        drop(slices)
        newest = ends.groupBy("road").agg(F.max_by("v", "slot").alias("new_v"), F.max("slot").alias("new_slot"))
        following = state.join(newest.withColumnRenamed("road", "gid"), "gid", "left").withColumn(
            "avg_speed", F.coalesce("new_v", "avg_speed")).withColumn("open_slot", F.coalesce("new_slot", "open_slot")).drop("new_v", "new_slot")
        write_batch(following.withColumn("time", F.col("length") / F.col("avg_speed")), self._path("state"), batch_id)
        named = ends.join(self.roads.select(F.col("gid").alias("road"), "base_gid", "length", "class_id", "max_speed"), "road").join(
            newest.select("road", "new_slot"), "road").select(
            F.col("road").alias("gid"), "base_gid", "length", "class_id", "max_speed", "slot", TR.slot_day(F.col("slot")).alias("day"),
            TR.slot_seq(F.col("slot")).alias("seq"), F.col("v").alias("avg_speed"), (F.col("length") / F.col("v")).alias("time"),
            (F.col("slot") < F.col("new_slot")).alias("closed"))
        rows = kept(named)
        drop(ends)
        out = rows.filter("closed").drop("max_speed", "slot", "closed")
        write_batch(out, self._path("closed"), batch_id)
        return updates, rows, rows.filter("closed")

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _written(self, name: str) -> DataFrame:
        return self.roads.sparkSession.read.parquet(self._path(name)).drop("batch_id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        obs = batch.persist()
        _, rows, _ = self._advance(obs, self._state(batch_id), batch_id)
        drop(rows)
        obs.unpersist()

    def closed(self) -> DataFrame:
        return self._written("closed")


TURN_SCHEMA = "gid bigint, next_gid bigint, time double, turn_seq bigint, slot bigint"


class PairState(RoadState):
    """Road speeds, turning times and inferred rows from a stream of trajectory pairs.

    Route shares use the road and turning times at the start of the batch. Each batch appends the sensed rows, turning rows
    and inferred rows of the slices that it closes; history is updated from them by :meth:`history`.
    """

    def __init__(self, roads: DataFrame, history: DataFrame, class_history: DataFrame, root: str, p: TrafficParams = TrafficParams()):
        super().__init__(roads, root, TR.ORDER, TR.minute_chunk, p)
        self.past = history
        self.class_past = class_history

    def _smoothed(self, obs: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs are taken in time order."""
        updates = TR.timed_updates(obs, self.p)
        return updates, kept(TR.timed_slices(updates, self.order, self.chunk(), self.p))

    def _turning(self, batch_id: int) -> DataFrame:
        spark = self.roads.sparkSession
        if batch_id == 0:
            return spark.createDataFrame([], TURN_SCHEMA)
        return spark.read.schema(TURN_SCHEMA).parquet(batch_folder(self._path("turning"), batch_id - 1))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state, known = self._state(batch_id), self._turning(batch_id)
        obs = kept(TR.observations(batch, state, known, self.p, (*TR.CARRIED, "open_slot")))
        updates, rows, closed = self._advance(obs, state, batch_id)
        turns = TR.turning_updates(updates, self.order, self.chunk(), self.p, known)
        kinds = dict(part.split() for part in TURN_SCHEMA.split(", "))
        limits = tuple(updates.agg(F.min("slot"), F.max("slot")).first())
        found = TR.smooth_turnings(turns, self.p, known, None if None in limits else limits).select(
            *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
        ends = kept(found)
        drop(found, obs)
        drop(obs)
        pair = ["gid", "next_gid"]
        last = ends.groupBy(*pair).agg(F.max_by(F.struct("time", "turn_seq", "slot"), "slot").alias("l")).select(*pair, "l.*")
        write_batch(known.join(last, pair, "left_anti").unionByName(last), self._path("turning"), batch_id)
        # Turns of a closing slice: updated in this batch, or before it and not since.
        listed = ends.unionByName(known.join(ends.select(*pair, "slot"), [*pair, "slot"], "left_anti")).withColumn(
            "day", TR.slot_day(F.col("slot"))).withColumn("seq", TR.slot_seq(F.col("slot")))
        write_batch(TR.closed_turnings(listed, closed.withColumn("closed", F.lit(True))).select("day", "seq", *pair, "time"), self._path("turnings"), batch_id)
        write_batch(TR.infer_gaps(rows, self.past, self.class_past, self.p), self._path("inferred"), batch_id)
        drop(rows)
        drop(ends)

    def turnings(self) -> DataFrame:
        """Turning rows of closed slices."""
        return self._written("turnings")

    def real_rows(self) -> DataFrame:
        """Sensed and inferred rows of closed slices."""
        return TR.real_road_rows(self.closed().withColumn("closed", F.lit(True)), self._written("inferred"))

    def history(self) -> DataFrame:
        """History after all batches so far."""
        return TR.update_history(self.past, self.real_rows(), self.p)


# -- metrics --------------------------------------------------------------------------

METRICS_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("batch_time", T.StringType()),
    T.StructField("processing_ms", T.LongType()), T.StructField("scheduling_ms", T.LongType()), T.StructField("total_ms", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("dropped", T.LongType()),
])


def progress_row(p) -> tuple:
    """Processing is the batch itself; scheduling is what comes before it in the trigger: offsets, logs and planning.

    ``dropped`` are the rows that came behind the watermark.
    """
    durations = p.durationMs
    total, batch = int(durations.get("triggerExecution", 0)), int(durations.get("addBatch", 0))
    return p.name or str(p.id), int(p.batchId), str(p.timestamp), batch, max(0, total - batch), total, int(p.numInputRows), sum(
        int(o.numRowsDroppedByWatermark) for o in p.stateOperators)


class BatchMetrics(StreamingQueryListener):
    """Writes one row per finished micro-batch below ``path``, so that nothing is kept or lost in memory.

    A batch is named by query and batch id; a report that comes twice replaces
    itself. Each file holds one small row of JSON.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = self.spark.createDataFrame([progress_row(p)], METRICS_SCHEMA).coalesce(1)
        row.write.mode("overwrite").json(os.path.join(self.path, f"query_id={p.id}", f"batch={int(p.batchId)}"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        """All batches, with the ordinal of each in its query."""
        rows = self.spark.read.schema(METRICS_SCHEMA).option("recursiveFileLookup", "true").json(self.path)
        # One row a batch of a query.
        return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query").orderBy("batch_id")).cast("bigint") - 1)
