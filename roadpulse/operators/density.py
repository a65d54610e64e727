"""Density maps, load shedding by density, and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.params import GridParams, TrafficParams
from roadpulse.plans.lineage import cut
from roadpulse.plans.ordered import day_chunk


def density(cells: DataFrame) -> DataFrame:
    """Accepted points per day, slice and cell."""
    return cells.groupBy("date", "seq", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def hot_cells(counts: DataFrame, limit: int = GridParams().hot) -> DataFrame:
    return counts.filter(F.col("n") >= limit)


def shed_load(cells: DataFrame, batch_seconds: int = 20, g: GridParams = GridParams(), p: TrafficParams = TrafficParams()) -> DataFrame:
    """Marks points dropped while their area is over capacity.

    ``cells`` are thinned points with date, suid, utc, passenger, seq, x, y. A
    vehicle's points of one batch form a queue; when its first point lies in a
    cell that already counted ``capacity`` points in this slice, the vehicle is
    in dump mode until a long gap, a status change or a move to another cell.
    Only accepted points of earlier batches count, so the result does not depend
    on the order in which vehicles are processed. What is accepted depends on
    the counts before it: passes are repeated until no decision changes. A pass
    settles at least one more batch, in practice nearly all of them.
    """
    marked = cut(cells.withColumn("batch", F.floor(F.col("utc") / batch_seconds)))
    accepted, seen = marked, None
    while True:
        result = cut(_shed_once(marked, accepted, g, p))
        mark = tuple(result.agg(F.count_if("dropped"), F.sum(F.when(F.col("dropped"), F.xxhash64("suid", "utc").cast("decimal(38,0)")))).first())
        if mark == seen:
            return result
        seen, accepted = mark, marked.join(result.filter(~F.col("dropped")).select("suid", "utc"), ["suid", "utc"], "left_semi")


def _shed_once(marked: DataFrame, accepted: DataFrame, g: GridParams, p: TrafficParams) -> DataFrame:
    """Decisions for all points given which ones counted."""
    per_batch = accepted.groupBy("date", "seq", "x", "y", "batch").agg(F.count(F.lit(1)).alias("n"))
    # At most one slice of batches per cell: a group holds SLICE_SECONDS / batch_seconds rows.
    running = per_batch.groupBy("date", "seq", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("batch", "n"))).alias("all")
    )
    before = running.select(
        "date", "seq", "x", "y",
        F.inline(
            F.transform(
                "all",
                lambda b: F.struct(
                    b.batch.alias("batch"),
                    F.aggregate(
                        F.filter("all", lambda o: o.batch < b.batch), F.lit(0).cast("long"), lambda acc, o: acc + o.n
                    ).alias("before"),
                ),
            )
        ),
    )
    # A batch without accepted points in a cell has the count of the last one that had some.
    spans = before.join(per_batch, ["date", "seq", "x", "y", "batch"]).groupBy("date", "seq", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("batch", (F.col("before") + F.col("n")).alias("upto")))).alias("upto"))
    earlier = F.filter("upto", lambda o: o.batch < F.col("batch"))
    counted = marked.join(spans, ["date", "seq", "x", "y"], "left").withColumn(
        "before", F.coalesce(F.try_element_at(earlier, F.lit(-1))["upto"], F.lit(0)).cast("long")).drop("upto")
    # Thinned points of one vehicle and day: at most 8,640 rows in a group.
    traces = counted.groupBy("suid", day_chunk().alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("utc", "batch", "before", "passenger", "x", "y", "date", "seq"))).alias("rows")
    )
    none_long = F.lit(None).cast("long")
    start = F.struct(
        F.lit(False).alias("dump"), none_long.alias("batch"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"),
        none_long.alias("utc"), F.lit(None).cast("boolean").alias("passenger"), F.expr("cast(array() as array<boolean>)").alias("drops"),
    )

    def step(acc, r):
        fresh = acc.batch.isNull() | (acc.batch != r.batch)
        dump = F.when(fresh, r.before >= g.capacity).otherwise(acc.dump)
        dump_x = F.when(fresh, r.x).otherwise(acc.x)
        dump_y = F.when(fresh, r.y).otherwise(acc.y)
        leaves = (r.utc - acc.utc > p.max_gap) | (r.passenger != acc.passenger) | (r.x != dump_x) | (r.y != dump_y)
        drop = F.coalesce(dump & ~leaves, F.lit(False))
        return F.struct(
            drop.alias("dump"), r.batch.alias("batch"), dump_x.alias("x"), dump_y.alias("y"),
            F.when(drop, acc.utc).otherwise(r.utc).alias("utc"),
            F.when(drop, acc.passenger).otherwise(r.passenger).alias("passenger"),
            F.concat(acc.drops, F.array(drop)).alias("drops"),
        )

    return traces.select(
        "suid",
        F.inline(F.zip_with("rows", F.aggregate("rows", start, step, lambda acc: acc.drops), lambda r, d: F.struct(
            r.date.alias("date"), r.utc.alias("utc"), r.seq.alias("seq"), r.x.alias("x"), r.y.alias("y"), d.alias("dropped")
        ))),
    )


def dropped_counts(shed: DataFrame) -> DataFrame:
    return shed.groupBy("date").agg(F.count_if(F.col("dropped")).alias("dropped"))


def mean_cost(costs: DataFrame, by: list[str]) -> DataFrame:
    """Whole-number mean of positive latencies; NULL for a group without any."""
    return costs.groupBy(*by).agg(F.floor(F.avg(F.when(F.col("cost") > 0, F.col("cost")))).alias("mean_cost"))


def batch_sizes(gps: DataFrame, batch: Column) -> DataFrame:
    return gps.groupBy(batch.alias("batch")).agg(
        F.countDistinct("suid").alias("vehicles"), F.count(F.lit(1)).alias("points")
    )
