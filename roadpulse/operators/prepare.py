"""Cleaning and thinning of GPS traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.params import DAY_SECONDS, GridParams, TrafficParams


def decode_coordinates(gps: DataFrame) -> DataFrame:
    """Integer 1e-5 degrees to degrees."""
    return gps.withColumn("lat", F.col("lat") / 1e5).withColumn("lon", F.col("lon") / 1e5)


def local_time_text(utc: Column, zone: str = "GMT+8") -> Column:
    """Epoch seconds as text in a fixed zone, whatever the session's zone is."""
    hours = {"GMT+8": 8, "UTC": 0}[zone]
    shifted = F.timestamp_add("SECOND", utc + hours * 3600, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(shifted, "yyyy-MM-dd HH:mm:ss")


def passenger_flag(status: Column) -> Column:
    return status.contains("重车")


def sample_vehicles(gps: DataFrame, modulo: int = 3, remainder: int = 0) -> DataFrame:
    return gps.filter(F.pmod("suid", F.lit(modulo)) == remainder)


def until(gps: DataFrame, utc: int) -> DataFrame:
    return gps.filter(F.col("utc") <= utc)


def with_cell(samples: DataFrame, g: GridParams = GridParams()) -> DataFrame:
    """Grid cell of a position, truncated toward zero; index 100 counts as 99."""

    def index(value: Column, low: float, step: float) -> Column:
        raw = ((value - low) / step).cast("int")
        return F.when(raw == g.cells, g.cells - 1).otherwise(raw)

    return samples.withColumn("x", index(F.col("lon"), g.min_lon, g.lon_step)).withColumn(
        "y", index(F.col("lat"), g.min_lat, g.lat_step)
    )


def inside_grid(cells: DataFrame, g: GridParams = GridParams()) -> DataFrame:
    return cells.filter(F.col("x").between(0, g.cells - 1) & F.col("y").between(0, g.cells - 1))


def thin_traces(gps: DataFrame, key: str = "suid", tie: str = "event_id", p: TrafficParams = TrafficParams()) -> DataFrame:
    """Keeps a point only when it is ``min_gap`` seconds after the last kept one.

    The first row of each vehicle second is chosen by partial aggregation, so a
    group of one vehicle and day holds at most 86,400 rows. A day's walk
    depends on the day before only through the seconds still blocked at
    midnight: days that can block are summarised as a table from blocked seconds
    at the start to blocked seconds at the end, and those tables are chained.
    """
    gap = p.min_gap
    rest = [c for c in gps.columns if c not in (key, "utc")]
    seconds = gps.groupBy(key, "utc").agg(F.min_by(F.struct(*rest), tie).alias("row"))
    day = F.floor(F.col("utc") / DAY_SECONDS).alias("day")
    days = seconds.groupBy(key, day).agg(F.array_sort(F.collect_list(F.struct("utc", "row"))).alias("rows"))

    def blocked_after(times: Column, day_col: Column, blocked: Column) -> Column:
        free = F.aggregate(
            times,
            (day_col * DAY_SECONDS + blocked).cast("long"),
            lambda acc, t: F.when(t >= acc, t + gap).otherwise(acc),
        )
        return F.greatest(F.lit(0).cast("long"), free - (day_col + 1) * DAY_SECONDS)

    blocking = (
        gps.select(key, "utc").distinct()
        .groupBy(key, day)
        .agg(F.array_sort(F.collect_list("utc")).alias("times"))
        .filter(F.element_at("times", -1) > (F.col("day") + 1) * DAY_SECONDS - gap)
        .select(
            key, "day",
            F.transform(
                F.sequence(F.lit(0), F.lit(gap - 1)), lambda b: blocked_after(F.col("times"), F.col("day"), b)
            ).alias("after"),
        )
    )
    chained = blocking.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "after"))).alias("chain"))
    none = F.struct(F.lit(None).cast("long").alias("day"), F.lit(0).cast("long").alias("blocked"))

    def follow(acc, link):
        before = F.element_at(acc, -1)
        entry = F.when(before.day == link.day, before.blocked).otherwise(F.lit(0))
        return F.concat(
            acc,
            F.array(F.struct((link.day + 1).alias("day"), F.get(link.after, entry.cast("int")).alias("blocked"))),
        )

    entries = chained.select(
        key, F.inline(F.aggregate("chain", F.array(none), follow))
    ).filter(F.col("day").isNotNull())

    start = F.struct(
        (F.col("day") * DAY_SECONDS + F.coalesce(F.col("blocked"), F.lit(0))).cast("long").alias("free"),
        F.slice("rows", 1, 0).alias("kept"),
    )
    walked = F.aggregate(
        "rows",
        start,
        lambda acc, r: F.when(
            r.utc >= acc.free,
            F.struct((r.utc + gap).alias("free"), F.concat(acc.kept, F.array(r)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc.kept,
    )
    kept = days.join(entries, [key, "day"], "left").select(key, F.inline(walked))
    return kept.select(*[F.col("row")[c].alias(c) if c in rest else F.col(c) for c in gps.columns])


def subsample(samples: DataFrame, interval: int, keys: list[str], order: str = "utc") -> DataFrame:
    """First and last sample of a trace and those a whole number of intervals in."""
    ends = samples.groupBy(*keys).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    since = F.col(order) - F.col("_first")
    return (
        samples.join(ends, keys)
        .filter((since == 0) | (F.col(order) == F.col("_last")) | (since % interval == 0))
        .drop("_first", "_last")
    )


def positive_costs(costs: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Latency records worth averaging: positive and below the outlier limit."""
    return costs.filter((F.col("cost") > 0) & (F.col("cost") <= p.cost_limit_ms))


def one_per_batch(gps: DataFrame, batch: Column, key: str = "suid", tie: str = "event_id") -> DataFrame:
    """Earliest record of each vehicle in each batch."""
    rest = [c for c in gps.columns if c != key]
    return (
        gps.groupBy(key, batch.alias("batch"))
        .agg(F.min_by(F.struct(*rest), F.struct("utc", tie)).alias("row"))
        .select(key, "batch", "row.*")
    )
