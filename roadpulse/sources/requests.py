"""Match requests as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "struct<id:string,time:string,point:string>"


def parse_requests(requests: DataFrame, key: str, column: str = "body") -> DataFrame:
    """Samples of requests: a JSON array, or an object with ``request`` and ``format``.

    ``time`` is epoch milliseconds or text with an offset; ``point`` is WKT.
    """
    body = F.col(column)
    bare = F.trim(body).startswith("[")
    whole = F.from_json(F.when(~bare, body), f"struct<request:array<{ITEM}>,format:string>")
    items = F.when(bare, F.from_json(F.when(bare, body), f"array<{ITEM}>")).otherwise(whole.request)
    rows = requests.select(key, F.when(bare, F.lit("slim")).otherwise(F.coalesce(whole.format, F.lit("slim"))).alias("format"), F.explode(items).alias("i"))
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"POINT\s*\(\s*{number}\s+{number}\s*\)"
    at = F.try_to_timestamp("i.time", F.lit("yyyy-MM-dd HH:mm:ssX"))
    return rows.select(
        key, "format", F.col("i.id").alias("id"),
        F.coalesce(F.col("i.time").try_cast("bigint"), F.unix_millis(at)).alias("time"),
        F.regexp_extract("i.point", pattern, 1).try_cast("double").alias("lon"),
        F.regexp_extract("i.point", pattern, 2).try_cast("double").alias("lat"),
    )


def repeated_times(samples: DataFrame, key: str) -> DataFrame:
    """Times that occur more than once in a request; such requests are rejected."""
    return samples.groupBy(key, "time").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def accepted_requests(samples: DataFrame, key: str) -> DataFrame:
    return samples.join(repeated_times(samples, key).select(key).distinct(), key, "left_anti")


def parse_points(texts: DataFrame, roads: DataFrame, column: str = "body") -> DataFrame:
    """Road points from ``{"road":..,"frac":..}``; an unknown road gives ``known`` false."""
    p = F.from_json(column, "struct<road:bigint,frac:double>")
    known = roads.select(F.col("id").alias("road"), F.lit(True).alias("found"))
    return texts.select("*", p.road.alias("road"), p.frac.alias("frac")).join(known, "road", "left").withColumn(
        "known", F.coalesce("found", F.lit(False))).drop("found")


def parse_routes(texts: DataFrame, roads: DataFrame, keys: list[str], column: str = "body") -> DataFrame:
    """Routes from ``{"source":..,"target":..,"roads":[..]}`` with the number of unknown roads."""
    point = "struct<road:bigint,frac:double>"
    r = F.from_json(column, f"struct<source:{point},target:{point},roads:array<bigint>>")
    parsed = texts.select(
        *keys, r.source.frac.alias("start_fraction"), r.target.frac.alias("end_fraction"), r.roads.alias("path"))
    steps = parsed.select(*keys, F.explode("path").alias("id")).join(roads.select("id"), "id", "left_anti")
    unknown = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("unknown"))
    return parsed.join(unknown, keys, "left").withColumn("unknown", F.coalesce("unknown", F.lit(0)))
