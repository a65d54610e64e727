"""Road network, road classes, history and road lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions import geo
from roadpulse.params import ROAD_CLASS_MAXSPEED, ROAD_CLASS_PRIORITY

POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))

WAYS_SCHEMA = T.StructType([
    T.StructField("gid", T.LongType()),
    T.StructField("osm_id", T.LongType()),
    T.StructField("class_id", T.ShortType()),
    T.StructField("source", T.LongType()),
    T.StructField("target", T.LongType()),
    T.StructField("length", T.FloatType()),
    T.StructField("reverse_cost", T.DoubleType()),
    T.StructField("maxspeed_forward", T.FloatType()),
    T.StructField("maxspeed_backward", T.FloatType()),
    T.StructField("priority", T.FloatType()),
    T.StructField("geom", T.BinaryType()),
])

ROAD_CLASS_SCHEMA = "class_id smallint, priority double, maxspeed int"


def _wkb_number(digits: Column, at: Column, size: int, little: Column) -> Column:
    """Hex digits of ``size`` bytes that begin at byte ``at``, the most significant first."""
    byte = lambda k: F.substring(digits, 2 * (at + k) + 1, F.lit(2))
    return F.when(little, F.concat(*[byte(k) for k in reversed(range(size))])).otherwise(F.substring(digits, 2 * at + 1, F.lit(2 * size)))


def _wkb_double(bits: Column) -> Column:
    """The number that 16 hex digits of IEEE 754 stand for; null where that is none. Every step is exact."""
    head = F.conv(F.substring(bits, 1, 3), 16, 10).cast("int")
    power = head % 2048
    part = F.conv(F.substring(bits, 4, 13), 16, 10).cast("bigint").cast("double") / 2.0**52
    size = F.when(power == 0, part * F.pow(F.lit(2.0), F.lit(-1022.0))).when(power < 2047, (1 + part) * F.pow(F.lit(2.0), (power - 1023).cast("double")))
    return F.when(head >= 2048, -size).otherwise(size)


def parse_wkb_line(geom: Column | str) -> Column:
    """Vertices of WKB LINESTRING values, either byte order; null for another shape, for cut values and for what is no number."""
    raw = F.col(geom) if isinstance(geom, str) else geom
    digits, little = F.hex(raw), F.hex(F.substring(raw, 1, 1)) == "01"
    whole = lambda at: F.conv(_wkb_number(digits, F.lit(at), 4, little), 16, 10).cast("bigint")
    double = lambda at: _wkb_double(_wkb_number(digits, at, 8, little))
    place = lambda n: (9 + 16 * n).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.greatest(whole(5) - 1, F.lit(0)).cast("int")), lambda n: F.struct(
        double(place(n)).alias("lon"), double(place(n) + 8).alias("lat")))
    sound = (F.length(raw) >= 9) & (whole(1) == 2) & (whole(5) > 0) & (F.length(raw) >= 9 + 16 * whole(5))
    return F.when(sound, F.when(F.forall(points, lambda v: v.lon.isNotNull() & v.lat.isNotNull()), points))


def parse_wkt_line(text: Column) -> Column:
    body = F.regexp_extract(text, r"LINESTRING\s*\((.*)\)", 1)
    return F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(
            F.split(p, r"\s+")[0].cast("double").alias("lon"),
            F.split(p, r"\s+")[1].cast("double").alias("lat"),
        ),
    )


def read_ways(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan of the road table; ``fmt="jdbc"`` takes the caller's connection options."""
    reader = spark.read.format(fmt).options(**options)
    ways = reader.load() if fmt == "jdbc" else reader.schema(WAYS_SCHEMA).load(path)
    return ways.select(*WAYS_SCHEMA.fieldNames()).withColumn("points", parse_wkb_line("geom")).drop("geom")


def default_road_classes(spark: SparkSession) -> DataFrame:
    rows = [(c, p, ROAD_CLASS_MAXSPEED) for c, p in ROAD_CLASS_PRIORITY]
    return spark.createDataFrame(rows, ROAD_CLASS_SCHEMA)


def read_road_classes(spark: SparkSession, path: str) -> DataFrame:
    return flatten_road_classes(spark.read.text(path, wholetext=True))


def flatten_road_classes(documents: DataFrame) -> DataFrame:
    """Rows from ``{tags:[{values:[{id,priority,maxspeed}]}]}`` in column ``value``."""
    shape = "struct<tags:array<struct<values:array<struct<id:smallint,priority:double,maxspeed:int>>>>>"
    return (
        documents.select(F.explode(F.from_json("value", shape).tags).alias("tag"))
        .select(F.explode("tag.values").alias("v"))
        .select(F.col("v.id").alias("class_id"), "v.priority", "v.maxspeed")
    )


def base_roads(ways: DataFrame, road_class: DataFrame, excluded: tuple[int, ...] = ()) -> DataFrame:
    """Ways of configured classes with speed, priority and direction settled.

    Speed falls back to the class when missing; priority is always the class's.
    """
    kept = ways.filter(~F.col("class_id").isin(*excluded)) if excluded else ways
    classes = road_class.select("class_id", F.col("priority").alias("class_priority"), "maxspeed")
    return kept.join(classes, "class_id").select(
        F.col("gid").alias("base_gid"), "osm_id", "class_id", "source", "target",
        (F.col("reverse_cost") < 0).alias("oneway"),
        (F.col("reverse_cost") * 1000).alias("reverse_cost_m"),
        F.col("class_priority").alias("priority"),
        F.coalesce(F.col("maxspeed_forward").cast("double"), F.col("maxspeed").cast("double")).alias("speed_forward"),
        F.coalesce(F.col("maxspeed_backward").cast("double"), F.col("maxspeed").cast("double")).alias("speed_backward"),
        geo.polyline_length(F.col("points")).alias("length_m"),
        "points",
    )


def with_bounds(roads: DataFrame) -> DataFrame:
    """Box columns, stored so that a spatial filter reaches the scan."""
    lons, lats = F.col("points.lon"), F.col("points.lat")
    return roads.select(
        "*",
        F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"),
        F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"),
    )


def in_box(roads: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Roads whose box touches ``(min_lon, min_lat, max_lon, max_lat)``."""
    return roads.filter(
        (F.col("max_lon") >= box[0]) & (F.col("max_lat") >= box[1])
        & (F.col("min_lon") <= box[2]) & (F.col("min_lat") <= box[3])
    )


def _point_inside(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1) if y2 != y1 else 0.0)
        crossings = crossings + F.when(straddles & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _leg_crosses(leg: Column, ring: list[tuple[float, float]]) -> Column:
    hit = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        c1, c2 = (F.lit(float(x1)), F.lit(float(y1))), (F.lit(float(x2)), F.lit(float(y2)))
        hit = hit | (
            (_side(leg.a.lon, leg.a.lat, leg.b.lon, leg.b.lat, *c1) * _side(leg.a.lon, leg.a.lat, leg.b.lon, leg.b.lat, *c2) <= 0)
            & (_side(*c1, *c2, leg.a.lon, leg.a.lat) * _side(*c1, *c2, leg.b.lon, leg.b.lat) <= 0)
        )
    return hit


def in_polygon(roads: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Roads inside or overlapping a polygon: box first, then the exact test."""
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    boxed = in_box(roads, (min(lons), min(lats), max(lons), max(lats)))
    exact = F.exists("points", lambda p: _point_inside(p.lon, p.lat, ring)) | F.exists(
        geo.legs(F.col("points")), lambda leg: _leg_crosses(leg, ring)
    )
    return boxed.filter(exact)


def class_history(history: DataFrame) -> DataFrame:
    return history.groupBy("class_id", "seq").agg(F.avg("average_speed").alias("average_speed"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("gid", "seq", "base_gid", "length", "class_id", "time", "average_speed")


def restrict_to(roads: DataFrame, listed: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Roads on a list (``keep``) or off it, e.g. overpasses."""
    return roads.join(listed, key, "left_semi" if keep else "left_anti")
