"""Directed roads, their topology, initial state and paths over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.params import TrafficParams


def split_directions(base: DataFrame) -> DataFrame:
    """Directed roads: id 2g along the geometry, 2g+1 against it unless one-way."""
    shared = ["base_gid", "class_id", "priority", "length_m"]
    both = F.array(
        F.struct(F.lit(True).alias("forward"), F.col("source"), F.col("target"), F.col("speed_forward").alias("maxspeed")),
        F.struct(F.lit(False).alias("forward"), F.col("target").alias("source"), F.col("source").alias("target"), F.col("speed_backward").alias("maxspeed")),
    )
    usable = F.when(F.col("oneway"), F.slice(both, 1, 1)).otherwise(both)
    one = base.select(*shared, "points", F.explode(usable).alias("d"))
    return one.select(
        S.directed_id(F.col("base_gid"), F.col("d.forward")).alias("id"),
        "base_gid", F.col("d.forward").alias("forward"), F.col("d.source").alias("source"), F.col("d.target").alias("target"),
        "class_id", "priority", F.col("d.maxspeed").alias("maxspeed"), "length_m",
        F.when(F.col("d.forward"), F.col("points")).otherwise(geo.reverse_polyline(F.col("points"))).alias("points"),
    )


def successors(roads: DataFrame) -> DataFrame:
    """Road pairs where the second starts at the node the first ends in."""
    a = roads.select("id", F.col("target").alias("node"))
    b = roads.select(F.col("id").alias("succ_id"), F.col("source").alias("node"))
    return a.join(b, "node").select("id", "succ_id")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges plus those of ``more`` with new ids."""
    return edges.unionByName(more.join(edges, "id", "left_anti"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, "id", "left_anti")


def initial_state(roads: DataFrame, history: DataFrame, class_history: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Road speed at the start: own history of the last slice, class mean, default."""
    own = history.filter(F.col("seq") == 288).select(F.col("gid").alias("id"), F.col("average_speed").alias("own"))
    by_class = class_history.filter(F.col("seq") == 288).select("class_id", F.col("average_speed").alias("of_class"))
    speed = F.coalesce(
        F.when(F.col("own") > 0, F.col("own")),
        F.when(F.col("of_class") > 0, F.col("of_class")),
        F.lit(p.default_speed),
    )
    return (
        roads.join(own, "id", "left")
        .join(by_class, "class_id", "left")
        .select(
            F.col("id").alias("gid"), "base_gid", "class_id", F.col("length_m").alias("length"),
            S.road_limit(F.col("maxspeed"), p).alias("max_speed"),
            F.greatest(F.lit(p.min_speed), speed).alias("avg_speed"),
        )
        .withColumn("time", F.col("length") / F.col("avg_speed"))
    )


def with_cost(roads: DataFrame, cost="time_priority") -> DataFrame:
    """Adds ``cost``; a name of :data:`scalar.COSTS` or a function of three Columns."""
    fn = S.COSTS[cost] if isinstance(cost, str) else cost
    return roads.withColumn("cost", fn(F.col("length_m"), F.col("maxspeed"), F.col("priority")))


# -- paths: (path_id..., road array, start fraction, end fraction) -----------

def explode_path(paths: DataFrame, keys: list[str]) -> DataFrame:
    return paths.select(
        *keys, "start_fraction", "end_fraction", F.size("path").alias("steps"),
        F.posexplode("path").alias("pos", "id"),
    )


def path_totals(paths: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """Cost, length and free-flow time of paths that start and end inside roads."""
    priced = with_cost(roads).withColumn("seconds", S.cost_time(F.col("length_m"), F.col("maxspeed"), F.col("priority")))
    parts = explode_path(paths, keys).join(priced.select("id", "cost", "length_m", "seconds"), "id")
    share = (
        F.lit(1.0)
        - F.when(F.col("pos") == 0, F.col("start_fraction")).otherwise(0.0)
        - F.when(F.col("pos") == F.col("steps") - 1, 1 - F.col("end_fraction")).otherwise(0.0)
    )
    return parts.groupBy(*keys).agg(
        F.sum(share * F.col("cost")).alias("cost"),
        F.sum(share * F.col("length_m")).alias("length_m"),
        F.sum(share * F.col("seconds")).alias("seconds"),
    )


def invalid_paths(paths: DataFrame, succ: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of paths with a step that is no successor, or a backward move on one road."""
    backward = paths.filter((F.size("path") == 1) & (F.col("end_fraction") < F.col("start_fraction"))).select(*keys)
    n = F.size("path")
    steps = paths.filter(n > 1).select(
        *keys,
        F.explode(F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("id"), F.slice("path", F.lit(2), n - 1).alias("succ_id"))).alias("s"),
    ).select(*keys, "s.id", "s.succ_id")
    broken = steps.join(succ, ["id", "succ_id"], "left_anti").select(*keys)
    return backward.unionByName(broken).distinct()


def join_paths(left_path: Column, right_path: Column, left_end: Column, right_start: Column) -> Column:
    """Concatenation when the second path continues where the first stops, else NULL.

    They meet on one road at one fraction, or the first ends a road at 1 and
    the second starts the next at 0.
    """
    last, first = F.element_at(left_path, -1), F.element_at(right_path, 1)
    same = (last == first) & (left_end == right_start)
    return F.when(same, F.concat(left_path, F.slice(right_path, F.lit(2), F.greatest(F.size(right_path) - 1, F.lit(0))))).when(
        (last != first) & (left_end == 1) & (right_start == 0), F.concat(left_path, right_path)
    )


def path_texts(path: Column, lengths: Column) -> tuple[Column, Column]:
    """Comma-joined road ids and rounded lengths."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ","), F.array_join(
        F.transform(lengths, lambda x: F.round(x, 3).cast("string")), ","
    )


def path_geometry(paths: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """Polyline of each path, clipped at both fractions.

    A path is bounded by the search radius, so one row gathers few vertices.
    """
    shapes = explode_path(paths, keys).join(roads.select("id", "points"), "id")
    start = F.when(F.col("pos") == 0, F.col("start_fraction")).otherwise(F.lit(0.0))
    stop = F.when(F.col("pos") == F.col("steps") - 1, F.col("end_fraction")).otherwise(F.lit(1.0))
    whole = (start == 0) & (stop == 1)
    clipped = F.when(whole, F.col("points")).otherwise(geo.clip_polyline(F.col("points"), start, stop))
    gathered = shapes.select(*keys, "pos", clipped.alias("part")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")
    )
    line = F.aggregate(
        F.col("parts"),
        F.expr("cast(array() as array<struct<lon:double,lat:double>>)"),
        lambda acc, x: F.concat(
            acc,
            F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == F.element_at(x.part, 1)), F.slice(x.part, F.lit(2), F.size(x.part)))
            .otherwise(x.part),
        ),
    )
    return gathered.select(*keys, line.alias("points"))
