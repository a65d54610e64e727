"""Density clusters in the plane, on a line and on a ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions import scalar as S
from roadpulse.operators.spatial import point_pairs
from roadpulse.plans.components import connected_components
from roadpulse.plans.lineage import cut
from roadpulse.plans.sorted_scan import SortedScan


# -- roads ---------------------------------------------------------------------

def road_components(roads: DataFrame) -> DataFrame:
    """Component of each directed road.

    Roads hang together when they leave the same node or one follows the other,
    so a road belongs to its source node, and joins its target node's roads if
    any leave there. Components are found on nodes and named by their smallest road.
    """
    names = roads.groupBy(F.col("source").alias("node")).agg(F.min("id").alias("least"))
    links = roads.select(F.col("source").alias("a"), F.col("target").alias("b")).join(
        names.select(F.col("node").alias("b")), "b", "left_semi"
    )
    found = connected_components(names.select("node"), links)
    named = found.join(names, "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("name"))
    by_node = named.join(smallest, "component").select(F.col("node").alias("source"), F.col("name").alias("component"))
    return roads.select("id", "source").join(by_node, "source").select("id", "component")


# -- plane ---------------------------------------------------------------------

def density_clusters(points: DataFrame, epsilon: float, minimum: int) -> DataFrame:
    """Clusters of distinct positions ``id, lon, lat``; noise is left out.

    A border position belongs to its nearest core, ties to the smaller id.
    """
    pairs = cut(point_pairs(points, epsilon))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    cores = cut(
        points.select("id").join(degree.withColumnRenamed("a", "id"), "id", "left")
        .filter(F.coalesce("n", F.lit(0)) + 1 >= minimum).select("id")
    )
    core_pairs = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    labels = connected_components(cores.withColumnRenamed("id", "node"), core_pairs.select("a", "b"))
    labels = labels.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    border = (
        both.join(cores.withColumnRenamed("id", "a"), "a", "left_anti")
        .join(labels.withColumnRenamed("id", "b"), "b")
        .groupBy("a").agg(F.min_by("cluster", F.struct("dist", "b")).alias("cluster"))
    )
    return labels.withColumn("core", F.lit(True)).unionByName(
        border.select(F.col("a").alias("id"), "cluster", F.lit(False).alias("core"))
    )


# -- line and ring ----------------------------------------------------------------

def distinct_values(values: DataFrame, column: str = "x") -> DataFrame:
    return values.groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def ring_values(values: DataFrame, modulo: float, column: str = "x") -> DataFrame:
    return distinct_values(values.select(S.ring_round(S.ring_modulo(F.col(column), modulo)).alias("x")))


def line_counts(values: DataFrame, epsilon: float) -> DataFrame:
    """Number of elements in the closed range around each distinct value.

    The range ends are merged with the values in one sorted scan: the count is
    the difference of two running sums, so no pairs are formed.
    """
    marks = F.array(
        F.struct((F.col("x") - epsilon).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("w")),
        F.struct(F.col("x").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("w")),
        F.struct((F.col("x") + epsilon).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("w")),
    )
    events = values.select(F.col("x").alias("owner"), F.explode(marks).alias("e")).select("owner", "e.*")
    summed = SortedScan(events, ["at", "kind", "owner"]).running_sum("w", "upto").result()
    sign = F.when(F.col("kind") == 2, F.col("upto")).when(F.col("kind") == 0, -F.col("upto")).otherwise(0)
    return summed.groupBy(F.col("owner").alias("x")).agg(F.sum(sign).alias("neighbours"))


def ring_counts(values: DataFrame, epsilon: float, modulo: float) -> DataFrame:
    """As :func:`line_counts`, with the ends of the range joined."""
    radius = min(epsilon, modulo / 2)
    turns = F.explode(F.array(*[F.lit(float(k * modulo)) for k in (-1, 0, 1)]))
    spread = values.select("x", "n", turns.alias("turn"))
    spread = spread.select((F.col("x") + F.col("turn")).alias("x"), "n", F.col("x").alias("home"), "turn").filter(
        F.col("x").between(-radius - 1, modulo + radius + 1)
    )
    counted = line_counts(spread.select("x", "n"), radius)
    return counted.join(spread.filter(F.col("turn") == 0).select("x"), "x")


def _sessions(values: DataFrame, epsilon: float) -> DataFrame:
    """Values with the cores around them and the first core of their run."""
    scan = SortedScan(values, ["x"]).define("core_x", F.when(F.col("core"), F.col("x")))
    scan = scan.running_max("core_x", "core_before", until=-1)
    starts = F.col("core") & (F.col("core_before").isNull() | (F.col("x") - F.col("core_before") > epsilon))
    scan = scan.define("start_x", F.when(starts, F.col("x"))).running_max("start_x", "run").following_min("core_x", "core_after")
    return scan.result()


def _label(rows: DataFrame, epsilon: float) -> DataFrame:
    left = F.col("x") - F.col("core_before")
    right = F.col("core_after") - F.col("x")
    next_run = F.when(
        F.col("core_before").isNotNull() & (F.col("core_after") - F.col("core_before") <= epsilon), F.col("run")
    ).otherwise(F.col("core_after"))
    near_left = left <= epsilon
    near_right = right <= epsilon
    cluster = (
        F.when(F.col("core"), F.col("run"))
        .when(near_left & (F.coalesce(left <= right, F.lit(True))), F.col("run"))
        .when(near_right, next_run)
    )
    return rows.withColumn("cluster", cluster).filter(F.col("cluster").isNotNull())


def line_clusters(values: DataFrame, epsilon: float, minimum: int, counts: DataFrame | None = None) -> DataFrame:
    """Clusters of numbers, named by their smallest core; noise is left out."""
    counts = line_counts(values, epsilon) if counts is None else counts
    flagged = counts.select("x", (F.col("neighbours") >= minimum).alias("core"))
    return _label(_sessions(flagged, epsilon), epsilon).select("x", "core", "cluster")


def ring_clusters(values: DataFrame, epsilon: float, minimum: int, modulo: float, counts: DataFrame | None = None) -> DataFrame:
    """Clusters on a ring: the last run continues in the first across zero."""
    counts = ring_counts(values, epsilon, modulo) if counts is None else counts
    flagged = counts.select("x", (F.col("neighbours") >= minimum).alias("core"))
    rows = _sessions(flagged, epsilon)
    one = F.lit(1).alias("k")
    ends = rows.agg(
        F.min("core_x").alias("first_core"), F.max("core_x").alias("last_core"), F.max("start_x").alias("last_run")
    ).select("*", one)
    # ``ends`` is a single row.
    rows = rows.select("*", one).join(F.broadcast(ends), "k").drop("k")
    joined = F.col("first_core") + modulo - F.col("last_core") <= epsilon
    rows = rows.withColumn("run", F.when(F.col("core_before").isNull() & ~F.col("core"), F.col("last_run")).otherwise(F.col("run")))
    rows = rows.withColumn("core_before", F.coalesce("core_before", F.col("last_core") - modulo))
    wrapped_after = F.col("core_after").isNull()
    rows = rows.withColumn("core_after", F.coalesce("core_after", F.col("first_core") + modulo))
    left, right = F.col("x") - F.col("core_before"), F.col("core_after") - F.col("x")
    next_run = F.when(F.col("core_after") - F.col("core_before") <= epsilon, F.col("run")).when(
        wrapped_after, F.col("first_core")
    ).otherwise(F.col("core_after"))
    cluster = (
        F.when(F.col("core"), F.col("run"))
        .when((left <= epsilon) & (left <= right), F.col("run"))
        .when(right <= epsilon, next_run)
    )
    merged = F.when(joined & (F.col("cluster") == F.col("first_core")), F.col("last_run")).otherwise(F.col("cluster"))
    return rows.withColumn("cluster", cluster).filter(F.col("cluster").isNotNull()).select("x", "core", merged.alias("cluster"))


def ring_bounds(clusters: DataFrame, epsilon: float, modulo: float, buffer: float = 0.0) -> DataFrame:
    """Left and right border of each cluster on the ring.

    The widest gap between neighbours that exceeds ``epsilon`` is outside the
    cluster. A cluster that fills the ring has no borders.
    """
    ends = clusters.groupBy("cluster").agg(F.max("x").alias("hi"), F.count(F.lit(1)).alias("size"))
    scan = SortedScan(clusters.select("cluster", "x"), ["cluster", "x"])
    scan = scan.define("here", F.struct("cluster", "x")).running_max("here", "before", until=-1)
    rows = scan.result().join(ends, "cluster")
    same = F.coalesce(F.col("before.cluster") == F.col("cluster"), F.lit(False))
    previous = F.when(same, F.col("before.x")).otherwise(F.col("hi"))
    rows = rows.select("cluster", "x", "size", previous.alias("p"), S.ring_distance(previous, F.col("x"), modulo).alias("gap"))
    outside = (F.col("gap") > epsilon) | (F.col("size") == 1)
    widest = F.when(outside, F.struct("gap", (-F.col("x")).alias("o")))
    found = rows.groupBy("cluster").agg(F.max_by(F.struct("p", "x"), widest).alias("w"))
    ring = lambda c: S.ring_round(S.ring_modulo(c, modulo))
    return found.select("cluster", ring(F.col("w.x") - buffer).alias("left"), ring(F.col("w.p") + buffer).alias("right"))


def density_steps(values: DataFrame, epsilon: float, modulo: float, buffer: float = 0.0) -> DataFrame:
    """Step function of density over the ring on a doubling scale.

    Level 1, 2, 4, ... is clustered as long as clusters are found. A step up
    starts at a left border, a step down at a right border.
    """
    counts = cut(ring_counts(values, epsilon, modulo))
    most = counts.agg(F.max("neighbours")).first()[0] or 0
    level, parts = 1, []
    while level <= most:
        found = ring_clusters(values, epsilon, level, modulo, counts)
        parts.append(ring_bounds(found, epsilon, modulo, buffer).withColumn("level", F.lit(level)))
        level *= 2
    if not parts:
        return values.sparkSession.createDataFrame([(0.0, 0)], "x double, y int")
    bounds = parts[0]
    for part in parts[1:]:
        bounds = bounds.unionByName(part)
    bounds = cut(bounds)
    floor = bounds.filter(F.col("left").isNull()).agg(F.coalesce(F.max("level"), F.lit(0)).alias("floor")).first()[0]
    known = bounds.filter(F.col("left").isNotNull())
    starts = known.groupBy(F.col("left").alias("x")).agg(F.max("level").alias("y"))
    stops = known.groupBy(F.col("right").alias("x")).agg(F.min(F.floor(F.col("level") / 2).cast("int")).alias("y"))
    if buffer:
        stops = stops.join(starts.select("x"), "x", "left_anti")
    steps = starts.withColumn("up", F.lit(1)).unionByName(stops.withColumn("up", F.lit(0)))
    steps = steps.select("x", F.greatest("y", F.lit(floor)).alias("y"), "up")
    last = steps.agg(F.max(F.struct("x", (-F.col("y")).alias("o"))).alias("m"), F.min("x").alias("first")).first()
    if last["first"] is None:
        return values.sparkSession.createDataFrame([(0.0, int(floor))], "x double, y int")
    if abs(last["first"]) >= S.RING_EPSILON:
        zero = values.sparkSession.createDataFrame([(0.0, max(int(floor), -int(last["m"]["o"])), 1)], "x double, y int, up int")
        steps = steps.unionByName(zero)
    return steps.select("x", "y")
