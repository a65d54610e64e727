"""Joins of points with roads and with each other, on a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.plans.lineage import cut
from roadpulse.plans.sized import broadcast_if_small

DEGREE = 110500.0  # below the metres per degree of latitude anywhere


def road_segments(base: DataFrame) -> DataFrame:
    """Straight legs of each road with the length that lies before them."""
    legs = base.select(
        "base_gid", "oneway", "length_m", F.posexplode(geo.legs(F.col("points"))).alias("leg", "s")
    ).select(
        "base_gid", "oneway", "length_m", "leg",
        F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"),
        F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"), F.col("s.length").alias("leg_length"),
    )
    # A road has few vertices.
    before = Window.partitionBy("base_gid").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("before", F.coalesce(F.sum("leg_length").over(before), F.lit(0.0)))


def cell_size(radius: float) -> float:
    return max(0.002, 2 * radius / DEGREE)


def _cover(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """One row per cell that a segment widened by ``radius`` touches."""
    dy = F.lit(radius / DEGREE)
    dx = dy / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2")) + dy)) * 1.01
    span = lambda a, b, d: F.sequence(
        F.floor((F.least(a, b) - d) / size), F.floor((F.greatest(a, b) + d) / size)
    )
    wide = segments.withColumn("cx", F.explode(span(F.col("lon1"), F.col("lon2"), dx)))
    return wide.withColumn("cy", F.explode(span(F.col("lat1"), F.col("lat2"), dy)))


def _cell(lon: str, lat: str, size: float) -> list[Column]:
    return [F.floor(F.col(lon) / size).alias("cx"), F.floor(F.col(lat) / size).alias("cy")]


class RoadCells:
    """The cells that roads widened by a radius touch. Built once and stored, they serve any number of joins.

    A cell lists each road once with its legs there; a road has few legs in a cell. Metrics differ by under one percent, so
    that much more is covered.
    """

    def __init__(self, segments: DataFrame, radius: float):
        self.radius, self.size = radius, cell_size(radius)
        legs = F.collect_list(F.struct("leg", "lon1", "lat1", "lon2", "lat2", "before", "leg_length"))
        covered = cut(_cover(segments, radius * 1.01, self.size).groupBy("cx", "cy", "base_gid", "oneway", "length_m").agg(legs.alias("legs")))
        # Stored, so that its size is checked once.
        self.covered = broadcast_if_small(covered)


def base_radius(samples: DataFrame, segments: DataFrame | RoadCells, radius: float, keys: list[str], metric: str = "planar") -> DataFrame:
    """Closest point of every road nearer than ``radius`` to each sample; ``segments`` may be cells made for that radius.

    The closest point of a leg is found on the plane; its distance is that of ``metric`` ("planar" or "haversine").

    A cell lists each road once with its legs there, so the closest leg is found inside the joined row: candidates are
    neither sorted nor shuffled.
    """
    cells = segments if isinstance(segments, RoadCells) else RoadCells(segments, radius)
    if cells.radius != radius:
        raise ValueError(f"cells are made for {cells.radius} m, not {radius} m")
    covered, size = cells.covered, cells.size
    # Dealt by sample before the join: its candidates then lie together, and groupings by sample need no exchange.
    points = samples.select(*keys, "lon", "lat", *_cell("lon", "lat", size)).repartition(*keys)
    kx, ky = geo.metres_per_degree(F.col("lat"))
    near = points.withColumn("kx", kx).withColumn("ky", ky).join(covered, ["cx", "cy"])

    return _closest(near, keys, metric).filter(F.col("dist") < radius)


def _closest(near: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Closest point of the road in each row of samples (``lon, lat, kx, ky``) with roads (``legs``)."""

    def projected(leg: Column) -> Column:
        dx, dy = (leg.lon2 - leg.lon1) * F.col("kx"), (leg.lat2 - leg.lat1) * F.col("ky")
        px, py = (F.col("lon") - leg.lon1) * F.col("kx"), (F.col("lat") - leg.lat1) * F.col("ky")
        norm = dx * dx + dy * dy
        return F.struct(leg.alias("l"), geo.clamp01(F.when(norm > 0, (px * dx + py * dy) / norm).otherwise(F.lit(0.0))).alias("t"))

    def placed(p: Column) -> Column:
        x, y = geo.interpolate_segment(p.l.lon1, p.l.lat1, p.l.lon2, p.l.lat2, p.t)
        if metric == "planar":
            dist = F.hypot((x - F.col("lon")) * F.col("kx"), (y - F.col("lat")) * F.col("ky"))
        else:
            dist = geo.distance(F.col("lon"), F.col("lat"), x, y, metric)
        return F.struct(dist.alias("dist"), p.l.leg.alias("leg"),
                        (p.l.before + p.t * p.l.leg_length).alias("along"), x.alias("x"), y.alias("y"))

    best = near.select(*keys, "base_gid", "oneway", "length_m", F.array_min(F.transform(F.transform("legs", projected), placed)).alias("best"))
    return best.select(
        *keys, "base_gid", (F.col("best.along") / F.col("length_m")).alias("fraction"), F.col("best.x").alias("lon"), F.col("best.y").alias("lat"),
        F.col("best.dist").alias("dist"), "oneway")


def both_directions(found: DataFrame) -> DataFrame:
    """Directed candidates; the way back has the complementary fraction."""
    ahead = F.struct((F.col("base_gid") * 2).alias("road_id"), F.col("fraction"))
    back = F.struct((F.col("base_gid") * 2 + 1).alias("road_id"), (1 - F.col("fraction")).alias("fraction"))
    rest = [c for c in found.columns if c not in ("base_gid", "fraction", "oneway")]
    return found.select(*rest, F.explode(F.when(F.col("oneway"), F.array(ahead)).otherwise(F.array(ahead, back))).alias("d")).select(
        *rest, "d.road_id", "d.fraction"
    )


def radius_candidates(samples: DataFrame, base: DataFrame | RoadCells, radius: float, keys: list[str], metric: str = "planar") -> DataFrame:
    return both_directions(base_radius(samples, base if isinstance(base, RoadCells) else road_segments(base), radius, keys, metric))


#: Cells along each side of a cell of the next level, as bits.
_SHIFT = 2


class RoadTree:
    """Roads in a hierarchy of cells, each with the box around its roads and their number. Built once, it serves any number of searches.

    A road lies in the cell of its first point; boxes hold whole roads, so a cell's box may be larger than the cell.
    """

    def __init__(self, base: DataFrame, size: float = 0.002):
        legs = road_segments(base)
        box = [F.min(F.least("lon1", "lon2")).alias("west"), F.max(F.greatest("lon1", "lon2")).alias("east"),
               F.min(F.least("lat1", "lat2")).alias("south"), F.max(F.greatest("lat1", "lat2")).alias("north")]
        leg = F.struct("leg", "lon1", "lat1", "lon2", "lat2", "before", "leg_length")
        roads = cut(legs.groupBy("base_gid", "oneway", "length_m").agg(F.collect_list(leg).alias("legs"), F.min_by("lon1", "leg").alias("lon"), F.min_by("lat1", "leg").alias("lat"), *box))
        west, south = roads.agg(F.min("lon"), F.min("lat")).first()
        self.roads = roads.withColumn("px", F.floor((F.col("lon") - (west or 0.0)) / size)).withColumn("py", F.floor((F.col("lat") - (south or 0.0)) / size)).drop("lon", "lat")
        #: From single cells up to one; ``px, py`` name the cell above.
        self.levels: list[DataFrame] = []
        inner = [F.min("west").alias("west"), F.max("east").alias("east"), F.min("south").alias("south"), F.max("north").alias("north")]
        cells = self.roads.withColumn("n", F.lit(1).cast("long")).select("px", "py", "west", "east", "south", "north", "n")
        while True:
            grouped = cells.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(*inner, F.sum("n").alias("n"))
            level = cut(grouped.withColumn("px", F.shiftright("x", _SHIFT)).withColumn("py", F.shiftright("y", _SHIFT)))
            self.levels.append(broadcast_if_small(level))
            if level.limit(2).count() < 2:
                return
            cells = level


def _box_bounds(metric: str) -> tuple[Column, Column]:
    """Least and largest distance from a sample to a point of the box ``west .. north``."""
    lon, lat = F.col("lon"), F.col("lat")
    gap = lambda v, a, b: F.greatest(F.col(a) - v, v - F.col(b), F.lit(0.0))
    far = lambda v, a, b: F.greatest(F.abs(F.col(a) - v), F.abs(F.col(b) - v))
    if metric == "planar":
        bound = lambda side: F.hypot(side(lon, "west", "east") * F.col("kx"), side(lat, "south", "north") * F.col("ky"))
        return bound(gap), bound(far)
    # Each part of the haversine formula is taken at its least and its largest value in the box.
    half = lambda degrees: F.pow(F.sin(F.radians(F.least(degrees, F.lit(180.0)) / 2)), 2)
    wide = F.cos(F.radians(F.when((F.col("south") <= 0) & (F.col("north") >= 0), 0.0).otherwise(F.least(F.abs("south"), F.abs("north")))))
    narrow = F.cos(F.radians(F.greatest(F.abs("south"), F.abs("north"))))
    around = lambda degrees: F.least(degrees, F.greatest(360.0 - degrees, F.lit(0.0)))
    total = lambda y, x, across: 2 * geo.MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(half(y) + F.cos(F.radians(lat)) * across * half(x))))
    west_east = F.least(gap(lon, "west", "east"), around(far(lon, "west", "east")))
    return total(gap(lat, "south", "north"), west_east, narrow) * 0.99, total(far(lat, "south", "north"), far(lon, "west", "east"), wide) * 1.01


def _best_first(samples: DataFrame, tree: RoadTree, k: int, keys: list[str], metric: str) -> DataFrame:
    """Roads that may be among the ``k`` nearest of each sample, with their closest points.

    Cells are opened level by level. One is left closed when its box lies farther away than the farthest points of nearer
    boxes that hold ``k`` roads together, so a sample meets the roads near its nearest ones, however far off it lies.
    """
    least, largest = _box_bounds(metric)
    by_far = Window.partitionBy(*keys).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    kx, ky = geo.metres_per_degree(F.col("lat"))
    point = [*keys, "lon", "lat", "kx", "ky"]

    def opened(frontier: DataFrame, below: DataFrame) -> DataFrame:
        # The open cells of a sample are few: those around its nearest roads.
        met = frontier.join(below, ["px", "py"]).withColumn("near", least).withColumn("far", largest)
        enough = met.withColumn("held", F.sum("n").over(by_far)).withColumn("limit", F.min(F.when(F.col("held") >= k, F.col("far"))).over(whole))
        return enough.filter(F.col("limit").isNull() | (F.col("near") * (1 - 1e-12) <= F.col("limit")))

    frontier = samples.select(*keys, "lon", "lat").repartition(*keys).withColumn("kx", kx).withColumn("ky", ky).select(*point, F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))
    for level in tree.levels[-2::-1]:
        frontier = opened(frontier, level).select(*point, F.col("x").alias("px"), F.col("y").alias("py"))
    return _closest(opened(frontier, tree.roads.withColumn("n", F.lit(1))), keys, metric)


#: Metres around a sample that are looked at first.
NEARBY = 200.0


def _nearby_first(samples: DataFrame, base: DataFrame | RoadTree, k: int, keys: list[str], metric: str, choose) -> DataFrame:
    """``choose(found)`` of each sample, where ``found`` holds its ``k`` nearest roads and maybe others.

    With ``k`` roads nearer than NEARBY the nearest ones are among those, and one join finds them. Only the other samples walk
    the hierarchy, which is not built where there are none.
    """
    if isinstance(base, RoadTree):
        return choose(_best_first(samples, base, k, keys, metric))
    found = base_radius(samples, road_segments(base), NEARBY, keys, metric)
    enough = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_n") >= k).drop("_n")
    settled = cut(choose(enough))
    # A null key equals itself here.
    done = settled.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    rest = cut(samples.select(*keys, "lon", "lat").join(done, same, "left_anti"))
    if rest.isEmpty():
        return settled
    return settled.unionByName(choose(_best_first(rest, RoadTree(base), k, keys, metric)))


def _ranked(found: DataFrame, keys: list[str], order: list[str], fn) -> DataFrame:
    # Roads around one sample: few rows per window.
    return found.withColumn("place", fn.over(Window.partitionBy(*keys).orderBy(*order)))


def nearest(samples: DataFrame, base: DataFrame | RoadTree, keys: list[str], metric: str = "planar") -> DataFrame:
    """Nearest road of each sample, all ties kept."""
    closest = F.min("dist").over(Window.partitionBy(*keys))
    return _nearby_first(samples, base, 1, keys, metric, lambda found: found.withColumn("closest", closest).filter(F.col("dist") == F.col("closest")).drop("closest"))


def k_nearest(samples: DataFrame, base: DataFrame | RoadTree, k: int, keys: list[str], metric: str = "planar") -> DataFrame:
    """The ``k`` nearest roads of each sample, fewer when the map has fewer."""
    return _nearby_first(samples, base, k, keys, metric, lambda found: _ranked(found, keys, ["dist", "base_gid"], F.row_number()).filter(F.col("place") <= k))


def minimise(candidates: DataFrame, successors: DataFrame, keys: list[str]) -> DataFrame:
    """Drops candidates that another one already stands for.

    A candidate at the very start of a road goes when a road leading to it is a
    candidate too. A candidate at the very end goes when all roads after it are
    candidates that are not at their start. ``successors`` has a row a step, or an array ``next`` a road.
    """
    if "next" not in successors.columns:
        successors = broadcast_if_small(successors.groupBy("id").agg(F.collect_set("succ_id").alias("next")))
    rest = [c for c in candidates.columns if c not in keys]
    listed = candidates.join(successors, candidates.road_id == successors.id, "left").select(
        *candidates.columns, F.coalesce("next", F.expr("cast(array() as array<bigint>)")).alias("next")
    )
    grouped = listed.groupBy(*keys).agg(F.collect_list(F.struct(*rest, "next")).alias("cs"))
    cs = F.col("cs")
    starts = lambda c: (c.fraction == 0) & F.exists(cs, lambda o: F.array_contains(o.next, c.road_id))
    covered = lambda c: (c.fraction == 1) & F.forall(
        c.next, lambda s: F.exists(cs, lambda o: (o.road_id == s) & (o.fraction != 0))
    )
    kept = F.filter(cs, lambda c: ~starts(c) & ~covered(c))
    return grouped.select(*keys, F.inline(kept)).drop("next")


def point_pairs(points: DataFrame, epsilon: float, key: str = "id") -> DataFrame:
    """Pairs of points closer than ``epsilon`` metres, each pair once with a < b.

    ``points`` are distinct positions on the 1e-5 degree lattice of the data
    model, so a point has a bounded number of neighbours however many records
    share its position.
    """
    size = cell_size(epsilon) if epsilon > 50 else max(0.00002, epsilon / 70000.0)
    cells = points.select(F.col(key).alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), *_cell("lon", "lat", size))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    others = (
        points.select(F.col(key).alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *_cell("lon", "lat", size), around.alias("o"))
        .withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j")).drop("o")
    )
    dist = geo.planar(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return cells.join(others, ["cx", "cy"]).filter(F.col("a") < F.col("b")).withColumn("dist", dist).filter(
        F.col("dist") < epsilon
    ).select("a", "b", "dist")


def crossings(base: DataFrame) -> DataFrame:
    """Points where two roads cross away from a shared end."""
    size = cell_size(0.0)
    legs = road_segments(base).select("base_gid", "leg", "lon1", "lat1", "lon2", "lat2")
    covered = _cover(legs, 0.0, size)
    other = covered.select("cx", "cy", *[F.col(c).alias("o_" + c) for c in ("base_gid", "leg", "lon1", "lat1", "lon2", "lat2")])
    pairs = covered.join(other, ["cx", "cy"]).filter(F.col("base_gid") < F.col("o_base_gid")).drop("cx", "cy").distinct()
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    ex, ey = F.col("o_lon2") - F.col("o_lon1"), F.col("o_lat2") - F.col("o_lat1")
    wx, wy = F.col("o_lon1") - F.col("lon1"), F.col("o_lat1") - F.col("lat1")
    cross = dx * ey - dy * ex
    t = (wx * ey - wy * ex) / cross
    u = (wx * dy - wy * dx) / cross
    inner = lambda v: (v > 1e-9) & (v < 1 - 1e-9)
    return pairs.withColumn("cross", cross).filter(F.abs("cross") > 1e-18).withColumn("t", t).withColumn("u", u).filter(
        inner(F.col("t")) & inner(F.col("u"))
    ).select(
        "base_gid", F.col("o_base_gid").alias("other_gid"),
        (F.col("lon1") + F.col("t") * dx).alias("lon"), (F.col("lat1") + F.col("t") * dy).alias("lat"),
    )
