"""Map matching with a hidden Markov model.

Candidates and routes do not depend on the model's state, so both are computed
for all samples as joins. Only the walk along each trace is sequential; it runs
on the few candidates of one vehicle and day.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.functions import scalar as S
from roadpulse.operators import spatial
from roadpulse.operators.routing import RoadTiles, fitting, step_routes
from roadpulse.params import MatchParams
from roadpulse.plans.lineage import cut
from roadpulse.plans.sized import broadcast_if_small

SAMPLE = ["suid", "date", "utc", "slon", "slat"]
TRACE = ["suid", "date"]


class MatchMap:
    """What matching reads of the roads, prepared once for any number of batches of samples."""

    def __init__(self, base: DataFrame, roads: DataFrame, successors: DataFrame, p: MatchParams = MatchParams()):
        self.cells = spatial.RoadCells(spatial.road_segments(base), p.radius)
        self.tiles = RoadTiles(roads, successors)
        edges = self.tiles.edges
        self.prices = broadcast_if_small(edges.select(F.col("id").alias("road_id"), F.col("cost").alias("road_cost"), F.col("length_m").alias("road_length")))
        self.following = broadcast_if_small(edges.filter(F.size("next") > 0).select("id", "next"))

    def candidates(self, samples: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
        """Reduced candidates of each sample with emission, road cost and length."""
        named = samples.select("suid", "date", "utc", F.col("lon").alias("slon"), F.col("lat").alias("slat"), "lon", "lat")
        kept = spatial.minimise(spatial.radius_candidates(named, self.cells, p.radius, SAMPLE), self.following, SAMPLE)
        return kept.join(self.prices, "road_id").withColumn("emission", S.emission(F.col("dist"), p))


def candidates(samples: DataFrame, base: DataFrame, roads: DataFrame, successors: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Reduced candidates of each sample with emission, road cost and length."""
    return MatchMap(base, roads, successors, p).candidates(samples, p)


def vectors(cands: DataFrame) -> DataFrame:
    """One row per sample that has candidates."""
    one = F.struct("road_id", "fraction", "lon", "lat", "dist", "emission", "road_cost", "road_length")
    return cands.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(one)).alias("cs"))


def with_predecessor(vecs: DataFrame) -> DataFrame:
    """Adds the roads of the previous sample with candidates; a trace is one vehicle and day."""
    w = Window.partitionBy(*TRACE).orderBy("utc")
    before = F.lag(F.struct("utc", "slon", "slat", F.transform("cs", lambda c: c.road_id).alias("roads"))).over(w)
    return vecs.withColumn("prev", before)


def with_routes(vecs: DataFrame, roads: DataFrame | RoadTiles, successors: DataFrame | None = None, p: MatchParams = MatchParams(), cost="time_priority") -> DataFrame:
    """Adds to each sample the usable routes from the previous sample's roads, cheapest first for each pair of places.

    A pair has several where a dearer one may be needed to stay within the bound. ``roads`` may be prepared tiles.
    """
    tiles = roads if isinstance(roads, RoadTiles) else RoadTiles(roads, successors, cost)
    known = vecs.withColumn(
        "straight",
        F.when(F.col("prev").isNotNull(), geo.planar(F.col("prev.slon"), F.col("prev.slat"), F.col("slon"), F.col("slat"))),
    )
    bound = S.search_bound((F.col("utc") - F.col("prev.utc")) * 1000, p)
    # No route is shorter than the way between its ends; a held candidate is off its sample by a road's length at most.
    near = F.col("straight") * 0.99 <= F.col("bound") + 2 * (p.radius + tiles.longest)
    steps = known.filter(F.col("prev").isNotNull()).select(
        *SAMPLE, "straight", F.col("prev.slon").alias("lon"), F.col("prev.slat").alias("lat"), bound.alias("bound"),
        F.col("prev.roads").alias("srcs"), F.transform("cs", lambda c: c.road_id).alias("tgts")).filter(near).drop("straight")
    return known.join(step_routes(steps, tiles, p.radius), SAMPLE, "left").select(*vecs.columns, "routes", "straight")


# -- the walk along one trace -----------------------------------------------------

def _emission(dist: float, p: MatchParams) -> float:
    var = p.sigma * p.sigma
    power = dist * dist if p.squared_emission else dist
    return math.exp(-power / (2 * var)) / math.sqrt(2 * math.pi * var)


def _flat_distance(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    mid = math.radians((lat1 + lat2) / 2)
    w = 1 - geo.ECC2 * math.sin(mid) ** 2
    unit = math.pi / 180 * geo.AXIS
    return math.hypot((lon2 - lon1) * unit * math.cos(mid) / math.sqrt(w), (lat2 - lat1) * unit * (1 - geo.ECC2) / (w * math.sqrt(w)))


def _leg(pred: dict, cand: dict, routes: dict, bound: float):
    """Cost, length and roads from one candidate point to another, if within the bound."""
    f, g = pred["fraction"], cand["fraction"]
    if pred["road"] == cand["road"] and g >= f:
        cost, length, path = (g - f) * cand["cost"], (g - f) * cand["length"], [cand["road"]]
    else:
        ends = (1 - f) * pred["length"] + g * cand["length"]
        # In order of cost, so the first that is short enough is the cheapest.
        inner = next((r for r in routes.get((pred["road"], cand["road"]), ()) if r[1] + ends <= bound), None)
        if inner is None:
            return None
        cost = (1 - f) * pred["cost"] + inner[0] + g * cand["cost"]
        length, path = inner[1] + ends, inner[2]
    return (cost, path) if length <= bound else None


def _log10(value: float) -> float:
    return math.log10(value) if value > 0 else -math.inf


def held_points(before: list[dict], sample: tuple[float, float], cands: list[dict], p: MatchParams) -> list[dict]:
    """Candidates, where one that would move backwards on the road of a predecessor takes the predecessor's point."""
    held = {c["road"]: c for c in before}
    points = []
    for c in cands:
        old = held.get(c["road"])
        if old is not None and c["fraction"] < old["fraction"]:
            dist = _flat_distance(sample[0], sample[1], old["lon"], old["lat"])
            c = {**c, "fraction": old["fraction"], "lon": old["lon"], "lat": old["lat"], "emission": _emission(dist, p)}
        points.append(c)
    return points


def move(pred: dict, c: dict, seconds: float, straight: float, routes: dict, p: MatchParams) -> tuple[float, list] | None:
    """Transition probability between two points and the roads in between, if there is a way within the bound."""
    leg = _leg(pred, c, routes, max(p.min_bound, min(p.max_distance, math.floor(seconds) * p.bound_speed)))
    if leg is None:
        return None
    beta = 1 / p.lam if p.lam else 2.0 * max(1.0, seconds * 1000) / 1000
    trans = math.exp(-max(0.0, leg[0] - straight / 60) / beta) / beta
    return (trans, leg[1]) if trans > 0 else None


def advance(before: list[dict], seconds: float | None, straight: float | None, sample: tuple[float, float], cands: list[dict], routes: dict, p: MatchParams) -> tuple[list[dict], bool]:
    """One step of the filter: surviving candidates of a sample and whether the chain broke.

    A candidate that would move backwards on the road of a predecessor takes the
    predecessor's point. Every survivor carries its filter probability, the log
    probability of the best sequence, the index of its predecessor and the roads
    in between.
    """
    points = held_points(before, sample, cands, p)
    result = []
    for c in points if before else ():
        total, best = 0.0, None
        for i, pred in enumerate(before):
            step = move(pred, c, seconds, straight, routes, p)
            if step is None:
                continue
            trans, path = step
            total += trans * pred["filt"]
            seq = pred["seq"] + math.log10(trans) + _log10(c["emission"])
            if best is None or seq > best[0]:
                best = (seq, i, path)
        if total * c["emission"] > 0:
            result.append({**c, "filt": total * c["emission"], "seq": best[0], "pred": best[1], "path": best[2]})
    broke = bool(before) and bool(points) and not result
    if not result:
        result = [
            {**c, "filt": c["emission"], "seq": _log10(c["emission"]), "pred": None, "path": None}
            for c in points if c["emission"] > 0
        ]
    norm = sum(c["filt"] for c in result)
    for c in result:
        c["filt"] /= norm
    return result, broke


def best_sequence(chain: list[list[dict]]) -> list[dict]:
    """Most likely candidates of a trace, from the last sample back."""
    chosen, at = [], None
    for vector in reversed(chain):
        if at is None:
            at = max(range(len(vector)), key=lambda i: vector[i]["seq"])
        chosen.append(vector[at])
        at = vector[at]["pred"]
    return chosen[::-1]


def unpack(row) -> tuple[list[dict], dict]:
    """Candidates and routes of one sample from its Arrow row."""
    cands = [
        dict(road=int(c["road_id"]), fraction=c["fraction"], lon=c["lon"], lat=c["lat"], emission=c["emission"],
             cost=c["road_cost"], length=c["road_length"])
        for c in row.cs
    ]
    routes: dict[tuple, list[tuple]] = {}
    for r in row.routes if row.routes is not None else ():
        inner = [int(x) for x in r["path"]]
        for src in map(int, r["srcs"]):
            for tgt in map(int, r["tgts"]):
                routes.setdefault((src, tgt), []).append((r["inner_cost"], r["inner_length"], [src, *inner, tgt]))
    for front in routes.values():
        front.sort(key=lambda label: label[0])
    return cands, routes


MATCH_SCHEMA = (
    "suid bigint, date string, utc bigint, slon double, slat double, road_id bigint, fraction double, lon double, lat double, "
    "filt double, seq double, path array<bigint>, broke boolean"
)


def _thinned(last: tuple | None, row, p: MatchParams) -> bool:
    """Whether a sample is too close to the last one in the state."""
    if last is None:
        return False
    far = _flat_distance(row.slon, row.slat, last[1], last[2]) if p.min_distance > 0 else 0.0
    return (p.min_distance > 0 and far < p.min_distance) or (p.min_interval > 0 and row.utc - last[0] < p.min_interval)


def decode_traces(routed: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Most likely position of every sample of each trace.

    A group is one vehicle's day of thinned samples, at most 8,640 rows.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, info, last = [], [], None
        for row in pdf.sort_values("utc").itertuples(index=False):
            cands, routes = unpack(row)
            seconds = None if last is None else float(row.utc - last)
            vector, broke = advance(chain[-1] if chain else [], seconds, row.straight, (row.slon, row.slat), cands, routes, p)
            if vector:
                chain.append(vector)
                info.append((row, broke))
                last = row.utc
        rows = [
            (r.suid, r.date, r.utc, r.slon, r.slat, c["road"], c["fraction"], c["lon"], c["lat"], c["filt"], c["seq"], c["path"], b)
            for (r, b), c in zip(info, best_sequence(chain))
        ]
        return pd.DataFrame(rows, columns=[part.split()[0] for part in MATCH_SCHEMA.split(", ")])

    n = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(n, *TRACE).groupBy(*TRACE).applyInPandas(walk, MATCH_SCHEMA)


def model_tables(routed: DataFrame, p: MatchParams = MatchParams()) -> tuple[DataFrame, DataFrame]:
    """The matcher's own model as tables for ``model.decode``: emissions of the points, transitions between those that survive."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before, last = [], [], None
        for row in pdf.sort_values("utc").itertuples(index=False):
            cands, routes = unpack(row)
            seconds, sample = None if last is None else float(row.utc - last), (row.slon, row.slat)
            vector, _ = advance(before, seconds, row.straight, sample, cands, routes, p)
            if vector:
                for c in held_points(before, sample, cands, p):
                    out.append((row.suid, row.date, row.utc, None, c["road"], c["emission"]))
                    for pred in before:
                        step = move(pred, c, seconds, row.straight, routes, p)
                        if step:
                            out.append((row.suid, row.date, row.utc, pred["road"], c["road"], step[0]))
                before, last = vector, row.utc
        found = pd.DataFrame(out, columns=["suid", "date", "utc", "src", "tgt", "value"])
        found["src"] = found["src"].astype("Int64")
        return found

    n = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(routed.repartition(n, *TRACE).groupBy(*TRACE).applyInPandas(walk, "suid bigint, date string, utc bigint, src bigint, tgt bigint, value double"))
    states = rows.filter("src IS NULL").select(*TRACE, "utc", F.col("tgt").alias("state"), F.col("value").alias("emission"))
    return states, rows.filter("src IS NOT NULL").select(*TRACE, "utc", "src", "tgt", F.col("value").alias("transition"))


def thin_vectors(vecs: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Offline thinning against the last sample kept in the state.

    Samples without candidates are absent from ``vecs`` and never enter the state.
    """
    if p.min_distance <= 0 and p.min_interval <= 0:
        return vecs
    kind = "struct<utc:bigint,slon:double,slat:double>"
    rows = vecs.groupBy(*TRACE).agg(F.array_sort(F.collect_list(F.struct("utc", "slon", "slat"))).alias("rows"))

    # try_element_at is NULL on the empty array, where the size test decides.
    def keep(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        near = geo.planar(last.slon, last.slat, r.slon, r.slat) < p.min_distance
        soon = (r.utc - last.utc) < p.min_interval
        return F.when((F.size(acc) > 0) & (near | soon), acc).otherwise(F.concat(acc, F.array(r)))

    kept = rows.select(*TRACE, F.inline(F.aggregate("rows", F.expr(f"cast(array() as array<{kind}>)"), keep)))
    return vecs.join(kept.select(*TRACE, "utc"), [*TRACE, "utc"], "left_semi").select(*vecs.columns)


def match_traces(samples: DataFrame, base: DataFrame, roads: DataFrame, successors: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Offline matching of whole traces."""
    ways = MatchMap(base, roads, successors, p)
    vecs = thin_vectors(vectors(ways.candidates(samples, p)), p)
    return decode_traces(with_routes(with_predecessor(vecs), ways.tiles, p=p), p)


# -- online ------------------------------------------------------------------------

def window_update(window: list[dict], vector: list[dict], mark: dict, p: MatchParams) -> dict | None:
    """Adds a sample's vector to the open window and emits at most one candidate.

    ``window`` holds ``{"vector": [...], **mark}`` entries. Candidates nobody
    continues from are dropped, back through the window; the best one stays if
    all would go. The oldest entry is emitted when one candidate is left, or
    when the window is longer than ``p.window`` + 1 samples.
    """
    if vector:
        if window:
            _prune(window, vector)
        window.append({"vector": vector, **mark})
    if not window:
        return None
    emitted = None
    if len(window[0]["vector"]) == 1:
        entry = window.pop(0)
        emitted = {**entry, "candidate": entry["vector"][0]}
    else:
        while p.window >= 0 and len(window) > p.window + 1:
            entry = window.pop(0)
            best = max(entry["vector"], key=lambda c: c["seq"])
            if emitted is None or best["seq"] > emitted["candidate"]["seq"]:
                emitted = {**entry, "candidate": best}
            _forget(window)
        return emitted
    _forget(window)
    return emitted


def slide(window: list[dict], vector: list[dict], mark: dict, k: int = -1, age: float = 0) -> None:
    """Sliding window by count or age, without emission."""
    if vector:
        if window:
            _prune(window, vector)
        window.append({"vector": vector, **mark})
    while window and ((age > 0 and mark["utc"] - window[0]["utc"] > age) or (k >= 0 and len(window) > k + 1)):
        window.pop(0)
        _forget(window)


def _forget(window: list[dict]) -> None:
    if window:
        for c in window[0]["vector"]:
            c["pred"] = None


def _prune(window: list[dict], following: list[dict]) -> None:
    """Keeps candidates with a successor, from the newest entry backwards."""
    newest = True
    for entry in reversed(window):
        vector = entry["vector"]
        used = sorted({c["pred"] for c in following if c["pred"] is not None})
        if not used and newest:
            used = [max(range(len(vector)), key=lambda i: vector[i]["seq"])]
        if len(used) == len(vector):
            return
        if not used:
            return
        place = {old: new for new, old in enumerate(used)}
        entry["vector"] = [vector[i] for i in used]
        for c in following:
            if c["pred"] is not None:
                c["pred"] = place[c["pred"]]
        following, newest = entry["vector"], False


# -- single steps as tables ------------------------------------------------------------

def transition_rows(routed: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Transition probabilities between the candidates of consecutive samples."""
    w = Window.partitionBy(*TRACE).orderBy("utc")
    # Only what a transition needs moves to its trace: neither the roads of a route nor the places of candidates.
    slim = routed.select(
        *SAMPLE, "straight", F.col("prev.utc").alias("pre_utc"),
        F.arrays_zip("cs.road_id", "cs.fraction", "cs.emission", "cs.road_cost", "cs.road_length").alias("cs"),
        F.arrays_zip("routes.srcs", "routes.tgts", "routes.inner_cost", "routes.inner_length").alias("routes"))
    paired = slim.withColumn("before", F.lag("cs").over(w)).filter(F.col("before").isNotNull())

    limit = S.search_bound((F.col("utc") - F.col("pre_utc")) * 1000, p)

    def leg(a, b):
        pair = F.array_sort(F.filter("routes", lambda r: F.array_contains(r.srcs, a.road_id) & F.array_contains(r.tgts, b.road_id)), lambda x, y: F.signum(x.inner_cost - y.inner_cost).cast("int"))
        route = fitting(pair, limit, (1 - a.fraction) * a.road_length + b.fraction * b.road_length)
        return F.struct(
            a.road_id.alias("src"), b.road_id.alias("tgt"), a.fraction.alias("f"), b.fraction.alias("g"),
            a.road_cost.alias("cost_a"), b.road_cost.alias("cost_b"), a.road_length.alias("length_a"), b.road_length.alias("length_b"),
            a.emission.alias("from_emission"), b.emission.alias("emission"),
            route.inner_cost.alias("inner_cost"), route.inner_length.alias("inner_length"),
        )

    # Built inside the row, so that the routes are not copied to every pair.
    legs = F.flatten(F.transform("before", lambda a: F.transform("cs", lambda b: leg(a, b))))
    pairs = paired.select(*SAMPLE, "straight", ((F.col("utc") - F.col("pre_utc")) * 1000).alias("ms"), F.inline(legs))
    direct = (F.col("src") == F.col("tgt")) & (F.col("g") >= F.col("f"))
    moved = F.col("g") - F.col("f")
    through = lambda a, inner, b: F.when(direct, moved * F.col(b)).otherwise(
        (1 - F.col("f")) * F.col(a) + F.col(inner) + F.col("g") * F.col(b)
    )
    rows = pairs.withColumn("cost", through("cost_a", "inner_cost", "cost_b")).withColumn(
        "length", through("length_a", "inner_length", "length_b")
    ).filter(F.col("length") <= S.search_bound(F.col("ms"), p))
    return rows.select(
        *SAMPLE, "src", "tgt", "cost", "from_emission", "emission",
        S.transition(F.col("cost"), F.col("straight"), F.col("ms"), p).alias("transition"),
    )


def filter_step(rows: DataFrame, prior: str, keys: list[str]) -> DataFrame:
    """Forward step: weighted sum over predecessors, times emission, normalised per sample."""
    summed = rows.groupBy(*keys, "tgt").agg(
        (F.sum(F.col("transition") * F.col(prior)) * F.first("emission")).alias("raw")
    )
    total = summed.groupBy(*keys).agg(F.sum("raw").alias("norm"))
    return summed.join(total, keys).select(*keys, "tgt", (F.col("raw") / F.col("norm")).alias("filt"))


def viterbi_step(rows: DataFrame, prior: str, keys: list[str]) -> DataFrame:
    """Best predecessor of each candidate by log probability."""
    seq = F.col(prior) + F.log10("transition") + F.log10("emission")
    return (
        rows.filter(F.col("transition") > 0).withColumn("seq", seq)
        .groupBy(*keys, "tgt").agg(F.max_by(F.struct("src", "seq"), F.struct("seq", (-F.col("src")).alias("o"))).alias("b"))
        .select(*keys, "tgt", "b.src", "b.seq")
    )


def top_estimate(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """Most probable candidate of each sample, ties to the smaller road id."""
    return filtered.groupBy(*keys).agg(F.max_by("tgt", F.struct("filt", (-F.col("tgt")).alias("o"))).alias("road_id"))
