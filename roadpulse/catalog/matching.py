"""Queries on routing, map matching and match quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import DAY_END, EPOCH, Fixtures, sql, sql_planar
from roadpulse.catalog.network import SECONDS, TP
from roadpulse.catalog.places import DIRECTED, LOCAL
from roadpulse.catalog.registry import query
from roadpulse.functions import scalar as S
from roadpulse.operators import evaluate as E
from roadpulse.operators import matching as M
from roadpulse.operators import routing as RT
from roadpulse.params import MatchParams
from roadpulse.plans.lineage import cut

KEYS = ["suid", "utc"]


def walk_sql(cost: str, limit: str) -> dict[str, str]:
    """Every chain of successors whose cost stays within the limit."""
    return {
        "priced": f"SELECT id, length_m, {cost} AS cost FROM roads",
        "hop": "SELECT s.id, s.succ_id, p.cost, p.length_m FROM successors s JOIN priced p ON p.id = s.succ_id",
        "chains": f"""
          SELECT id AS src, id AS node, 0e0 AS cost, 0e0 AS length FROM priced
          UNION ALL
          SELECT c.src, h.succ_id, c.cost + h.cost, c.length + h.length_m FROM chains c JOIN hop h ON h.id = c.node
          WHERE c.length + h.length_m <= {limit}""",
        "best": "SELECT src, node, min(cost) AS cost, arg_min(length, cost) AS length FROM chains WHERE length > 0 GROUP BY src, node",
    }


@query("G1_routes_within_length", sql(
    "SELECT src, node AS tgt, round(cost, 5) AS cost, round(length, 5) AS length FROM best",
    "roads", "successors", **walk_sql("length_m", "600e0")))
def _(f):
    found = RT.reachable(f.roads(), f.successors(), f.roads().select(F.col("id").alias("src")), 600.0, "distance")
    return found.select("src", "tgt", F.round("cost", 5).alias("cost"), F.round("length", 5).alias("length"))


@query("G1_cheapest_routes", sql(
    "SELECT src, node AS tgt, round(cost, 5) AS cost, round(length, 5) AS length FROM best",
    "roads", "successors", **walk_sql(TP, "300e0")))
def _(f):
    found = RT.reachable(f.roads(), f.successors(), f.roads().select(F.col("id").alias("src")), 300.0)
    return found.select("src", "tgt", F.round("cost", 5).alias("cost"), F.round("length", 5).alias("length"))


@query("J7_step_routes")
def _(f):
    """Routes between the candidates of consecutive samples."""
    return M.transition_rows(f.routed()).select("suid", "utc", "src", "tgt", F.round("cost", 6).alias("cost"), "transition")


@query("F10_emission", sql("""
    SELECT event_id, road_id, round(1 / sqrt(2 * pi() * 25) * exp(-dist / 50), 8) AS emission FROM directed""",
    "samples", "base_roads", **LOCAL, directed=DIRECTED))
def _(f):
    from roadpulse.operators.spatial import radius_candidates

    found = radius_candidates(f.samples(), f.base_roads(), 100.0, ["event_id"])
    return found.select("event_id", "road_id", F.round(S.emission(F.col("dist")), 8).alias("emission"))


@query("F11_transition", sql(f"""
    SELECT suid, utc, round(exp(-greatest(0e0, c - d / 60) / b) / b, 8) AS transition FROM (
      SELECT suid, utc, sum({TP}) AS c, any_value(straight) AS d, 2e0 * greatest(1, (any_value(utc) - any_value(pre_utc)) * 1000) / 1000 AS b
      FROM (SELECT p.suid, p.utc, p.pre_utc, unnest(route) AS id, sum(0e0) OVER () + 500e0 * len(route) AS straight FROM raw_pairs p) JOIN roads USING (id)
      GROUP BY suid, utc)""", "raw_pairs", "roads"))
def _(f):
    from roadpulse.operators.roads import with_cost

    parts = f.raw_pairs().select("suid", "utc", "pre_utc", (F.size("route") * 500.0).alias("straight"), F.explode("route").alias("id"))
    summed = parts.join(with_cost(f.roads()).select("id", "cost"), "id").groupBy("suid", "utc", "pre_utc", "straight").agg(F.sum("cost").alias("cost"))
    value = S.transition(F.col("cost"), F.col("straight"), (F.col("utc") - F.col("pre_utc")) * 1000)
    return summed.select("suid", "utc", F.round(value, 8).alias("transition"))


@query("F12_search_bound", sql("""
    SELECT suid, utc, greatest(1000e0, least(15000e0, CAST(floor((utc - pre_utc) * 1000 / 1000) * 33 AS DOUBLE))) AS bound FROM paired WHERE pre_utc IS NOT NULL""",
    "paired"))
def _(f):
    from roadpulse.catalog.traces import paired

    return paired(f).select("suid", "utc", S.search_bound((F.col("utc") - F.col("pre_utc")) * 1000).alias("bound"))


@query("X7_own_settings", sql("""
    SELECT suid, utc, greatest(500e0, least(3000e0, CAST((utc - pre_utc) * 20 AS DOUBLE))) AS bound,
      round(1 / sqrt(2 * pi() * 100) * exp(-pow(utc - pre_utc, 2) / 200), 8) AS emission FROM paired WHERE pre_utc IS NOT NULL""", "paired"))
def _(f):
    from roadpulse.catalog.traces import paired

    p = MatchParams(sigma=10.0, min_bound=500.0, max_distance=3000.0, bound_speed=20, squared_emission=True)
    gap = F.col("utc") - F.col("pre_utc")
    return paired(f).select("suid", "utc", S.search_bound(gap * 1000, p).alias("bound"),
                            F.round(S.emission(gap.cast("double"), p), 8).alias("emission"))


# One step of the model on moves along one road: candidates of consecutive samples.
CANDS = """
  SELECT s.suid, s.utc, s.utc // 86400 AS day, d.event_id, d.road_id, d.fraction, d.dist, 1 / sqrt(2 * pi() * 25) * exp(-d.dist / 50) AS emission
  FROM directed d JOIN samples s ON s.event_id = d.event_id"""
STEP = f"""
  SELECT c.suid, c.utc, b.road_id AS src, c.road_id AS tgt, c.emission, b.emission AS from_emission,
    exp(-greatest(0e0, (c.fraction - b.fraction) * {TP} - s.straight / 60) / (2e0 * (c.utc - s.pre))) / (2e0 * (c.utc - s.pre)) AS transition
  FROM (SELECT suid, utc, lag(utc) OVER w AS pre, {sql_planar('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS straight
        FROM samples WINDOW w AS (PARTITION BY suid, utc // 86400 ORDER BY utc)) s
  JOIN cands c ON c.suid = s.suid AND c.utc = s.utc JOIN cands b ON b.suid = s.suid AND b.utc = s.pre AND b.road_id = c.road_id AND c.fraction >= b.fraction
  JOIN roads r ON r.id = c.road_id"""
ONE = dict(**LOCAL, directed=DIRECTED, cands=CANDS, step=STEP)


def one_step(f: Fixtures):
    from pyspark.sql import Window

    from roadpulse.functions import geo
    from roadpulse.operators.roads import with_cost
    from roadpulse.operators.spatial import radius_candidates

    # A vehicle's day of thinned samples.
    w = Window.partitionBy("suid", F.floor(F.col("utc") / 86400)).orderBy("utc")
    s = f.samples().withColumn("before", F.lag(F.struct("utc", "lon", "lat")).over(w)).filter(F.col("before").isNotNull())
    s = s.select("suid", "utc", F.col("before.utc").alias("pre"), geo.planar(
        F.col("before.lon"), F.col("before.lat"), F.col("lon"), F.col("lat")).alias("straight"))
    cands = radius_candidates(f.samples(), f.base_roads(), 100.0, ["suid", "utc"]).withColumn("emission", S.emission(F.col("dist")))
    after = cands.select("suid", "utc", "road_id", F.col("fraction").alias("g"), "emission")
    before = cands.select("suid", F.col("utc").alias("pre"), "road_id", F.col("fraction").alias("f"), F.col("emission").alias("from_emission"))
    prices = with_cost(f.roads()).select(F.col("id").alias("road_id"), "cost")
    joined = s.join(after, ["suid", "utc"]).join(before, ["suid", "pre", "road_id"]).filter(F.col("g") >= F.col("f")).join(prices, "road_id")
    moved = (F.col("g") - F.col("f")) * F.col("cost")
    return joined.select(
        "suid", "utc", F.col("road_id").alias("src"), F.col("road_id").alias("tgt"), "emission", "from_emission",
        S.transition(moved, F.col("straight"), (F.col("utc") - F.col("pre")) * 1000).alias("transition"))


@query("A8_filter_step", sql("""
    SELECT suid, utc, tgt, round(raw / sum(raw) OVER (PARTITION BY suid, utc), 6) AS filt FROM (
      SELECT suid, utc, tgt, sum(transition * from_emission) * any_value(emission) AS raw FROM step GROUP BY suid, utc, tgt)""",
    "samples", "base_roads", "roads", **ONE))
def _(f):
    return M.filter_step(one_step(f), "from_emission", KEYS).withColumn("filt", F.round("filt", 6))


@query("A9_viterbi_step", sql("""
    SELECT suid, utc, tgt, arg_max(src, (seq, -src)) AS src, round(max(seq), 6) AS seq FROM (
      SELECT *, log10(from_emission) + log10(transition) + log10(emission) AS seq FROM step WHERE transition > 0) GROUP BY suid, utc, tgt""",
    "samples", "base_roads", "roads", **ONE))
def _(f):
    rows = one_step(f).withColumn("prior", F.log10("from_emission"))
    return M.viterbi_step(rows, "prior", KEYS).withColumn("seq", F.round("seq", 6))


@query("W7_top_estimate", sql("""
    SELECT suid, utc, arg_max(tgt, (raw, -tgt)) AS road_id FROM (
      SELECT suid, utc, tgt, round(sum(transition * from_emission) * any_value(emission), 12) AS raw FROM step GROUP BY suid, utc, tgt) GROUP BY suid, utc""",
    "samples", "base_roads", "roads", **ONE))
def _(f):
    raw = one_step(f).groupBy(*KEYS, "tgt").agg(
        F.round(F.sum(F.col("transition") * F.col("from_emission")) * F.first("emission"), 12).alias("filt"))
    return M.top_estimate(raw, KEYS)


@query("G7_match_traces")
def _(f):
    decoded = M.decode_traces(f.routed())
    return decoded.select("suid", "utc", "road_id", F.round("fraction", 6).alias("fraction"), F.size("path").alias("steps"), "broke")


@query("W8_best_sequence")
def _(f):
    return f.traces().select("suid", "utc", "road_id", F.round("seq", 6).alias("seq"))


@query("A10_chain_breaks")
def _(f):
    return f.traces().groupBy("suid").agg(F.count_if("broke").alias("breaks"), F.count(F.lit(1)).alias("samples"))


@query("J6_held_points")
def _(f):
    """Samples whose position was held at the predecessor's point: equal road and fraction."""
    from roadpulse.plans.ordered import day_chunk, with_previous

    t = with_previous(f.traces(), ["suid"], day_chunk(), ["utc"], ["road_id", "fraction"])
    return t.filter((F.col("road_id") == F.col("pre_road_id")) & (F.col("fraction") == F.col("pre_fraction"))).select("suid", "utc", "road_id", "fraction")


@query("P22_thin_offline")
def _(f):
    return f.thin_traces_matched().select("suid", "utc", "road_id")


@query("P26_matched_only", sql(
    "SELECT suid, utc FROM samples WHERE event_id NOT IN (SELECT event_id FROM directed)", "samples", "base_roads", **LOCAL, directed=DIRECTED))
def _(f):
    """Samples without any candidate emit nothing."""
    return f.samples().select("suid", "utc").join(f.traces().select("suid", "utc"), KEYS, "left_anti")


@query("X5_own_model")
def _(f):
    """Decoding with routes priced by length instead of time."""
    routed = M.with_routes(M.with_predecessor(f.vectors()), f.roads(), f.successors(), cost="distance")
    return M.decode_traces(routed).select("suid", "utc", "road_id")


# A user's own model: near roads are likely, staying on one is more so, and a gap over ten minutes cuts the chain.
OWN_STATES = """
  SELECT s.suid, s.utc // 86400 AS day, s.utc, c.base_gid AS state, c.fraction, 1 / (1 + c.dist) AS emission
  FROM closest c JOIN samples s ON s.event_id = c.event_id WHERE c.dist < 100"""
OWN_MOVES = """
  SELECT a.suid, a.day, a.utc, b.state AS src, a.state AS tgt,
    CASE WHEN a.state = b.state THEN 0.9e0 ELSE 0.1e0 / (1 + abs(a.fraction - b.fraction)) END AS transition
  FROM (SELECT DISTINCT suid, day, utc, lag(utc) OVER (PARTITION BY suid, day ORDER BY utc) AS pre FROM (SELECT DISTINCT suid, day, utc FROM own_states)) o
  JOIN own_states a ON a.suid = o.suid AND a.utc = o.utc JOIN own_states b ON b.suid = o.suid AND b.utc = o.pre
  WHERE o.utc - o.pre <= 600"""
VECTORS = """
  SELECT s.suid, s.day, s.utc, row_number() OVER (PARTITION BY s.suid, s.day ORDER BY s.utc) AS n, s.states, coalesce(m.moves, []) AS moves FROM (
    SELECT suid, day, utc, list({'state': state, 'emission': emission} ORDER BY state) AS states FROM own_states GROUP BY ALL) s
  LEFT JOIN (SELECT suid, utc, list({'src': src, 'tgt': tgt, 't': transition} ORDER BY src) AS moves FROM own_moves GROUP BY ALL) m ON m.suid = s.suid AND m.utc = s.utc"""
STARTED = "list_transform(states, lambda s: {'state': s.state, 'filt': s.emission, 'seq': log10(s.emission), 'pred': NULL::BIGINT})"
WAY = "list_filter(moves, lambda m: m.tgt = s.state AND len(list_filter(vec, lambda v: v.state = m.src)) > 0)"
HELD = "list_filter(vec, lambda v: v.state = m.src)[1]"
REACHED = f"""list_transform(list_filter(states, lambda s: len({WAY}) > 0), lambda s: {{'state': s.state,
    'filt': s.emission * list_sum(list_transform({WAY}, lambda m: m.t * {HELD}.filt)),
    'best': list_max(list_transform({WAY}, lambda m: {{'seq': {HELD}.seq + log10(m.t) + log10(s.emission), 'src': -m.src}}))}})"""
FORWARD = f"""
  SELECT suid, day, utc, n, {STARTED} AS vec, false AS broke FROM vectors WHERE n = 1
  UNION ALL
  SELECT suid, day, utc, n, list_transform(new, lambda x: {{'state': x.state, 'filt': x.filt / list_sum(list_transform(new, lambda y: y.filt)), 'seq': x.seq, 'pred': x.pred}}), broke FROM (
    SELECT v.suid, v.day, v.utc, v.n, len({REACHED}) = 0 AS broke, CASE WHEN len({REACHED}) = 0 THEN {STARTED} ELSE
      list_transform({REACHED}, lambda x: {{'state': x.state, 'filt': x.filt, 'seq': x.best.seq, 'pred': -x.best.src}}) END AS new
    FROM forward f JOIN vectors v ON v.suid = f.suid AND v.day = f.day AND v.n = f.n + 1)"""
TOP = "list_max(list_transform(f.vec, lambda v: {'seq': v.seq, 'state': -v.state}))"
BACK = f"""
  SELECT f.suid, f.day, f.n, -({TOP}).state AS state FROM forward f JOIN (SELECT suid, day, max(n) AS n FROM forward GROUP BY ALL) USING (suid, day, n)
  UNION ALL
  SELECT f.suid, f.day, f.n, coalesce(list_filter(g.vec, lambda v: v.state = b.state)[1].pred, -({TOP}).state)
  FROM back b JOIN forward g ON g.suid = b.suid AND g.day = b.day AND g.n = b.n JOIN forward f ON f.suid = b.suid AND f.day = b.day AND f.n = b.n - 1"""
WEIGHED = """SELECT *, list_filter(vec, lambda v: v.state = state)[1] AS own, list_sum(list_transform(vec, lambda v: v.filt)) AS total
  FROM back JOIN forward USING (suid, day, n)"""


def own_tables(f: Fixtures):
    """Emissions and transitions of the model above."""
    from pyspark.sql import Window

    from roadpulse.operators import spatial as SP

    day = F.floor(F.col("utc") / 86400).alias("day")
    # Kept, since the roads near each sample would be found again for every use below.
    found = cut(SP.base_radius(f.samples(), SP.road_segments(f.base_roads()), 100.0, ["suid", "utc"]).select(
        "suid", day, "utc", F.col("base_gid").alias("state"), "fraction", (1 / (1 + F.col("dist"))).alias("emission")))
    # A vehicle's day of thinned samples.
    order = found.select("suid", "day", "utc").distinct().withColumn("pre", F.lag("utc").over(Window.partitionBy("suid", "day").orderBy("utc")))
    before = found.select("suid", F.col("utc").alias("pre"), F.col("state").alias("src"), F.col("fraction").alias("f"))
    joined = order.filter(F.col("utc") - F.col("pre") <= 600).join(found, ["suid", "day", "utc"]).join(before, ["suid", "pre"])
    change = 0.1 / (1 + F.abs(F.col("fraction") - F.col("f")))
    moves = joined.select("suid", "day", "utc", "src", F.col("state").alias("tgt"), F.when(F.col("src") == F.col("state"), 0.9).otherwise(change).alias("transition"))
    return found.select("suid", "day", "utc", "state", "emission"), moves


@query("X5_own_tables", sql("""
    SELECT suid, utc, state, round(own.filt / total, 6) AS filt, round(own.seq, 6) AS seq, broke FROM weighed""",
    "samples", "base_roads", **LOCAL, own_states=OWN_STATES, own_moves=OWN_MOVES, vectors=VECTORS, forward=FORWARD, back=BACK, weighed=WEIGHED))
def _(f):
    """Decoding with own states, emissions and transitions, in chunks of four hours."""
    from roadpulse.operators import model

    found = model.decode(*own_tables(f), ["suid", "day"], "utc", F.floor(F.col("utc") / 14400))
    return found.select("suid", "utc", "state", F.round("filt", 6).alias("filt"), F.round("seq", 6).alias("seq"), "broke")


@query("X5_tables_from_matcher")
def _(f):
    """The matcher's own emissions and transitions, decoded as tables."""
    from roadpulse.operators import model

    found = model.decode(*M.model_tables(f.routed()), M.TRACE, "utc", F.floor(F.col("utc") / 14400))
    return found.select("suid", "utc", F.col("state").alias("road_id"), F.round("seq", 6).alias("seq"), "broke")


# -- quality ----------------------------------------------------------------------

SEQS = """
  SELECT suid, utc, row_number() OVER (PARTITION BY suid, utc ORDER BY pos) AS place, source, target, length_m AS length, pos FROM (
    SELECT suid, utc, unnest(route) AS id, unnest(range(len(route))) AS pos FROM raw_pairs) JOIN roads USING (id)"""


def both_sequences(f: Fixtures):
    """Routes of the pairs, and the same without every fifth road."""
    paths = f.raw_pairs().select("suid", "utc", F.posexplode("route").alias("pos", "id"))
    left = paths.join(f.roads().select("id", "source", "target", F.col("length_m").alias("length")), "id").select(
        "suid", "utc", (F.col("pos") + 1).alias("place"), "source", "target", "length")
    return left, left.filter(F.pmod("place", F.lit(5)) != 0)


@query("G6_align_sequences", sql("""
    SELECT suid, utc, CAST(place AS INTEGER) AS left_place, CAST(place AS INTEGER) AS right_place FROM seqs WHERE place % 5 <> 0""",
    "raw_pairs", "roads", seqs=SEQS))
def _(f):
    return E.align(*both_sequences(f), KEYS)


@query("A18_match_error", sql("""
    SELECT suid, utc, round(sum(CASE WHEN place % 5 = 0 THEN length ELSE 0e0 END) / sum(length), 6) AS error FROM seqs GROUP BY suid, utc""",
    "raw_pairs", "roads", seqs=SEQS))
def _(f):
    left, right = both_sequences(f)
    return E.match_error(left, right, E.align(left, right, KEYS), KEYS).withColumn("error", F.round("error", 6))


@query("A18_error_of_subsample")
def _(f):
    """Error of matching every 60 seconds' samples against matching all of them."""
    full = E.road_sequence(f.traces(), f.roads(), ["suid", "date"])
    few = E.road_sequence(f.thin_traces_matched(), f.roads(), ["suid", "date"])
    aligned = E.align(full, few, ["suid", "date"])
    return E.match_error(full, few, aligned, ["suid", "date"])
