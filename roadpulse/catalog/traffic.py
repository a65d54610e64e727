"""Queries on road speeds, turning times, inference and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.catalog.fixtures import Fixtures, sql, sql_day_seq
from roadpulse.catalog.network import road_state
from roadpulse.catalog.registry import query
from roadpulse.functions import scalar as S
from roadpulse.operators import traffic as T
from roadpulse.plans.lineage import drop, kept, scratch_path
from roadpulse.sinks import tables
from roadpulse.sources import roads as RS

ELEMENTS = """
  SELECT e.suid, e.utc, e.pre_utc, e.utc - e.pre_utc AS interval, pos, road, next_road, s.length, s.time,
    CASE WHEN pos = 0 THEN CASE WHEN road = pre_gid THEN 1 - pre_offset ELSE 0.5e0 END
      WHEN pos = n - 1 THEN "offset" ELSE 1e0 END AS coverage,
    s.length * (CASE WHEN pos = 0 THEN 1 - pre_offset WHEN pos = n - 1 THEN "offset" ELSE 1e0 END) AS covered,
    CASE WHEN next_road IS NOT NULL THEN {turning} END AS turning
  FROM (SELECT *, route[pos + 2] AS next_road FROM (
    SELECT suid, utc, pre_utc, pre_gid, gid, pre_offset, "offset", route, len(route) AS n, unnest(route) AS road,
      unnest(range(len(route))) AS pos FROM pairs WHERE pre_gid <> gid)) e
  JOIN road_state s ON s.gid = e.road {join}"""
PLAIN = ELEMENTS.format(turning="4e0", join="")
TOTALS = """SELECT suid, utc, interval, sum(covered) AS total_length, sum(coverage * time + coalesce(turning, 0e0)) AS total_time
  FROM elements GROUP BY ALL"""
GOOD = "SELECT * FROM totals WHERE interval > 0 AND total_time > 0 AND total_length / interval <= 33.33e0"
ALLOCATED = """
  SELECT e.suid, e.utc, e.pos, e.road, e.next_road,
    e.time * (CASE WHEN e.coverage <> 0 THEN 1 ELSE 0 END) * e.interval / g.total_time AS road_time,
    e.turning * e.interval / g.total_time AS turning_time
  FROM elements e JOIN good g ON g.suid = e.suid AND g.utc = e.utc
  WHERE e.next_road IS NULL OR e.next_road <> e.road"""
SAME = """
  SELECT p.gid AS road, suid, utc, 0 AS pos, CASE WHEN "offset" = pre_offset THEN 'jam' ELSE 'speed' END AS kind,
    abs("offset" - pre_offset) * s.length / (utc - pre_utc) AS value,
    CAST(NULL AS BIGINT) AS next_road, CAST(NULL AS DOUBLE) AS turning_time
  FROM pairs p JOIN road_state s ON s.gid = p.gid
  WHERE pre_gid = p.gid AND utc > pre_utc AND ("offset" <> pre_offset OR s.avg_speed < 2)"""
OBS = """SELECT road, suid, utc, pos, 'route' AS kind, road_time AS value, next_road, turning_time FROM allocated
  UNION ALL SELECT road, suid, utc, pos, kind, value, next_road, turning_time FROM same"""
ROUTED = dict(elements=PLAIN, totals=TOTALS, good=GOOD, allocated=ALLOCATED, same=SAME, obs=OBS)

OWN = f"((utc // 86400) * 288 + {sql_day_seq('utc')})"


def fold_sql(obs: str, order: str) -> dict[str, str]:
    """Sequential smoothing per road, one row after another."""
    alpha = "greatest(0e0, least(0.9e0, 0.9e0 - 0.1e0 * ((((o.own - 1) % 288 + 1 - ({pre})) % 288 + 288) % 288)))"
    clamp = lambda v: f"greatest(1.5e0, least({v}, greatest(1.5e0, o.max_speed)))"

    own = clamp("o.value")

    def speed(v: str, pre: str) -> str:
        a = alpha.format(pre=pre)
        return (
            f"CASE WHEN o.kind = 'jam' OR (o.kind = 'speed' AND o.value = 0) THEN {clamp(f'0.9e0 * {v}')} "
            f"WHEN o.sensed > 33.33e0 THEN {v} "
            f"WHEN o.kind = 'route' THEN {clamp(f'(o.sensed * (1 - {a}) + {v} * {a})')} "
            f"ELSE {clamp(f'({own} * (1 - {a}) + {v} * {a})')} END"
        )

    accepted = "(o.own > f.slot OR ((o.own - 1) // 288 = (f.slot - 1) // 288 AND f.slot - o.own <= 1))"
    return {
        "obs_n": f"""
          SELECT b.*, s.length, s.max_speed, s.avg_speed AS v0,
            CASE WHEN kind = 'route' THEN s.length / value ELSE value END AS sensed,
            row_number() OVER (PARTITION BY road ORDER BY {order}) AS rn
          FROM (SELECT *, {OWN} AS own FROM {obs} WHERE CASE WHEN kind = 'route' THEN value > 0 ELSE value >= 0 END) b
          JOIN road_state s ON s.gid = b.road""",
        "fold": f"""
          SELECT o.*, o.own AS slot, TRUE AS accepted, {speed('o.v0', '-1')} AS v FROM obs_n o WHERE rn = 1
          UNION ALL
          SELECT o.*, greatest(o.own, f.slot), {accepted},
            CASE WHEN {accepted} THEN {speed('f.v', '((f.slot - 1) % 288 + 1)')} ELSE f.v END
          FROM fold f JOIN obs_n o ON o.road = f.road AND o.rn = f.rn + 1""",
        "ends": """
          SELECT road, slot, v, slot < max(slot) OVER (PARTITION BY road) AS closed FROM (
            SELECT road, slot, arg_max(v, rn) AS v FROM fold GROUP BY road, slot)""",
        "road_slices": """
          SELECT e.road AS gid, s.base_gid, s.class_id, s.length, s.max_speed, e.slot, (e.slot - 1) // 288 AS day,
            (e.slot - 1) % 288 + 1 AS seq, e.v AS avg_speed, s.length / e.v AS time, closed
          FROM ends e JOIN road_state s ON s.gid = e.road""",
    }


TURNS = {
    "turn_n": """
      SELECT road, next_road, slot, turning_time AS x, (own - 1) % 288 + 1 AS cur,
        row_number() OVER (PARTITION BY road, next_road ORDER BY utc, suid, pos) AS rn
      FROM fold WHERE accepted AND sensed <= 33.33e0 AND kind = 'route' AND turning_time > 0""",
    "turn_fold": """
      SELECT road, next_road, slot, x, cur, rn, greatest(0.1e0, x * (1 - a) + 4e0 * a) AS t FROM (
        SELECT *, greatest(0e0, least(0.9e0, 0.9e0 - 0.1e0 * (cur % 288))) AS a FROM turn_n WHERE rn = 1)
      UNION ALL
      SELECT road, next_road, slot, x, cur, rn, greatest(0.1e0, x * (1 - a) + t0 * a) FROM (
        SELECT n.*, greatest(0e0, least(0.9e0, 0.9e0 - 0.1e0 * (((n.cur - f.cur) % 288 + 288) % 288))) AS a, f.t AS t0
        FROM turn_fold f JOIN turn_n n ON n.road = f.road AND n.next_road = f.next_road AND n.rn = f.rn + 1)""",
    "turn_slices": """
      SELECT road AS gid, next_road AS next_gid, slot, (slot - 1) // 288 AS day, (slot - 1) % 288 + 1 AS seq,
        arg_max(t, rn) AS time, arg_max(cur, rn) AS turn_seq FROM turn_fold GROUP BY road, next_road, slot""",
}
def elements(f: Fixtures):
    return T.route_elements(f.pairs(), road_state(f))


def rounded(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("J9_route_elements", sql("""
    SELECT suid, utc, pos, road, round(length, 6) AS length, round(time, 6) AS time, round(coverage, 6) AS coverage FROM elements""",
    "pairs", "road_state", elements=PLAIN))
def _(f):
    return rounded(elements(f), "length", "time", "coverage").select("suid", "utc", "pos", "road", "length", "time", "coverage")


@query("W3_next_road", sql("""
    SELECT suid, utc, pos, road, lead(road) OVER (PARTITION BY suid, utc ORDER BY pos) AS next_road FROM elements""",
    "pairs", "road_state", elements=PLAIN))
def _(f):
    return elements(f).select("suid", "utc", "pos", "road", "next_road")


@query("J10_turning_lookup", sql("""
    SELECT suid, utc, pos, round(turning, 6) AS turning FROM known""", "pairs", "road_state", **{
        **ROUTED, **fold_sql("obs", "utc, suid, pos"), **TURNS,
        "latest": "SELECT gid, next_gid, arg_max(time, slot) AS time FROM turn_slices GROUP BY gid, next_gid",
        "known": ELEMENTS.format(
            turning="coalesce(k.time, 4e0)", join="LEFT JOIN latest k ON k.gid = e.road AND k.next_gid = e.next_road"),
    }))
def _(f):
    state, pairs = road_state(f), f.pairs()
    _, turns = T.road_speeds(pairs, state)
    latest = turns.groupBy("gid", "next_gid").agg(F.max_by("time", "slot").alias("time"))
    return rounded(T.route_elements(pairs, state, latest), "turning").select("suid", "utc", "pos", "turning")


@query("A11_route_totals", sql(
    "SELECT suid, utc, round(total_length, 5) AS total_length, round(total_time, 5) AS total_time FROM totals",
    "pairs", "road_state", elements=PLAIN, totals=TOTALS))
def _(f):
    return rounded(T.route_totals(elements(f)), "total_length", "total_time", digits=5).select("suid", "utc", "total_length", "total_time")


@query("P18_too_fast", sql("""
    SELECT suid, utc FROM (SELECT *, total_length * 3 AS fast FROM totals) WHERE NOT (fast / interval <= 33.33e0)""",
    "pairs", "road_state", elements=PLAIN, totals=TOTALS))
def _(f):
    totals = T.route_totals(elements(f)).withColumn("total_length", F.col("total_length") * 3)
    return totals.filter(~F.coalesce(T.plausible(), F.lit(False))).select("suid", "utc")


@query("P25_valid_pairs", sql("SELECT suid, utc, interval FROM good", "pairs", "road_state", elements=PLAIN, totals=TOTALS, good=GOOD))
def _(f):
    return T.plausible_totals(T.route_totals(elements(f))).select("suid", "utc", "interval")


@query("W4_allocate_times", sql("""
    SELECT suid, utc, pos, road, next_road, round(road_time, 5) AS road_time, round(turning_time, 5) AS turning_time FROM allocated""",
    "pairs", "road_state", **ROUTED))
def _(f):
    return rounded(T.allocate(elements(f)), "road_time", "turning_time", digits=5)


@query("P23_F14_same_road", sql("SELECT road, suid, utc, kind, round(value, 6) AS value FROM same", "pairs", "road_state", same=SAME))
def _(f):
    return rounded(T.same_road_observations(f.pairs(), road_state(f)), "value").select("road", "suid", "utc", "kind", "value")


@query("F14_segment_speed", sql("""
    SELECT suid, utc, round(CASE WHEN utc <> pre_utc THEN abs("offset" - pre_offset) * length_m / (utc - pre_utc) END, 6) AS speed
    FROM pairs JOIN roads ON id = gid WHERE gid = pre_gid""", "pairs", "roads"))
def _(f):
    same = f.pairs().filter(F.col("gid") == F.col("pre_gid")).join(f.roads().select(F.col("id").alias("gid"), "length_m"), "gid")
    speed = S.segment_speed(F.col("pre_offset"), F.col("offset"), F.col("length_m"), F.col("utc") - F.col("pre_utc"))
    return same.select("suid", "utc", F.round(speed, 6).alias("speed"))


@query("P19_clamp_speed", sql("""
    SELECT a.event_id, round(greatest(1.5e0, least(a.value, s.max_speed)), 6) AS speed FROM arrivals a JOIN road_state s ON s.gid = a.road""",
    "arrivals", "road_state"))
def _(f):
    rows = f.arrivals().join(road_state(f).select(F.col("gid").alias("road"), "max_speed"), "road")
    return rows.select("event_id", F.round(S.clamp_speed(F.col("value"), F.col("max_speed")), 6).alias("speed"))


@query("P20_floor_turning", sql("SELECT event_id, round(greatest(value / 10, 0.1e0), 6) AS time FROM arrivals", "arrivals"))
def _(f):
    return f.arrivals().select("event_id", F.round(S.floor_turning(F.col("value") / 10), 6).alias("time"))


@query("W2_slice_distance", sql(f"""
    SELECT event_id, ((({sql_day_seq('utc')}) - road * 40) % 288 + 288) % 288 AS distance FROM arrivals""", "arrivals"))
def _(f):
    return f.arrivals().select("event_id", S.slice_distance(F.col("road") * 40, S.day_slice(F.col("utc"))).alias("distance"))


ARRIVAL_CHUNK = lambda: F.floor(F.col("event_id") / 500)


def folded_arrivals(f: Fixtures, keep=None):
    obs = f.arrivals()
    if keep:
        obs = obs.filter(keep)
    state = road_state(f)
    updates = T.speed_updates(T.admit(obs, ["event_id"], ARRIVAL_CHUNK()), state)
    return updates, T.smooth_roads(updates, state, ["event_id"])


SLICES = "SELECT gid, day, seq, round(avg_speed, 6) AS avg_speed, round(time, 6) AS time, closed FROM road_slices"


def slices_out(roads):
    return rounded(roads, "avg_speed", "time").select("gid", "day", "seq", "avg_speed", "time", "closed")


@query("A12_smooth_samples", sql(SLICES, "arrivals", "road_state", **{
    "part_of": "SELECT * FROM arrivals WHERE kind <> 'route'", **fold_sql("part_of", "event_id")}))
def _(f):
    return slices_out(folded_arrivals(f, "kind <> 'route'")[1])


@query("A13_smooth_route_times", sql(SLICES, "arrivals", "road_state", **{
    "part_of": "SELECT * FROM arrivals WHERE kind = 'route'", **fold_sql("part_of", "event_id")}))
def _(f):
    return slices_out(folded_arrivals(f, "kind = 'route'")[1])


@query("W5_slice_rollover", sql(SLICES, "arrivals", "road_state", **fold_sql("arrivals", "event_id")))
def _(f):
    return slices_out(folded_arrivals(f)[1])


@query("T6_late_rows", sql("SELECT event_id, accepted, own < slot AS late FROM fold", "arrivals", "road_state", **fold_sql("arrivals", "event_id")))
def _(f):
    return folded_arrivals(f)[0].select("event_id", "accepted", "late")


PAIR_FOLD = {**ROUTED, **fold_sql("obs", "utc, suid, pos")}


def speeds(f: Fixtures):
    return T.road_speeds(f.pairs(), road_state(f))


@query("O2_T10_road_speeds", sql(SLICES, "pairs", "road_state", **PAIR_FOLD))
def _(f):
    return slices_out(speeds(f)[0])


@query("A14_smooth_turnings", sql("""
    SELECT gid, next_gid, day, seq, round(time, 6) AS time, turn_seq FROM turn_slices""", "pairs", "road_state", **{**PAIR_FOLD, **TURNS}))
def _(f):
    return rounded(speeds(f)[1], "time").select("gid", "next_gid", "day", "seq", "time", "turn_seq")


INFERRED = """
  SELECT gid, base_gid, class_id, length, day, seq, speed AS avg_speed, length / speed AS time FROM (
    SELECT *, greatest(1.5e0, least(greatest(bottom, least(top, h * (v / h_pre))), max_speed)) AS speed FROM (
      SELECT *, least(v + 0.8e0 * (seq - pre_seq) * c_pre, h + 0.8e0 * c) AS top,
        greatest(v - 0.8e0 * (seq - pre_seq) * c_pre, h - 0.8e0 * c) AS bottom FROM (
        SELECT g.*, hp.average_speed AS h_pre, hc.average_speed AS h, coalesce(cp.average_speed, 0) AS c_pre, coalesce(cc.average_speed, 0) AS c
        FROM (SELECT gid, base_gid, class_id, length, max_speed, day, seq AS pre_seq, avg_speed AS v, unnest(range(seq + 1, least(seq + 2, next_seq - 1) + 1)) AS seq
              FROM (SELECT *, lead(seq) OVER (PARTITION BY gid ORDER BY slot) AS next_seq FROM road_slices) WHERE next_seq IS NOT NULL) g
        JOIN history hp ON hp.gid = g.gid AND hp.seq = g.pre_seq
        JOIN history hc ON hc.gid = g.gid AND hc.seq = g.seq
        LEFT JOIN class_history cp ON cp.class_id = g.class_id AND cp.seq = g.pre_seq
        LEFT JOIN class_history cc ON cc.class_id = g.class_id AND cc.seq = g.seq
        WHERE hp.average_speed > 0 AND hc.average_speed > 0)) WHERE top > bottom)"""
REAL = """
  SELECT day, seq, gid, base_gid, length, class_id, time, avg_speed AS average_speed, TRUE AS is_sensed FROM road_slices WHERE closed
  UNION ALL SELECT day, seq, gid, base_gid, length, class_id, time, avg_speed, FALSE FROM inferred"""
FULL = {**PAIR_FOLD, "inferred": INFERRED, "real_road": REAL}


def inferred(f: Fixtures, roads):
    history = f.history()
    return T.infer_gaps(roads, history, RS.class_history(history))


def real_rows(f: Fixtures):
    roads, turns = speeds(f)
    ends, roads = roads, kept(roads)
    drop(ends.unionByName(turns, allowMissingColumns=True))
    # Kept, so that the shuffles of the gaps and those of their use are not on disk together.
    rows = kept(T.real_road_rows(roads, inferred(f, roads)))
    drop(roads)
    return rows


@query("J11_with_history", sql("""
    SELECT r.gid, r.seq, round(h.average_speed, 6) AS history_speed, round(c.average_speed, 6) AS class_speed
    FROM road_slices r LEFT JOIN history h ON h.gid = r.gid AND h.seq = r.seq
    LEFT JOIN class_history c ON c.class_id = r.class_id AND c.seq = r.seq""", "pairs", "road_state", **PAIR_FOLD))
def _(f):
    history = f.history()
    rows = T.with_history(speeds(f)[0], history, RS.class_history(history))
    return rounded(rows, "history_speed", "class_speed").select("gid", "seq", "history_speed", "class_speed")


@query("W6_infer_gaps", sql("SELECT gid, day, seq, round(avg_speed, 6) AS avg_speed, round(time, 6) AS time FROM inferred",
                            "pairs", "road_state", **FULL))
def _(f):
    return rounded(inferred(f, speeds(f)[0]), "avg_speed", "time").select("gid", "day", "seq", "avg_speed", "time")


WRITTEN = """SELECT CAST(make_date(1970, 1, 1) + CAST(day AS INTEGER) AS DATE) AS date, seq, gid, base_gid, class_id,
    round(time, 6) AS time, round(average_speed, 6) AS average_speed, is_sensed FROM real_road"""


def written(f: Fixtures, rows):
    path = scratch_path(f.spark, "real-road")
    tables.write_slices(rows, path)
    back = f.spark.read.parquet(path)
    return rounded(back, "time", "average_speed").select(
        "date", F.col("seq").cast("bigint").alias("seq"), "gid", "base_gid", "class_id", "time", "average_speed", "is_sensed")


@query("K1_write_sensed", sql(WRITTEN + " WHERE is_sensed", "pairs", "road_state", **FULL))
def _(f):
    return written(f, real_rows(f).filter("is_sensed"))


@query("K3_write_inferred", sql(WRITTEN + " WHERE NOT is_sensed", "pairs", "road_state", **FULL))
def _(f):
    return written(f, real_rows(f).filter("NOT is_sensed"))


TURNED = sql("""
    SELECT t.day, t.seq, t.gid, t.next_gid, round(t.time, 6) AS time FROM turn_slices t
    JOIN road_slices r ON r.gid = t.gid AND r.slot = t.slot AND r.closed WHERE t.turn_seq = t.seq""",
    "pairs", "road_state", **{**PAIR_FOLD, **TURNS})


@query("K2_write_turnings", TURNED)
def _(f):
    roads, turns = speeds(f)
    rows = T.closed_turnings(turns, roads).withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    path = scratch_path(f.spark, "real-turning")
    tables.write_slices(rows.select("date", "seq", "day", "gid", "next_gid", "time"), path)
    return rounded(f.spark.read.parquet(path), "time").select(
        "day", F.col("seq").cast("bigint").alias("seq"), "gid", "next_gid", "time")


MERGED = """
  SELECT coalesce(h.gid, n.gid) AS gid, coalesce(h.seq, n.seq) AS seq, coalesce(h.length, n.length) AS length,
    CASE WHEN n.gid IS NULL THEN h.average_speed WHEN h.average_speed > 0 THEN h.average_speed * 0.8e0 + n.average_speed * 0.2e0
      ELSE n.average_speed END AS average_speed, n.gid IS NOT NULL AS changed
  FROM history h FULL JOIN (
    SELECT gid, seq, arg_max(average_speed, day) AS average_speed, arg_max(length, day) AS length FROM real_road GROUP BY gid, seq) n
  ON n.gid = h.gid AND n.seq = h.seq"""


@query("A15_history_weights", sql("""
    SELECT gid, seq, round(average_speed, 6) AS average_speed, round(length / average_speed, 6) AS time FROM merged WHERE changed""",
    "pairs", "road_state", **{**FULL, "merged": MERGED}))
def _(f):
    changed = T.update_history(f.history(), real_rows(f)).filter("changed")
    return rounded(changed, "average_speed", "time").select("gid", F.col("seq").cast("bigint").alias("seq"), "average_speed", "time")


@query("K4_history_upsert", sql("SELECT gid, seq, round(average_speed, 6) AS average_speed FROM merged",
                                "pairs", "road_state", **{**FULL, "merged": MERGED}))
def _(f):
    path = scratch_path(f.spark, "history")
    # Kept, so that the shuffles of the join are gone when the rows are dealt to their slices.
    merged = kept(T.update_history(f.history(), real_rows(f)).drop("changed"))
    tables.write_history(merged, path)
    drop(merged)
    return rounded(f.spark.read.parquet(path), "average_speed").select(
        "gid", F.col("seq").cast("bigint").alias("seq"), "average_speed")
