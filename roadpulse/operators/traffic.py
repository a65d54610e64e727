"""Road speed and turning time from trajectory pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import scalar as S
from roadpulse.params import DAY_SECONDS, SLICES_PER_DAY, TrafficParams
from roadpulse.plans import clamped
from roadpulse.plans.lineage import drop, kept
from roadpulse.plans.ordered import with_running_max

PAIR = ["suid", "utc"]


# -- routes -------------------------------------------------------------------

def route_elements(
    pairs: DataFrame, state: DataFrame, turning: DataFrame | None = None, p: TrafficParams = TrafficParams(), carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per road of each route with coverage, times and turning time.

    The first road counts from the previous offset (half of it in time when the
    route does not start on the previous road), the last one up to the current
    offset. Turning times come from ``turning`` or the default. Columns ``carry`` of the state come along.
    """
    n = F.size("route")
    parts = pairs.filter((F.col("pre_gid") != F.col("gid")) & F.col("route").isNotNull()).select(
        *PAIR, "pre_gid", "pre_offset", "offset",
        (F.col("utc") - F.col("pre_utc")).alias("interval"), "route", n.alias("steps"), F.posexplode("route").alias("pos", "road"),
    )
    first, last = F.col("pos") == 0, F.col("pos") == F.col("steps") - 1
    parts = parts.select(
        *PAIR, "interval", "pos", "road",
        F.get("route", F.col("pos") + 1).alias("next_road"),
        F.when(first, F.when(F.col("road") == F.col("pre_gid"), 1 - F.col("pre_offset")).otherwise(F.lit(0.5)))
        .when(last, F.col("offset")).otherwise(F.lit(1.0)).alias("coverage"),
        F.when(first, 1 - F.col("pre_offset")).when(last, F.col("offset")).otherwise(F.lit(1.0)).alias("length_share"),
    )
    attributes = state.select(F.col("gid").alias("road"), "length", "time", *carry)
    priced = parts.join(attributes, "road")
    if turning is None:
        known = F.lit(p.turning_default)
    else:
        priced = priced.join(
            turning.select(F.col("gid").alias("road"), F.col("next_gid").alias("next_road"), F.col("time").alias("known")),
            ["road", "next_road"], "left",
        )
        known = F.coalesce("known", F.lit(p.turning_default))
    return priced.select(
        *PAIR, "interval", "pos", "road", "next_road", "coverage", "length", "time",
        (F.col("length") * F.col("length_share")).alias("covered"),
        F.when(F.col("next_road").isNotNull(), known).alias("turning"), *carry,
    )


def _expected() -> Column:
    """Expected time on a road and the turn that leaves it."""
    return F.col("coverage") * F.col("time") + F.coalesce("turning", F.lit(0.0))


def route_totals(elements: DataFrame) -> DataFrame:
    """Covered length and expected time of each pair."""
    return elements.groupBy(*PAIR, "interval").agg(
        F.sum("covered").alias("total_length"),
        F.sum(_expected()).alias("total_time"),
    )


def plausible(p: TrafficParams = TrafficParams()) -> Column:
    """Whether a pair's totals say that it moved in positive time, not faster than allowed."""
    return (F.col("interval") > 0) & (F.col("total_time") > 0) & (F.col("total_length") / F.col("interval") <= p.max_speed)


def plausible_totals(totals: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Pairs that moved in positive time, not faster than allowed."""
    return totals.filter(plausible(p))


def allocate(elements: DataFrame, p: TrafficParams = TrafficParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Splits the interval of each pair over its roads and turns.

    The share of a road is its expected time including the turn that leaves it;
    road time is scaled back to the whole road. A road repeated at once is skipped.
    """
    # A window over the roads of one route: the elements are priced and shuffled to their pair once, not for the totals again.
    pair = Window.partitionBy(*PAIR, "interval")
    totals = elements.withColumn("total_length", F.sum("covered").over(pair)).withColumn(
        "total_time", F.sum(_expected()).over(pair))
    rows = totals.filter(plausible(p)).filter(
        F.col("next_road").isNull() | (F.col("next_road") != F.col("road"))
    )
    spent = F.col("interval") / F.col("total_time")
    on_road = F.col("time") * F.col("coverage") * spent
    return rows.select(
        *PAIR, "pos", "road", "next_road",
        F.when(F.col("coverage") != 0, on_road / F.col("coverage")).otherwise(on_road).alias("road_time"),
        (F.col("turning") * spent).alias("turning_time"), *carry,
    )


# -- observations ---------------------------------------------------------------

def same_road_observations(pairs: DataFrame, state: DataFrame, p: TrafficParams = TrafficParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Speed of pairs on one road; standing still counts only on a slow road."""
    same = pairs.filter((F.col("pre_gid") == F.col("gid")) & (F.col("utc") > F.col("pre_utc")))
    joined = same.join(state.select("gid", *dict.fromkeys(["length", "avg_speed", *carry])), "gid")
    speed = S.segment_speed(F.col("pre_offset"), F.col("offset"), F.col("length"), F.col("utc") - F.col("pre_utc"))
    still = F.col("offset") == F.col("pre_offset")
    return joined.filter(~still | (F.col("avg_speed") < p.jam_speed)).select(
        F.col("gid").alias("road"), *PAIR, F.lit(0).alias("pos"),
        F.when(still, "jam").otherwise("speed").alias("kind"),
        F.when(still, F.lit(0.0)).otherwise(speed).alias("value"),
        F.lit(None).cast("bigint").alias("next_road"), F.lit(None).cast("double").alias("turning_time"), *carry,
    )


def route_observations(allocated: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return allocated.select(
        "road", *PAIR, "pos", F.lit("route").alias("kind"), F.col("road_time").alias("value"), "next_road", "turning_time", *carry
    )


def observations(
    pairs: DataFrame, state: DataFrame, turning: DataFrame | None = None, p: TrafficParams = TrafficParams(), carry: tuple[str, ...] = (),
) -> DataFrame:
    """All road observations; route weights use the state at the start of the run. Columns ``carry`` of the state come along."""
    own = tuple(c for c in carry if c != "length")
    routes = route_observations(allocate(route_elements(pairs, state, turning, p, own), p, carry), carry)
    return routes.unionByName(same_road_observations(pairs, state, p, carry))


# -- smoothing ------------------------------------------------------------------

def slot_of(utc: Column) -> Column:
    """Day and slice as one growing number: 288 slots per day, starting at 1."""
    return F.floor(utc / DAY_SECONDS) * SLICES_PER_DAY + S.day_slice(utc)


def slot_seq(slot: Column) -> Column:
    return F.pmod(slot - 1, F.lit(SLICES_PER_DAY)) + 1


def slot_day(slot: Column) -> Column:
    return F.floor((slot - 1) / SLICES_PER_DAY)


def admit(obs: DataFrame, order: list[str], chunk: Column, p: TrafficParams = TrafficParams(), known: DataFrame | None = None) -> DataFrame:
    """Marks which observations a road accepts, given what came before.

    ``known(road, open_slot)`` is the slice each road was in before this run.

    An observation is accepted in a newer slice or day, in the current slice, or
    up to ``late_slices`` behind it on the same day. ``slot`` is the slice in
    which the road is after seeing the row.
    """
    valid = F.when(F.col("kind") == "route", F.col("value") > 0).otherwise(F.col("value") >= 0)
    slots = obs.filter(valid).withColumn("own", slot_of(F.col("utc")))
    seen = with_running_max(slots, ["road"], chunk, order, "own", "prior")
    if known is not None:
        seen = seen.join(known, "road", "left").withColumn("prior", F.greatest("prior", "open_slot")).drop("open_slot")
    behind = F.col("prior") - F.col("own")
    fresh = F.col("prior").isNull() | (behind < 0)
    late = ~fresh & (behind > 0)
    same_day = slot_day(F.col("prior")) == slot_day(F.col("own"))
    return seen.select(
        *obs.columns, "own", "prior", "_chunk",
        F.greatest("own", "prior").alias("slot"),
        (fresh | (same_day & (behind <= p.late_slices))).alias("accepted"),
        F.coalesce(late, F.lit(False)).alias("late"),
    )


def _effect(old: Column, p: TrafficParams) -> tuple[Column, Column]:
    """Whether a row is usable, and its effect on the road's speed as a clamped linear function; ``old`` is the slice of the road before it."""
    limit = F.greatest(F.lit(p.min_speed), F.col("max_speed"))
    cur = slot_seq(F.col("own"))
    alpha = S.smoothing(old, cur, F.col("late") if p.late_alpha else None, p)
    sensed = F.col("sensed")
    x = F.when(F.col("kind") == "route", sensed).otherwise(S.clamp_speed(sensed, limit, p))
    usable = F.col("accepted") & (sensed <= p.max_speed)
    f = (
        F.when(F.col("accepted") & (F.col("kind") == "speed") & (sensed == 0) | F.col("accepted") & (F.col("kind") == "jam"),
               clamped.update(F.lit(0.0), F.lit(p.jam_decay), F.lit(p.min_speed), limit))
        .when(usable, clamped.update(x * (1 - alpha), alpha, F.lit(p.min_speed), limit))
        .otherwise(clamped.identity())
    )
    return usable, f


def _sensed() -> Column:
    """Speed that a row tells of."""
    return F.when(F.col("kind") == "route", F.col("length") / F.col("value")).otherwise(F.col("value"))


def _seq_before(slot: Column) -> Column:
    return F.coalesce(slot_seq(slot), F.lit(-1))


def speed_updates(admitted: DataFrame, state: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Each row's effect on the road's speed as a clamped linear function."""
    rows = admitted.join(state.select(F.col("gid").alias("road"), "length", "max_speed"), "road").withColumn("sensed", _sensed())
    usable, f = _effect(_seq_before(F.col("prior")), p)
    return rows.withColumn("usable", usable).withColumn("f", f).drop("sensed")


#: Columns of the state that observations in time order bring along.
CARRIED = ("length", "max_speed")


def timed_updates(obs: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """As :func:`admit` and :func:`speed_updates` for observations taken in time order, each looked at on its own.

    In time order slices never go back, so a row is in the newer one of its own slice and ``open_slot``, that of the road before
    this run. ``obs`` has the columns CARRIED and maybe ``open_slot``. Only the first row of a slice depends on rows before it;
    :func:`timed_slices` sees to that.
    """
    valid = F.when(F.col("kind") == "route", F.col("value") > 0).otherwise(F.col("value") >= 0)
    rows = obs.filter(valid).withColumn("own", slot_of(F.col("utc"))).withColumn("sensed", _sensed())
    rows = _fates(rows.withColumn("slot", F.greatest("own", "open_slot") if "open_slot" in obs.columns else F.col("own")), p)
    return rows.withColumn("usable", _effect(slot_seq(F.col("slot")), p)[0])


def _fates(rows: DataFrame, p: TrafficParams) -> DataFrame:
    """Whether a row in time order is late, and whether it is accepted; only where a slice was open before this run there are others."""
    if "open_slot" not in rows.columns:
        return rows.withColumn("late", F.lit(False)).withColumn("accepted", F.lit(True))
    behind = F.col("slot") - F.col("own")
    same_day = slot_day(F.col("slot")) == slot_day(F.col("own"))
    return rows.withColumn("late", behind > 0).withColumn("accepted", (behind == 0) | (same_day & (behind <= p.late_slices)))


def timed_slices(updates: DataFrame, order: list[str], chunk: Column, p: TrafficParams = TrafficParams()) -> DataFrame:
    """One composed function per road and slice of :func:`timed_updates`."""
    first = ["kind", "sensed", "max_speed"]
    opened = ["open_slot", "own"] if "open_slot" in updates.columns else []
    # Only what a row is made from moves to its slice; without a slice open before, that is its own one.
    whole = lambda df: _fates(df if opened else df.withColumn("own", F.col("slot")), p)
    rows = whole(updates.select("road", "slot", *order, *first, *opened).repartition("road", "slot"))
    rows = rows.withColumn("f", _effect(slot_seq(F.col("slot")), p)[1]).withColumn("_chunk", chunk)
    slices = clamped.gather_from(rows, ["road", "slot"], "_chunk", order, F.struct(*first, *opened))
    before = F.lag("slot").over(Window.partitionBy("road").orderBy("slot"))
    begun = whole(slices.select("road", "slot", "first.*", "rest", before.alias("_before")))
    old = _seq_before(F.coalesce("_before", *opened[:1]))
    f = _effect(F.when(F.col("late"), slot_seq(F.col("slot"))).otherwise(old), p)[1]
    return begun.withColumn("f", f).select("road", "slot", clamped.then(F.col("f"), F.col("rest")).alias("f"))


def smooth_roads(updates: DataFrame, state: DataFrame, order: list[str]) -> DataFrame:
    """Road speed at the end of every slice; ``closed`` marks all but the last."""
    return road_slices(clamped.per_slice(updates, ["road"], "slot", "_chunk", order), state)


def road_slices(slices: DataFrame, state: DataFrame, limits: tuple[int, int] | None = None) -> DataFrame:
    """Road speed at the end of every slice from one function for each; ``closed`` marks all but the last."""
    start = state.select(F.col("gid").alias("road"), F.col("avg_speed").alias("v"))
    walked = clamped.walk(slices, start, ["road"], "slot", SLICES_PER_DAY, limits=limits)
    ends = kept(walked)
    drop(walked, slices)
    # One row per road and slice: the window sees a calendar, not the observations.
    newest = F.max("slot").over(Window.partitionBy("road"))
    return (
        ends.withColumn("closed", F.col("slot") < newest)
        .join(state.select(F.col("gid").alias("road"), "base_gid", "length", "class_id", "max_speed"), "road")
        .select(
            F.col("road").alias("gid"), "base_gid", "length", "class_id", "max_speed", "slot",
            slot_day(F.col("slot")).alias("day"), slot_seq(F.col("slot")).alias("seq"),
            F.col("v").alias("avg_speed"), (F.col("length") / F.col("v")).alias("time"), "closed",
        )
    )


TURN = ["road", "next_road"]


def turning_updates(
    updates: DataFrame, order: list[str], chunk: Column, p: TrafficParams = TrafficParams(), known: DataFrame | None = None,
) -> DataFrame:
    """Effect of accepted route observations in time order on the turn they end with, one function per turn and slice.

    ``known(gid, next_gid, turn_seq)`` is the slice of each turn's last update before this run.
    """
    turns = updates.filter(F.col("usable") & (F.col("kind") == "route") & (F.col("turning_time") > 0))

    def effect(time: Column, old: Column) -> Column:
        alpha = S.smoothing(old, slot_seq(F.col("own")), None, p)
        return clamped.update(time * (1 - alpha), alpha, F.lit(p.turning_floor), F.lit(clamped.WIDE))

    dealt = turns.select(*TURN, "own", *order, "turning_time", "slot").repartition(*TURN, "own")
    rows = dealt.withColumn("f", effect(F.col("turning_time"), slot_seq(F.col("own")))).withColumn("_chunk", chunk)
    # Only the first row of an own slice follows one of another slice.
    owns = clamped.gather_from(rows, [*TURN, "own"], "_chunk", order, F.struct("turning_time", "slot"))
    before = slot_seq(F.lag("own").over(Window.partitionBy(*TURN).orderBy("own")))
    seen = owns.select(*TURN, "own", "first.*", "rest", before.alias("_before"))
    if known is not None:
        last = known.select(F.col("gid").alias("road"), F.col("next_gid").alias("next_road"), "turn_seq")
        seen = seen.join(last, TURN, "left").withColumn("_before", F.coalesce("_before", "turn_seq")).drop("turn_seq")
    f = clamped.then(effect(F.col("turning_time"), F.coalesce("_before", F.lit(0))), F.col("rest"))
    found = seen.select(*TURN, "slot", "own", f.alias("f"))
    if known is not None:
        # Late rows are in the slice that was open before this run, together with its own.
        listed = found.groupBy(*TURN, "slot").agg(F.array_sort(F.collect_list(F.struct("own", "f"))).alias("_fs"), F.max("own").alias("own"))
        found = listed.select(*TURN, "slot", "own", clamped.compose(F.transform("_fs", lambda x: x.f)).alias("f"))
    return found.select(*TURN, "slot", slot_seq(F.col("own")).alias("turn_seq"), "f")


def smooth_turnings(
    slices: DataFrame, p: TrafficParams = TrafficParams(), known: DataFrame | None = None, limits: tuple[int, int] | None = None,
) -> DataFrame:
    """Turning time per road pair at the end of every slice with an update; ``known(gid, next_gid, time)`` is where turns start."""
    start = None
    if known is not None:
        start = known.select(F.col("gid").alias("road"), F.col("next_gid").alias("next_road"), F.col("time").alias("v"))
    ends = clamped.walk(slices, start, TURN, "slot", SLICES_PER_DAY, p.turning_default, ("turn_seq",), limits)
    return ends.select(
        F.col("road").alias("gid"), F.col("next_road").alias("next_gid"), "slot",
        slot_day(F.col("slot")).alias("day"), slot_seq(F.col("slot")).alias("seq"), F.col("v").alias("time"), "turn_seq",
    )


def closed_turnings(turnings: DataFrame, roads: DataFrame) -> DataFrame:
    """Turning rows of closed road slices whose last update was in that slice."""
    closed = roads.filter("closed").select("gid", "slot")
    return turnings.filter(F.col("turn_seq") == F.col("seq")).join(closed, ["gid", "slot"], "left_semi")


ORDER = ["utc", "suid", "pos"]


def minute_chunk() -> Column:
    return F.floor(F.col("utc") / 60)


def road_speeds(pairs: DataFrame, state: DataFrame, turning: DataFrame | None = None, p: TrafficParams = TrafficParams()) -> tuple[DataFrame, DataFrame]:
    """Road and turning slices of a batch of pairs, in time order."""
    # Kept, since the routes would be exploded and priced again for every use below.
    obs = kept(observations(pairs, state, turning, p, CARRIED))
    updates = timed_updates(obs, p)
    limits = tuple(updates.agg(F.min("slot"), F.max("slot")).first())
    limits = None if None in limits else limits
    roads = road_slices(timed_slices(updates, ORDER, minute_chunk(), p), state, limits)
    found = smooth_turnings(turning_updates(updates, ORDER, minute_chunk(), p), p, None, limits)
    turns = kept(found)
    drop(found, obs)
    drop(obs)
    return roads, turns


# -- gaps and history -------------------------------------------------------------

def infer_gaps(roads: DataFrame, history: DataFrame, class_history: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """Speeds for up to ``infer_slices`` empty slices after each closed one.

    The history of the empty slice is scaled by how the last sensed slice
    compares with its own history, and kept near both the sensed speed and the
    history by bounds made from class speeds.
    """
    ahead = Window.partitionBy("gid").orderBy("slot")
    following = roads.withColumn("next_seq", F.lead("seq").over(ahead)).filter(F.col("next_seq").isNotNull())
    stop = F.least(F.col("seq") + p.infer_slices, F.col("next_seq") - 1)
    gaps = following.filter(stop > F.col("seq")).select(
        "gid", "base_gid", "class_id", "length", "max_speed", "day", F.col("seq").alias("pre_seq"), F.col("avg_speed").alias("v"),
        F.explode(F.sequence(F.col("seq") + 1, stop)).alias("seq"),
    )
    own = history.select("gid", "seq", F.col("average_speed").alias("h"))
    cls = class_history.select("class_id", "seq", F.col("average_speed").alias("c"))
    joined = (
        gaps.join(own.select("gid", F.col("seq").alias("pre_seq"), F.col("h").alias("h_pre")), ["gid", "pre_seq"])
        .join(own, ["gid", "seq"])
        .join(cls.select("class_id", F.col("seq").alias("pre_seq"), F.col("c").alias("c_pre")), ["class_id", "pre_seq"], "left")
        .join(cls, ["class_id", "seq"], "left")
        .filter((F.col("h_pre") > 0) & (F.col("h") > 0))
    )
    across = p.infer_factor * (F.col("seq") - F.col("pre_seq")) * F.coalesce("c_pre", F.lit(0.0))
    along = p.infer_factor * F.coalesce("c", F.lit(0.0))
    top = F.least(F.col("v") + across, F.col("h") + along)
    bottom = F.greatest(F.col("v") - across, F.col("h") - along)
    guess = F.greatest(bottom, F.least(top, F.col("h") * (F.col("v") / F.col("h_pre"))))
    return (
        joined.filter(top > bottom)
        .withColumn("avg_speed", S.clamp_speed(guess, F.col("max_speed"), p))
        .filter(F.col("avg_speed") > 0)
        .select("gid", "base_gid", "class_id", "length", "day", "seq", "avg_speed", (F.col("length") / F.col("avg_speed")).alias("time"))
    )


def with_history(rows: DataFrame, history: DataFrame, class_history: DataFrame) -> DataFrame:
    """Own and class history of each road and slice; zero counts as missing."""
    own = history.select("gid", "seq", F.nullif("average_speed", F.lit(0.0)).alias("history_speed"))
    cls = class_history.select("class_id", "seq", F.nullif("average_speed", F.lit(0.0)).alias("class_speed"))
    return rows.join(own, ["gid", "seq"], "left").join(cls, ["class_id", "seq"], "left")


def real_road_rows(roads: DataFrame, inferred: DataFrame) -> DataFrame:
    """Rows of the road table: sensed slices and inferred ones."""
    columns = ["day", "seq", "gid", "base_gid", "length", "class_id", "time", F.col("avg_speed").alias("average_speed")]
    sensed = roads.filter("closed").select(*columns, F.lit(True).alias("is_sensed"))
    guessed = inferred.select(*columns, F.lit(False).alias("is_sensed"))
    return sensed.unionByName(guessed).withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).drop("day")


def update_history(history: DataFrame, rows: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    """History after a run: old rows move toward the latest speed, new ones enter."""
    latest = rows.groupBy("gid", "seq").agg(
        F.max_by(F.struct("base_gid", "length", "class_id", "average_speed"), "date").alias("n")
    )
    old = history.select("gid", "seq", F.struct("base_gid", "length", "class_id", "average_speed").alias("o"))
    speed = (
        F.when(F.col("n").isNull(), F.col("o.average_speed"))
        .when(F.col("o.average_speed") > 0,
              F.col("o.average_speed") * p.history_keep + F.col("n.average_speed") * (1 - p.history_keep))
        .otherwise(F.col("n.average_speed"))
    )
    merged = old.join(latest, ["gid", "seq"], "full")
    return merged.select(
        "gid", "seq",
        F.coalesce("o.base_gid", "n.base_gid").alias("base_gid"),
        F.coalesce("o.length", "n.length").alias("length"),
        F.coalesce("o.class_id", "n.class_id").alias("class_id"),
        speed.alias("average_speed"),
        F.col("n").isNotNull().alias("changed"),
    ).withColumn("time", F.col("length") / F.col("average_speed"))
