"""Scalar expressions of the traffic model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.params import DAY_SECONDS, SLICE_SECONDS, SLICES_PER_DAY, MatchParams, TrafficParams


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slice_number(utc: Column, start_utc: Column, end_utc: Column) -> Column:
    """Five-minute slice 1..288, counted back from the end of the day.

    Division truncates toward zero; the first second of the day belongs to
    slice 1, earlier points wrap to the day before, later ones stay in 288.
    """
    behind = (end_utc - utc).cast("bigint")
    steps = F.when(behind >= 0, F.floor(behind / SLICE_SECONDS)).otherwise(
        F.ceil(behind / SLICE_SECONDS)
    ).cast("bigint")
    raw = SLICES_PER_DAY - steps
    first = F.when((raw == 0) & (utc == start_utc), F.lit(1).cast("bigint")).otherwise(raw)
    wrapped = F.when(
        first <= 0, F.pmod(first - 1, F.lit(SLICES_PER_DAY)) + 1
    ).otherwise(first)
    return F.least(wrapped, F.lit(SLICES_PER_DAY).cast("bigint"))


def day_slice(utc: Column) -> Column:
    """Slice number when the day is the calendar day of ``utc``."""
    start = utc - F.pmod(utc, F.lit(DAY_SECONDS))
    return slice_number(utc, start, start + DAY_SECONDS)


def slice_distance(old: Column, new: Column) -> Column:
    return F.pmod(new - old, F.lit(SLICES_PER_DAY))


def smoothing(old: Column, new: Column, late: Column | None = None, p: TrafficParams = TrafficParams()) -> Column:
    """Weight of the previous value, falling by a step per elapsed slice."""
    alpha = F.greatest(
        F.lit(0.0),
        F.least(F.lit(p.smooth_base), F.lit(p.smooth_base) - slice_distance(old, new) * F.lit(p.smooth_step)),
    )
    return alpha if late is None else F.when(late, F.lit(p.late_alpha)).otherwise(alpha)


def clamp_speed(speed: Column, limit: Column, p: TrafficParams = TrafficParams()) -> Column:
    return F.greatest(F.lit(p.min_speed), F.least(speed, limit))


def road_limit(maxspeed: Column, p: TrafficParams = TrafficParams()) -> Column:
    return F.least(maxspeed.cast("double"), F.lit(p.max_speed))


def floor_turning(time: Column, p: TrafficParams = TrafficParams()) -> Column:
    return F.greatest(time, F.lit(p.turning_floor))


def segment_speed(offset_from: Column, offset_to: Column, length: Column, seconds: Column) -> Column:
    return F.when(seconds != 0, F.abs(offset_to - offset_from) * length / seconds)


def directed_id(gid: Column, forward: Column) -> Column:
    return F.when(forward, gid * 2).otherwise(gid * 2 + 1).cast("bigint")


def base_id(directed: Column) -> Column:
    return F.shiftright(directed.cast("bigint"), 1)


def is_forward(directed: Column) -> Column:
    return F.pmod(directed, F.lit(2)) == 0


# -- edge costs -------------------------------------------------------------

def cost_distance(length: Column, maxspeed: Column, priority: Column) -> Column:
    return length.cast("double")


def cost_time(length: Column, maxspeed: Column, priority: Column) -> Column:
    return length * 3.6 / F.least(maxspeed.cast("double"), F.lit(130.0))


def cost_time_priority(length: Column, maxspeed: Column, priority: Column) -> Column:
    return cost_time(length, maxspeed, priority) * F.greatest(F.lit(1.0), priority.cast("double"))


COSTS = {"distance": cost_distance, "time": cost_time, "time_priority": cost_time_priority}


# -- hidden Markov model ----------------------------------------------------

def emission(dist: Column, p: MatchParams = MatchParams()) -> Column:
    var = p.sigma * p.sigma
    power = dist * dist if p.squared_emission else dist
    return F.lit(1 / math.sqrt(2 * math.pi * var)) * F.exp(-power / (2 * var))


def transition_scale(delta_ms: Column, p: MatchParams = MatchParams()) -> Column:
    if p.lam:
        return F.lit(1 / p.lam)
    return 2.0 * F.greatest(F.lit(1.0), delta_ms.cast("double")) / 1000


def transition(cost: Column, straight: Column, delta_ms: Column, p: MatchParams = MatchParams()) -> Column:
    beta = transition_scale(delta_ms, p)
    return (1 / beta) * F.exp(-F.greatest(F.lit(0.0), cost - straight / 60) / beta)


def search_bound(delta_ms: Column, p: MatchParams = MatchParams()) -> Column:
    seconds = F.floor(delta_ms / 1000)
    return F.greatest(
        F.lit(p.min_bound), F.least(F.lit(p.max_distance), (seconds * p.bound_speed).cast("double"))
    )


# -- values on a ring -------------------------------------------------------

RING_EPSILON = 1e-10


def ring_modulo(value: Column, modulo) -> Column:
    return F.pmod(value.cast("double"), F.lit(abs(float(modulo))))


def ring_round(value: Column) -> Column:
    whole = F.floor(value).cast("double")
    return whole + F.floor((value - whole) * 1e10 + 0.5) / 1e10


def tolerant_compare(left: Column, right: Column) -> Column:
    return (
        F.when(F.abs(left - right) < RING_EPSILON, F.lit(0))
        .when(left < right, F.lit(-1))
        .otherwise(F.lit(1))
    )


def ring_between(left: Column, right: Column, value: Column, modulo) -> Column:
    """True when the value lies in [left, right) walking upward on the ring."""
    full = abs(float(modulo))
    span = ring_modulo(right - left, modulo)
    ahead = ring_modulo(value - left, modulo)
    at_left = (ahead < RING_EPSILON) | (full - ahead < RING_EPSILON)
    return at_left | (ahead < span - RING_EPSILON)


def ring_distance(left: Column, right: Column, modulo) -> Column:
    return F.when(right >= left, right - left).otherwise(F.lit(float(modulo)) - left + right)
