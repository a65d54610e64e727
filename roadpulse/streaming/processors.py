"""Per-vehicle state of the streaming pipeline."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadpulse.operators.matching import advance, unpack, window_update
from roadpulse.params import MatchParams, TrafficParams


class ThinProcessor(StatefulProcessor):
    """Keeps a point when it is ``min_gap`` seconds after the last kept one.

    Rows of a batch are put in time order; rows at or before the last kept
    second are out of order and dropped. A key is a vehicle or a group of them.
    """

    def __init__(self, columns: list[str], p: TrafficParams = TrafficParams(), ttl_ms: int | None = None):
        self.columns = columns
        self.gap = p.min_gap
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "suid bigint, utc bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["suid", "utc", "event_id"], kind="stable")
        last = dict(self.last.get()) if self.last.exists() else {}
        kept = []
        # Rows without a vehicle have a key of their own.
        vehicles = pdf["suid"].tolist() if key[0] is not None else [None] * len(pdf)
        for i, (suid, utc) in enumerate(zip(vehicles, pdf["utc"].tolist())):
            if suid not in last or utc >= last[suid] + self.gap:
                kept.append(i)
                last[suid] = int(utc)
        self.last.put(list(last.items()))
        yield pdf.iloc[kept][self.columns]

    def close(self) -> None:
        pass


class FateProcessor(StatefulProcessor):
    """Thinning that loses no row: each comes out with its ``fate`` and the newest second seen before it.

    A row older than one of its vehicle that came in an earlier batch is ``out_of_order``; of the others those at least
    ``min_gap`` seconds after the last kept one are ``kept``, the rest is ``thinned``. A key is a group of vehicles.
    """

    def __init__(self, columns: list[str], p: TrafficParams = TrafficParams()):
        self.columns = columns
        self.gap = p.min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getListState("marks", "suid bigint, kept bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["suid", "utc", "event_id"], kind="stable")
        marks = {suid: (kept, seen) for suid, kept, seen in self.marks.get()} if self.marks.exists() else {}
        fates, before = [], []
        # Rows without a vehicle have a group of their own.
        vehicles = pdf["suid"].tolist() if key[0] is not None else [None] * len(pdf)
        for suid, utc in zip(vehicles, pdf["utc"].tolist()):
            kept, seen = marks.get(suid, (None, None))
            before.append(seen)
            if seen is not None and utc < seen:
                fates.append("out_of_order")
                continue
            if kept is None or utc >= kept + self.gap:
                kept = utc
                fates.append("kept")
            else:
                fates.append("thinned")
            marks[suid] = int(kept), int(utc)
        self.marks.put([(suid, *mark) for suid, mark in marks.items()])
        out = pdf[self.columns].copy()
        out["fate"], out["seen"] = fates, pd.array(before, dtype="Int64")
        yield out

    def close(self) -> None:
        pass


class IdleProcessor(StatefulProcessor):
    """A vehicle's visit: its points until it is idle for ``ttl_ms`` of processing time.

    A timer ends the visit and emits it; a point that comes later, even in the batch that would have fired the timer, begins
    the next one.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "first bigint, last bigint, n bigint, touched bigint")

    def _frame(self, key, visits: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *v[:3]) for v in visits], columns=["suid", "first", "last", "n"])

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        seconds = pd.concat(list(rows))["utc"]
        ended, visit = [], tuple(self.visit.get()) if self.visit.exists() else None
        if visit and now - visit[3] >= self.ttl_ms:
            ended, visit = [visit], None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        low, high, n = int(seconds.min()), int(seconds.max()), len(seconds)
        self.visit.update((min(low, visit[0]), max(high, visit[1]), n + visit[2], now) if visit else (low, high, n, now))
        self.handle.registerTimer(now + self.ttl_ms)
        yield self._frame(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ended = [tuple(self.visit.get())] if self.visit.exists() else []
        self.visit.clear()
        yield self._frame(key, ended)

    def close(self) -> None:
        pass


VISIT_SCHEMA = "suid bigint, first bigint, last bigint, n bigint"


class SlideProcessor(StatefulProcessor):
    """Sliding window of a vehicle's samples by count, by age, or both, without emission of what leaves it.

    After each sample it says how many samples the window holds and which is the oldest. ``k`` keeps that many samples
    before the newest, ``age`` those at most that many seconds older; older rows than the newest are dropped.
    """

    def __init__(self, k: int = -1, age: int = 0):
        self.k, self.age = k, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "utc bigint")

    def handleInputRows(self, key, rows, timerValues):
        window = deque(r[0] for r in self.window.get()) if self.window.exists() else deque()
        out = []
        for utc in sorted(pd.concat(list(rows))["utc"].tolist()):
            if window and utc < window[-1]:
                continue
            window.append(utc)
            while (self.k >= 0 and len(window) > self.k + 1) or (self.age > 0 and utc - window[0] > self.age):
                window.popleft()
            out.append((key[0], utc, len(window), window[0]))
        self.window.put([(int(utc),) for utc in window])
        yield pd.DataFrame(out, columns=["suid", "utc", "n", "oldest"])

    def close(self) -> None:
        pass


SLIDE_SCHEMA = "suid bigint, utc bigint, n bigint, oldest bigint"


class PreviousProcessor(StatefulProcessor):
    """Adds the roads of the vehicle's previous sample with candidates."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "utc bigint, slon double, slat double, roads array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("utc", kind="stable")
        before = tuple(self.before.get()) if self.before.exists() else None
        out = []
        for r in pdf.itertuples(index=False):
            if before is not None and r.utc <= before[0]:
                continue
            out.append((r.suid, r.date, r.utc, r.slon, r.slat, r.cs_json, *(before[:3] if before else (None, None, None)),
                        list(before[3]) if before else None))
            before = (int(r.utc), float(r.slon), float(r.slat), [int(x) for x in r.roads])
        if before is not None:
            self.before.update(before)
        frame = pd.DataFrame(out, columns=["suid", "date", "utc", "slon", "slat", "cs_json", "pre_utc", "pre_slon", "pre_slat", "pre_roads"])
        frame["pre_utc"] = frame["pre_utc"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


PREVIOUS_SCHEMA = (
    "suid bigint, date string, utc bigint, slon double, slat double, cs_json string, "
    "pre_utc bigint, pre_slon double, pre_slat double, pre_roads array<bigint>"
)

CONVERGED_SCHEMA = (
    "suid bigint, date string, utc bigint, gid bigint, offset double, lon double, lat double, route array<bigint>, broke boolean"
)


class MatchProcessor(StatefulProcessor):
    """Online matching with delayed correction.

    The state is the open window: at most ``window`` + 1 samples with their
    surviving candidates. A sample emits at most one converged point.
    """

    def __init__(self, p: MatchParams = MatchParams(), ttl_ms: int | None = None):
        self.p = p
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "body string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("utc", kind="stable")
        window = json.loads(self.window.get()[0]) if self.window.exists() else []
        out = []
        for row in pdf.itertuples(index=False):
            if window and row.utc < window[-1]["utc"]:
                continue
            cands, routes = unpack(row)
            newest = window[-1] if window else None
            seconds = float(row.utc - newest["utc"]) if newest else None
            vector, broke = advance(
                newest["vector"] if newest else [], seconds, row.straight, (row.slon, row.slat), cands, routes, self.p)
            emitted = window_update(window, vector, {"utc": int(row.utc), "date": row.date, "broke": broke}, self.p)
            if emitted:
                c = emitted["candidate"]
                out.append((key[0], emitted["date"], emitted["utc"], c["road"], c["fraction"], c["lon"], c["lat"], c["path"], emitted["broke"]))
        self.window.update((json.dumps(window),))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in CONVERGED_SCHEMA.split(", ")])

    def close(self) -> None:
        pass
