"""Order-dependent operators as folds over a key's rows, runnable in batch and in Structured Streaming alike.

A machine is a small object: ``step(row)`` takes rows of one key in event order and returns the output row or None.
In batch a key's rows are folded in one go; in a stream the machine is kept, pickled, in the key's state, together
with the rows that event time has not passed yet.
"""

from __future__ import annotations

import math
import pickle
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointweave.streaming import runs


def _stepped(machine, rows: pd.DataFrame, order: list[str], columns: list[str]) -> pd.DataFrame:
    rows = rows.sort_values(order)
    each = zip(*(rows[c] for c in rows.columns), strict=True)  # one row at a time, not a dictionary for each
    out = [r for row in each if (r := machine.step(dict(zip(rows.columns, row, strict=True)))) is not None]
    return pd.DataFrame(out, columns=columns)


def fold(rows: DataFrame, by: list[str], order: list[str], make: Callable, schema: str) -> DataFrame:
    """Batch form: one machine per key over its rows in order. A key's rows are held in one task: keys are to be bounded."""
    columns = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(*by).applyInPandas(lambda pdf: _stepped(make(), pdf, order, columns), schema)


@dataclass
class Reordered:
    """What a stream keeps of a key: its machine, rows that may still be overtaken, and how many came too late."""

    machine: object
    waiting: pd.DataFrame | None = None
    last_ms: int = 0
    late: int = 0


def fold_stream(
    rows: DataFrame, by: list[str], order: list[str], make: Callable, schema: str, time: str = "ts", delay: str = "40 days", late: str | None = None, idle: str | None = None, grace: str = "3650 days"
) -> DataFrame:
    """Stream form in event time: equals the batch form however rows are dealt to micro-batches, if none is over ``delay`` late.

    Rows wait in their key's state until event time, the greatest ``time`` seen anywhere less ``delay``, has passed
    them; timers then release them in order, so keys that get no more rows are released too. A row that comes after
    event time has passed it is not stepped, but counted: with ``late``, a long column of the schema, every output row
    tells how many rows of its key came too late before it, and a late row gives a row of its own that has nothing but
    the key and this count. Spark's own watermark trails by ``grace`` more, so that it drops none of them before they
    are counted; event times lie more than ``grace`` after 1970, where watermarks begin.

    With ``idle``, a key whose newest row event time has passed by that much loses its state. Without, machines stay.
    A stream over a finite table is closed by runs.append_all, which releases what still waits.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    own = [c for c in columns if c != late]
    ms = {k: int(pd.Timedelta(v).total_seconds() * 1000) if v else None for k, v in (("delay", delay), ("grace", grace), ("idle", idle))}
    rows = runs.with_end(rows.withColumnRenamed(time, "_time"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([pdf for pdf in batches]) if not state.hasTimedOut else None
        if fresh is not None:
            fresh = fresh[~fresh["_end"]].drop(columns=["_end"])
            if not len(fresh) and not state.exists:
                return
        kept: Reordered = pickle.loads(state.get[0]) if state.exists else Reordered(make())
        mark = state.getCurrentWatermarkMs()
        passed = mark + ms["grace"] if mark > 0 else 0
        out = []
        if fresh is not None and len(fresh):
            at = fresh["_time"].astype("datetime64[ms]").astype("int64")
            kept.last_ms = max(kept.last_ms, int(at.max()))
            too_late = at < passed
            if too_late.any():
                kept.late += int(too_late.sum())
                if late:
                    out.append(pd.DataFrame([dict(zip(by, key, strict=True)) | {late: kept.late}], columns=columns))
            fresh = fresh[~too_late].assign(_ms=at[~too_late])
            kept.waiting = fresh if kept.waiting is None else pd.concat([kept.waiting, fresh])
        if kept.waiting is not None:
            due = kept.waiting["_ms"] < passed
            if due.any():
                stepped = _stepped(kept.machine, kept.waiting[due].drop(columns=["_time", "_ms"]), order, own)
                out.append(stepped.assign(**{late: kept.late}) if late else stepped)
            kept.waiting = None if due.all() else kept.waiting[~due]
        if kept.waiting is not None:
            state.update((cloudpickle.dumps(kept),))
            state.setTimeoutTimestamp(max(int(kept.waiting["_ms"].min()) - ms["grace"] + 1, mark + 1))
        elif ms["idle"] is not None and kept.last_ms + ms["idle"] < passed:
            state.remove()
        else:
            state.update((cloudpickle.dumps(kept),))
            if ms["idle"] is not None:
                state.setTimeoutTimestamp(max(kept.last_ms + ms["idle"] - ms["grace"] + 1, mark + 1))
        for pdf in out:
            yield pdf[columns]

    marked = rows.withWatermark("_time", f"{ms['delay'] + ms['grace']} milliseconds")
    out = marked.groupBy(*by).applyInPandasWithState(run, schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)
    out.end_folder = rows.end_folder
    return out


class Keyframes:
    """Accepts a row at least ``interval`` after the last accepted one, up to ``capacity``; says why it does not."""

    def __init__(self, key: str, interval: int, capacity: int = 1 << 30):
        self.key, self.interval, self.capacity = key, interval, capacity
        self.last_seen = self.last = None
        self.count = 0

    def step(self, row: dict) -> dict:
        t = int(row["t_us"])
        if self.last_seen is not None and t <= self.last_seen:
            status = "nonmonotonic" if t < self.last_seen else "duplicate"
        elif self.last is not None and t - self.last < self.interval:
            status = "insufficient"
        elif self.count >= self.capacity:
            status = "capacity"
        else:
            status, self.last, self.count = "accepted", t, self.count + 1
        self.last_seen = t if self.last_seen is None else max(self.last_seen, t)
        return {self.key: row[self.key], "t_us": t, "status": status}


class BoundedQueue:
    """Rows that one worker serves in order, ``depth`` of them waiting at most: what comes to a full queue is dropped and counted."""

    def __init__(self, key: str, depth: int):
        self.key, self.depth, self.ends, self.dropped = key, depth, deque(), 0

    def step(self, row: dict) -> dict:
        t = int(row["t_us"])
        while self.ends and self.ends[0] <= t:
            self.ends.popleft()
        served = len(self.ends) <= self.depth  # the first of them is being served
        wait = None
        if served:
            begin = self.ends[-1] if self.ends else t
            wait = begin - t
            self.ends.append(begin + int(row["cost"]))
        else:
            self.dropped += 1
        return {self.key: row[self.key], "event_id": int(row["event_id"]), "served": served, "wait": wait, "dropped": self.dropped}


class Throttle:
    """Publishes a snapshot when the last one is long enough ago: ``factor`` times what it cost, within bounds."""

    def __init__(self, key: str, factor: int, least: int, most: int):
        self.key, self.factor, self.least, self.most, self.next = key, factor, least, most, None

    def step(self, row: dict) -> dict:
        t = int(row["t_us"])
        publish = self.next is None or t >= self.next
        if publish:
            self.next = t + min(max(self.factor * int(row["cost"]), self.least), self.most)
        return {self.key: row[self.key], "event_id": int(row["event_id"]), "published": publish}


class PoseBuffer:
    """Appends poses in order, answers queries from them: interpolated inside, held for a while after, else nothing."""

    def __init__(self, key: str, most_extrapolation: int, size: int = 1024):
        self.key, self.most, self.poses = key, most_extrapolation, deque(maxlen=size)

    def step(self, row: dict) -> dict | None:
        t = int(row["t_us"])
        if row["kind"] == "pose":
            if not self.poses or t > self.poses[-1][0]:
                self.poses.append((t, int(row["v_cent"])))
            return None
        out = {self.key: row[self.key], "event_id": int(row["event_id"]), "mode": "none", "v": None}
        if self.poses and t >= self.poses[0][0]:
            t1, v1 = self.poses[-1]
            if t > t1:
                if t - t1 <= self.most:
                    out |= {"mode": "held", "v": v1}
            else:
                at = next(k for k in range(len(self.poses) - 1, -1, -1) if self.poses[k][0] <= t)
                t0, v0 = self.poses[at]
                if t == t0:
                    v = v0
                else:
                    ta, va = self.poses[at + 1]
                    v = math.floor(v0 + (va - v0) * (t - t0) / (ta - t0))
                out |= {"mode": "inside", "v": v}
        return out


class Pairing:
    """Pairs rows of two kinds with the same stamp in any order; unmatched ones are bounded, the oldest go first."""

    def __init__(self, key: str, capacity: int):
        self.key, self.capacity, self.waiting, self.evicted = key, capacity, OrderedDict(), 0

    def step(self, row: dict) -> dict | None:
        stamp, kind = row["stamp"], row["kind"]
        other = self.waiting.get(stamp)
        if other is not None and other != kind:
            del self.waiting[stamp]
            return {self.key: row[self.key], "stamp": int(stamp), "evicted": self.evicted}
        self.waiting[stamp] = kind
        if len(self.waiting) > self.capacity:
            self.waiting.popitem(last=False)
            self.evicted += 1
        return None


class Revisions:
    """Takes pose-graph revisions whose version grows and whose times extend the last ones; the first bad one rejects all after it."""

    def __init__(self, key: str):
        self.key, self.version, self.times, self.broken = key, -1, (), False

    def step(self, row: dict) -> dict:
        times = tuple(int(t) for t in row["times"])
        good = row["version"] > self.version and times[: len(self.times)] == self.times and all(a < b for a, b in zip(times, times[1:], strict=False))
        self.broken |= not good
        if not self.broken:
            self.version, self.times = int(row["version"]), times
        return {self.key: row[self.key], "version": int(row["version"]), "accepted": not self.broken}


class Sessions:
    """Follows restarts: a new session retires the old one, whose late rows are rejected."""

    def __init__(self, key: str):
        self.key, self.current, self.retired = key, None, set()

    def step(self, row: dict) -> dict:
        session = row["session"]
        accepted = session not in self.retired
        if accepted and session != self.current:
            if self.current is not None:
                self.retired.add(self.current)
            self.current = session
        return {self.key: row[self.key], "event_id": int(row["event_id"]), "session": session, "accepted": accepted}


class Claims:
    """Packets wait, in a bounded queue, for a graph that covers their stamp; each is claimed once.

    The oldest are evicted from a full queue, and so are those that are ``lifetime`` older than the newest stamp seen.
    """

    def __init__(self, key: str, capacity: int, lifetime: float = math.inf):
        self.key, self.capacity, self.lifetime, self.pending, self.graph, self.newest = key, capacity, lifetime, deque(), None, -math.inf

    def step(self, row: dict) -> dict | None:
        self.newest = max(self.newest, int(row["stamp"]))
        if row["kind"] == "graph":
            self.graph = int(row["stamp"]) if self.graph is None else max(self.graph, int(row["stamp"]))
        else:
            self.pending.append(int(row["stamp"]))
        evicted = []
        while self.pending and (len(self.pending) > self.capacity or self.newest - self.pending[0] > self.lifetime):
            evicted.append(self.pending.popleft())
        claimed = []
        while self.pending and self.graph is not None and self.pending[0] <= self.graph:
            claimed.append(self.pending.popleft())
        if not claimed and not evicted:
            return None
        return {self.key: row[self.key], "claimed": claimed, "evicted": evicted}


class Ledger:
    """Votes of a cell with a lifetime: one raw vote per frame, the newest ``depth`` ones, still valid at the limit."""

    def __init__(self, key: str, depth: int, lifetime: int):
        self.key, self.depth, self.lifetime, self.votes = key, depth, lifetime, deque()

    def step(self, row: dict) -> dict:
        t = int(row["t_us"])
        while self.votes and t - self.votes[0][0] > self.lifetime:
            self.votes.popleft()
        seen = len(self.votes)
        counts: dict[int, int] = {}
        for _, label in self.votes:
            counts[label] = counts.get(label, 0) + 1
        best = min(counts, key=lambda k: (-counts[k], k)) if counts else -1
        if not self.votes or self.votes[-1][0] != t:
            self.votes.append((t, int(row["label"])))
            if len(self.votes) > self.depth:
                self.votes.popleft()
        return {self.key: row[self.key], "event_id": int(row["event_id"]), "evidence": seen, "label": best}


class Instances:
    """Semantics of tracked instances in a session, from observations (track, stamp, centre, posterior).

    A track keeps its identity while it moves as predicted and no other track's prediction is as near; up to four past
    raw posteriors add at most one observation's weight; decisive present evidence resets the history, contrary present
    evidence vetoes a label that only history supports. Tracks expire, and the most recent ones are kept.
    """

    def __init__(self, key: str, lifetime: float = 2.0, depth: int = 4, decay: float = 1.5, most: int = 128, least: float = 0.6, margin: float = 0.15, decisive: float = 0.85, slack: float = 0.75, speed: float = 2.0):
        self.key, self.lifetime, self.depth, self.decay, self.most = key, lifetime, depth, decay, most
        self.least, self.margin, self.decisive, self.slack, self.speed = least, margin, decisive, slack, speed
        self.session, self.tracks, self.epochs = None, {}, 0

    def _predicted(self, track: dict, t: float) -> float:
        past = track["past"]
        if len(past) < 2 or past[-1]["t"] <= past[-2]["t"]:
            return past[-1]["x"]
        v = (past[-1]["x"] - past[-2]["x"]) / (past[-1]["t"] - past[-2]["t"])
        return past[-1]["x"] + (v * (t - past[-1]["t"]) if abs(v) <= 20 else 0.0)

    def step(self, row: dict) -> dict:
        t, x, track_id = float(row["t"]), float(row["x"]), int(row["track"])
        p = [float(v) for v in row["p"]]
        if row["session"] != self.session:
            self.session, self.tracks = row["session"], {}
        self.tracks = {k: s for k, s in self.tracks.items() if t - s["past"][-1]["t"] <= self.lifetime}
        track, reason = self.tracks.get(track_id), "new"
        if track is not None:
            reason, ahead = "accepted", self._predicted(track, t)
            reach = self.slack + self.speed * (t - track["past"][-1]["t"])
            if t <= track["past"][-1]["t"]:
                reason = "reused"
            elif abs(x - ahead) > reach:
                reason = "motion"
            elif any(abs(x - self._predicted(s, t)) < abs(x - ahead) + 0.35 for k, s in self.tracks.items() if k != track_id):
                reason = "competing"
        past, state = [], list(p)
        if reason == "accepted":
            past, epoch = track["past"], track["epoch"]
            if p.index(max(p)) != track["state"].index(max(track["state"])) and max(p) >= self.decisive:
                past, reason = [], "reset"
            else:
                w = [math.exp(-(t - o["t"]) / self.decay) for o in past]
                w = [v / max(1.0, sum(w)) for v in w]
                state = [(c + sum(v * o["p"][k] for v, o in zip(w, past, strict=True))) / (1 + sum(w)) for k, c in enumerate(p)]
        else:
            self.epochs += 1
            epoch = self.epochs
        first, second = sorted(state, reverse=True)[:2]
        best, own = state.index(first), sorted(p, reverse=True)
        sure = first >= self.least and first - second >= self.margin
        contrary = p.index(own[0]) != best and own[0] >= self.least and own[0] - p[best] >= self.margin
        if sure and past and contrary:
            sure, past, state, reason = False, [], list(p), "conflict"
        past = [*past, {"t": t, "x": x, "p": p}][-self.depth :]
        self.tracks[track_id] = {"past": past, "state": state, "epoch": epoch}
        if len(self.tracks) > self.most:
            newest = sorted(self.tracks, key=lambda k: -self.tracks[k]["past"][-1]["t"])[: self.most]
            self.tracks = {k: self.tracks[k] for k in newest}
        return {self.key: row[self.key], "track": track_id, "t": t, "epoch": epoch, "reason": reason, "label": best if sure else -1}
