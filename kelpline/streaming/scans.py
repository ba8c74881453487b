"""Ordered scans over streams whose rows come out of order, with state that ends.

Rows of a group wait in a list state until the watermark passes them; an
event-time timer then releases them in order to a fold (windows, averages,
differences), whose own state is a value. Rows further apart than ``gap``
belong to different sessions; once the watermark is a gap past a session's last
row, a timer closes it and its state goes. A row at or before the watermark when
it comes is late and dropped, as everywhere in Structured Streaming.

What a scan gives equals its batch form over the sessions of all rows the
watermark has passed, however files and batches cut them. State of a group:
the rows of one lateness and the fold's value. Many small groups share a key,
a bucket, so that a call is not made for each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State that outlives a task is kept by this store, the one that lists and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def state_store(spark: SparkSession):
    """Streams started within keep their state in the store of :data:`STORE`."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Windows:
    """Greedy windows of ``length`` rows: start (row of the session), visible_frac, mean_motion. A scan of ``most`` windows stops there."""

    state, out = "visible array<double>, motion array<double>, at long, found long", "start long, visible_frac double, mean_motion double"

    def __init__(self, *, length: int = 20, step: int = 20, threshold: float = 0.5, least_share: float = 0.5, least_motion: float | None = None, most: int | None = None):
        if step > length:
            raise ValueError("rows between windows aren't kept: step <= length")
        self.length, self.step_, self.threshold, self.least_share, self.least_motion, self.most = length, step, threshold, least_share, least_motion, most

    def fresh(self) -> tuple:
        return [], [], 0, 0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        visible, motion, at, found = list(state[0]), list(state[1]), state[2], state[3]
        out, n = [], self.length
        for _, v, m in rows:
            if self.most is not None and found >= self.most:
                return ([], [], at, found), out
            visible.append(v)
            motion.append(m)
            while len(visible) >= n:
                share, mean = sum(x >= self.threshold for x in visible[:n]) / n, sum(motion[:n]) / n
                good = share > self.least_share and (self.least_motion is None or mean >= self.least_motion)
                if good:
                    out.append((at, share, mean))
                    found += 1
                ahead = self.step_ if good else 1
                visible, motion, at = visible[ahead:], motion[ahead:], at + ahead
        return (visible, motion, at, found), out

    def finish(self, state: tuple) -> list[tuple]:
        return []


class Average:
    """The exponential average of a session, once it is closed: ema, n."""

    state, out = "ema double, n long", "ema double, n long"

    def __init__(self, alpha: float = 0.45):
        self.alpha = alpha

    def fresh(self) -> tuple:
        return None, 0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        e, n = state
        for _, x in rows:
            e = x if e is None else self.alpha * x + (1 - self.alpha) * e
        return (e, n + len(rows)), []

    def finish(self, state: tuple) -> list[tuple]:
        return [tuple(state)]


class Differences:
    """Of each row its order and the absolute change from the row before; 0 for a session's first."""

    state = "last double"

    def __init__(self, order_type: str = "long"):
        self.out = f"row {order_type}, difference double"

    def fresh(self) -> tuple:
        return (None,)

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        (last,), out = state, []
        for order, x in rows:
            out.append((order, 0.0 if last is None else abs(x - last)))
            last = x
        return (last,), out

    def finish(self, state: tuple) -> list[tuple]:
        return []


class OrderedScan(StatefulProcessor):
    """A fold over groups' rows in order of time and order column; a key holds one group or a bucket of many.

    ``pending`` has an Arrow batch for each batch of rows that came, ``open`` a value for each group with an open session. Rows of a
    key's groups are released together: calls, frames and state entries are a few a key, not a few a group.
    """

    def __init__(self, fold, group: str, kind: str, columns: list[str], gap: int):
        self.fold, self.kind, self.columns, self.gap = fold, kind, columns, gap
        self.names = [group, "session", *[f.split(" ")[0] for f in fold.out.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.open = handle.getListState("open", f"of {self.kind}, began long, ended long, {self.fold.state}")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000) - 1)

    @staticmethod
    def _packed(rows: pd.DataFrame) -> tuple[bytes]:
        batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as to:
            to.write_batch(batch)
        return (sink.getvalue().to_pybytes(),)

    def _runs(self, ready: pd.DataFrame) -> Iterator[tuple]:
        """(group, times, inputs of the fold) of each stretch of a group's rows without a gap, in order."""
        ready = ready.sort_values(self.columns, ignore_index=True)
        of, t = ready["of"].to_numpy(), ready["t"].to_numpy()
        cuts = (np.flatnonzero((of[1:] != of[:-1]) | (np.diff(t) > self.gap)) + 1).tolist()
        of, t, *inputs = (ready[c].tolist() for c in self.columns)
        rows = list(zip(*inputs, strict=True))
        for i, j in pairwise([0, *cuts, len(rows)]):
            if i < j:
                yield of[i], t[i:j], rows[i:j]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            self.pending.appendValue(self._packed(pdf[self.columns]))
            first.append(int(pdf["t"].min()))
        self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, ahead = timerValues.getCurrentWatermarkInMs() * 1000, []
        open_ = {of: value for of, *value in self.open.get()}
        changed, out = False, []
        parts = [pa.ipc.open_stream(bytes(r[0])).read_pandas() for r in self.pending.get()]
        if parts:
            held = pd.concat(parts, ignore_index=True)
            ready, waiting = held[held["t"] <= mark], held[held["t"] > mark]
            for of, t, rows in self._runs(ready):
                first, last, *state = open_.get(of, (None, None))
                if last is None or t[0] - last > self.gap:
                    if last is not None:
                        out.extend((of, first, *x) for x in self.fold.finish(tuple(state)))
                    first, state = t[0], self.fold.fresh()
                state, found = self.fold.step(tuple(state), rows)
                out.extend((of, first, *x) for x in found)
                open_[of] = (first, t[-1], *state)
                changed = True
            if changed:
                if len(waiting):
                    self.pending.put([self._packed(waiting)])
                else:
                    self.pending.clear()
            if len(waiting):
                ahead.append(int(waiting["t"].min()))
        for of in [of for of, value in open_.items() if value[1] + self.gap <= mark]:
            first, _, *state = open_.pop(of)
            out.extend((of, first, *x) for x in self.fold.finish(tuple(state)))
            changed = True
        if changed:
            if open_:
                self.open.put([(of, *value) for of, value in open_.items()])
            else:
                self.open.clear()
        if open_:
            ahead.append(min(value[1] for value in open_.values()) + self.gap)
        if ahead:  # one timer, for what comes next; it sets that of the rest
            self._wake(min(ahead))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def scan(events: DataFrame, fold, group: str, time: str, order: str, inputs: list[str], *, gap: str, late: str, buckets: int | None = None) -> DataFrame:
    """The fold's columns for each group and session (its first row's time). ``time`` is an instant; ``inputs`` are read as doubles.

    State is keyed by group, or by ``buckets`` of groups where there are many with few rows each: what one call has at once are a
    bucket's rows of one lateness (and batch). The number stays that of the checkpoint.
    """
    kind = {c: events.schema[c].dataType.simpleString() for c in (group, order)}
    names = [f"x{i}" for i in range(len(inputs))]
    key = F.col(group).alias(group) if buckets is None else F.pmod(F.xxhash64(group), F.lit(buckets)).alias("bucket")
    rows = events.withWatermark(time, late).select(key, time, F.col(group).alias("of"), F.unix_micros(time).alias("t"), F.col(order).alias("row"), *[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names, strict=True)])
    span = events.sparkSession.sql(f"SELECT CAST(INTERVAL {gap} AS INTERVAL DAY TO SECOND) AS gap").first()["gap"]  # one constant
    work = OrderedScan(fold, group, kind[group], ["of", "t", "row", *names], round(span.total_seconds() * 1_000_000))
    found = rows.groupBy(group if buckets is None else "bucket").transformWithStateInPandas(work, f"{group} {kind[group]}, session long, {fold.out}", "Append", "EventTime")
    return found.withColumn("session", F.timestamp_micros("session"))


class TrackLinks(StatefulProcessor):
    """Links of one clip's tracklets, taken once no row to come can change them.

    The cheapest pair of all is taken first, then the cheapest of what is left: so a pair may be taken as soon as it is the
    cheapest left at both its ends and no further pair can appear there. That is so at the earlier track's end once all tracks
    that begin up to ``most_gap`` frames later are known, at the later track's beginning once all that begin before it are. What
    has been taken, and ends that no pair is left for, go from the state.
    """

    OPEN = "track long, first long, last long, x0 double, y0 double, x1 double, y1 double, linked_out boolean, linked_in boolean"

    def __init__(self, clip: str, most_gap: int, radius: float, frame_ms: int):
        self.clip, self.most_gap, self.radius, self.frame_ms = clip, most_gap, radius, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.OPEN)

    def _wake(self, frame: int) -> None:
        self.handle.registerTimer(frame * self.frame_ms - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[["track", "first", "last", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)]
        self.open.appendList([(*r, False, False) for r in new])
        self._wake(min(r[2] for r in new) + self.most_gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = timerValues.getCurrentWatermarkInMs() // self.frame_ms  # all tracks that begin up to this frame have come
        tracks = {r[0]: list(r) for r in self.open.get()}
        begun = sorted(tracks.values(), key=lambda t: t[1])
        firsts = [t[1] for t in begun]
        pairs = []
        for a in tracks.values():
            if a[7]:
                continue
            for b in begun[bisect_right(firsts, a[2]) : bisect_right(firsts, a[2] + self.most_gap)]:
                gap = b[1] - a[2]
                dx, dy = b[3] - a[5], b[4] - a[6]
                cost = sqrt(dx * dx + dy * dy)  # ties as in SQL, which ``hypot`` rounds apart
                if b[0] != a[0] and not b[8] and cost <= self.radius * gap:
                    pairs.append((cost, a[0], b[0]))
        pairs.sort()
        out, waiting_out, waiting_in = [], set(), set()
        for cost, i, j in pairs:  # the cheapest left first; a pair that must wait holds up what shares an end with it
            a, b = tracks[i], tracks[j]
            if a[7] or b[8]:
                continue
            if i in waiting_out or j in waiting_in or a[2] + self.most_gap > known or b[1] > known:
                waiting_out.add(i)
                waiting_in.add(j)
                continue
            a[7] = b[8] = True
            out.append((key[0], i, j, cost))
        left = [tuple(t) for t in tracks.values() if self._matters(t, known, waiting_out, waiting_in)]
        if len(left) < len(tracks) or out:
            if left:
                self.open.put(left)
            else:
                self.open.clear()
        ahead = [t[2] + self.most_gap for t in left if t[2] + self.most_gap > known]
        if ahead:  # one timer, for what is closed next; it sets that of the rest
            self._wake(min(ahead))
        if out:
            yield pd.DataFrame(out, columns=[self.clip, "track", "next", "cost"])

    def _matters(self, t: list, known: int, waiting_out: set, waiting_in: set) -> bool:
        ends = not t[7] and (t[2] + self.most_gap > known or t[0] in waiting_out)
        begins = not t[8] and (t[1] > known or t[0] in waiting_in)
        return ends or begins

    def close(self) -> None:
        pass


def track_links(tracks: DataFrame, clip: str, time: str, *, most_gap: int = 8, radius: float, frame: str = "1 second", late: str) -> DataFrame:
    """Links (clip, track, next, cost) of a stream of tracklets (track, first, last, x0, y0, x1, y1), ends to beginnings over gaps of
    up to ``most_gap`` frames and ``radius`` times the gap, cheapest first: those of the batch form over all tracks.

    ``time`` is the instant of a track's first frame, whole frames after the epoch (frame 0 would be late from the start); a track comes within ``late`` of it.
    """
    span = tracks.sparkSession.sql(f"SELECT CAST(INTERVAL {frame} AS INTERVAL DAY TO SECOND) AS s").first()["s"]  # one constant
    kind = tracks.schema[clip].dataType.simpleString()
    work = TrackLinks(clip, most_gap, radius, round(span.total_seconds() * 1000))
    return tracks.withWatermark(time, late).groupBy(clip).transformWithStateInPandas(work, f"{clip} {kind}, track long, next long, cost double", "Append", "EventTime")
