"""Stateful stream operators that need frames in order: buffer by event time, release up to the watermark."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.tracking import MIN_KIT, PeopleTracker
from .ball import STATE, Ball, BallRules, shown


ORIGIN_MS = 86_400_000  # match time zero: a row at the epoch itself would already be behind the first watermark


class InOrder(StatefulProcessor):
    """Holds frames until the watermark passes them, then steps through them in order.

    Frames at or before the last released one are late: they are dropped and counted in the state. The buffer holds the
    watermark delay's worth of frames. All state is typed columns, so that a restarted job may have other code: a class may
    move or be renamed, only the columns are a contract.
    """

    names: tuple = ()

    def init(self, handle):
        self.handle = handle
        self.progress = handle.getValueState("progress", "last long, late long")
        self.waiting = handle.getMapState("waiting", "frame long, seq long", "ms long, payload string")
        self.open(handle)

    def open(self, handle):
        """Declare the state that ``restore`` and ``keep`` read and write."""
        raise NotImplementedError

    def restore(self):
        raise NotImplementedError

    def keep(self, state):
        raise NotImplementedError

    def advance(self, key, state, frame, payloads):
        raise NotImplementedError

    def _progress(self):
        return self.progress.get() if self.progress.exists() else (-1, 0)

    def _release(self, key, watermark, last, late):
        ready, later = {}, None
        for k, v in self.waiting.iterator():
            if v[0] <= watermark:
                ready.setdefault(k[0], []).append((k[1], v[1]))
            else:
                later = v[0] if later is None else min(later, v[0])
        out = []
        if ready:
            state = self.restore()
            for frame in sorted(ready):
                rows = sorted(ready[frame])
                state, made = self.advance(key, state, frame, [json.loads(p) for _, p in rows])
                out += made
                last = frame
                for seq, _ in rows:
                    self.waiting.removeKey((frame, seq))
            self.keep(state)
        self.progress.update((last, late))
        if later is not None:
            self.handle.registerTimer(later)
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    def handleInputRows(self, key, rows, timerValues):
        last, late = self._progress()
        for pdf in rows:
            for frame, seq, ms, payload in zip(pdf["frame"], pdf["seq"], pdf["ms"], pdf["payload"]):
                if frame <= last:
                    late += 1
                else:
                    self.waiting.updateValue((int(frame), int(seq)), (int(ms), payload))
        yield from self._release(key, timerValues.getCurrentWatermarkInMs(), last, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(key, timerValues.getCurrentWatermarkInMs(), *self._progress())

    def close(self):
        pass


class BallInOrder(InOrder):
    names = tuple(STATE.names)

    def __init__(self, rate, aspect):
        self.rules = BallRules(rate, aspect)

    def open(self, handle):
        self.ball = handle.getValueState("ball", "status string, x double, y double, conf double, coasted long, vx double, vy double")

    def restore(self):
        return Ball(*self.ball.get()) if self.ball.exists() else Ball()

    def keep(self, state):
        self.ball.update((state.status, state.x, state.y, float(state.conf), int(state.coasted), float(state.vx), float(state.vy)))

    def advance(self, key, state, frame, payloads):
        p = payloads[0]
        dets = [tuple(d[c] for c in ("conf", "u", "v", "w", "h")) for d in p.get("dets") or ()]
        state = self.rules.advance(state, dets, p.get("step"), bool(p.get("full_frame")))
        return state, [(int(key[0]), frame, *shown(state))]


PEOPLE = StructType([StructField(c, LongType()) for c in ("match_id", "frame", "det_id", "track_id")])


class PeopleInOrder(InOrder):
    """Live tracks are a list, upstream ids a map of their own: of both only what changed since the last release is written, and
    what an expired track left goes (state that ends by event time has no other expiry)."""

    names = tuple(PEOPLE.names)

    def __init__(self, rate):
        self.rate = rate

    def open(self, handle):
        self.count = handle.getValueState("tracks", "next_id long")
        self.live = handle.getListState("live", "track long, frame long, x double, y double, vx double, vy double, kit array<double>")
        self.hints = handle.getMapState("hints", "hint long", "track long")

    def restore(self):
        tracker = PeopleTracker(self.rate)
        if self.count.exists():
            tracker.next_id = self.count.get()[0]
            for track, frame, x, y, vx, vy, kit in self.live.get():
                tracker.live[track] = [(x, y), (vx, vy), frame, list(kit) if kit else None]
            tracker.by_hint = {k[0]: v[0] for k, v in self.hints.iterator()}
        self.known = dict(tracker.by_hint)
        return tracker

    def keep(self, state):
        self.count.update((int(state.next_id),))
        rows = [(int(k), int(frame), *map(float, xy), *map(float, speed), [] if kit is None else [float(c) for c in kit])
                for k, (xy, speed, frame, kit) in state.live.items()]
        if rows:
            self.live.put(rows)
        else:
            self.live.clear()
        hints = {h: k for h, k in state.by_hint.items() if k in state.live}  # an expired track is never continued
        for hint, track in hints.items():
            if self.known.get(hint) != track:
                self.hints.updateValue((int(hint),), (int(track),))
        for hint in self.known.keys() - hints.keys():
            self.hints.removeKey((int(hint),))

    def advance(self, key, state, frame, payloads):
        xy = np.array([(p["x"], p["y"]) for p in payloads])
        sigma = np.array([p["sigma_m"] for p in payloads])
        kits = [np.array(p["kit"][1:6]) if p.get("kit") and p["kit"][0] > MIN_KIT else None for p in payloads]
        ids = state.frame(frame, xy, sigma, kits, [p.get("hint") for p in payloads])
        return state, [(int(key[0]), frame, int(p["det_id"]), k) for p, k in zip(payloads, ids)]


def _packed(stream: DataFrame, seq, delay: str, *columns: str) -> DataFrame:
    """``match_id, frame, seq, ts, ms, payload`` with a watermark on the frame time ``t`` (seconds)."""
    ms = F.round(F.col("t") * 1000).cast("long") + ORIGIN_MS
    return stream.select("match_id", F.col("frame").cast("long").alias("frame"), seq.cast("long").alias("seq"),
                         F.timestamp_millis(ms).alias("ts"), ms.alias("ms"), F.to_json(F.struct(*columns)).alias("payload")
                         ).withWatermark("ts", delay)


def ball_stream(stream: DataFrame, rate: float, aspect: float, delay: str = "2 seconds") -> DataFrame:
    """Live ball state per frame; the twin of :func:`touchline.streaming.ball.track_ball`."""
    rows = _packed(stream, F.lit(0), delay, "dets", "step", "full_frame")
    return rows.groupBy("match_id").transformWithStateInPandas(BallInOrder(rate, aspect), STATE, "Append", "EventTime")


def people_stream(stream: DataFrame, rate: float, delay: str = "2 seconds") -> DataFrame:
    """Live track ids per detection; the twin of :func:`touchline.operators.tracking.track_people`."""
    rows = _packed(stream, F.col("det_id"), delay, "det_id", "x", "y", "sigma_m", "kit", "hint")
    return rows.groupBy("match_id").transformWithStateInPandas(PeopleInOrder(rate), PEOPLE, "Append", "EventTime")
