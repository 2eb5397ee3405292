"""Building people tracks from ground detections, and stitching the fragments a moving camera leaves.

The tracker is sequential; blocks of a match are walked side by side from guessed states and again where the guess was
wrong, and numbering is made continuous afterwards. Stitching is joins: a bucketed range join for the
candidates, an exact matching by components and blocks (``matching``), pointer jumping for the chains.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import cut, discard, stored
from .assignment import match_few
from .blocks import BLOCK, Fold, fold_sorted, frames_for, frames_in, rated, rescaled_gain
from .matching import components, match_fragments  # noqa: F401
from .speculate import Walk, fold_blocks

# Fixed values of the association rules (meters, seconds)
SPRINT_MS, SIGMA_FACTOR, MAX_GATE_M, MIN_SIGMA_M = 7.0, 1.5, 3.0, 0.35
MAX_AGE_FACTOR, AGE_PER_S, KIT_WEIGHT, MIN_KIT, MEMORY_S, GAIN, KIT_KEEP = 1.5, 0.5, 3.0, 0.2, 3.0, 0.5, 0.85
STITCH_GAP_S, STITCH_BASE_M, STITCH_KIT, NO_KIT_FACTOR = 6.0, 2.0, 0.45, 0.6
LOOSE_GAP_S, LOOSE_FACTOR = 30.0, 2.0


class PeopleTracker:
    """Constant-velocity tracks; each frame's detections are assigned at least total cost inside the gates."""

    def __init__(self, rate: float):
        self.step_m = SPRINT_MS / rate
        self.age_slack = AGE_PER_S / rate
        self.gain = rescaled_gain(GAIN, rate)
        self.memory = frames_for(MEMORY_S, rate)
        self.next_id = 0
        self.live: dict[int, list] = {}  # id -> [(x, y), velocity, frame, kit or None]
        self.by_hint: dict[int, int] = {}

    def told(self, at: int | None) -> list[tuple[list, int]]:
        """The state of each track still alive at a frame, in one order, and its id: frame, place, velocity, color, hints."""
        hints: dict[int, list[int]] = {}
        for hint, track in self.by_hint.items():
            hints.setdefault(track, []).append(hint)
        live = [(k, s) for k, s in self.live.items() if at is None or at - s[2] <= self.memory]
        states = [([int(s[2]), *map(float, s[0]), *map(float, s[1]), [] if s[3] is None else [float(v) for v in s[3]], sorted(hints.get(k, []))], k)
                  for k, s in live]
        return sorted(states)

    def take_up(self, states: list) -> None:
        self.next_id = len(states)
        for k, (frame, x, y, vx, vy, kit, hints) in enumerate(states):
            self.live[k] = [(x, y), (vx, vy), frame, kit or None]
            self.by_hint.update(dict.fromkeys(hints, k))

    def _near(self, sigma: float) -> float:
        return min(self.step_m + SIGMA_FACTOR * max(sigma, MIN_SIGMA_M), MAX_GATE_M) if sigma == sigma else math.nan

    def _slack(self, age: int) -> float:
        return min(1.0 + self.age_slack * age, MAX_AGE_FACTOR)

    def _follow(self, track: int, frame: int, xy, kit):
        (x, y), (vx, vy), seen, color = self.live[track]
        age = max(1, frame - seen)
        if kit is not None:
            color = kit if color is None else [KIT_KEEP * c + (1.0 - KIT_KEEP) * k for c, k in zip(color, kit)]
        move = (xy[0] - x) / age, (xy[1] - y) / age
        self.live[track] = [xy, ((1.0 - self.gain) * vx + self.gain * move[0], (1.0 - self.gain) * vy + self.gain * move[1]), frame, color]

    def _allowed(self, frame: int, ids: list[int], xy: list, near: list[float], kits: list) -> dict[tuple[int, int], float]:
        """Cost of each track and detection inside the gates, by track and then detection.

        A frame holds few of either, so plain numbers are quicker than arrays. Most pairs are refused by one coordinate; numpy's
        ``hypot`` is kept for the others, as the library's own rounds differently.
        """
        out = {}
        places = [(j, x, y, gate) for j, ((x, y), gate) in enumerate(zip(xy, near))]
        for i, k in enumerate(ids):
            (x, y), (vx, vy), seen, color = self.live[k]
            age = frame - seen
            x, y, slack = x + vx * age, y + vy * age, self._slack(age)
            for j, px, py, gate in places:
                gate = gate * slack
                dx, dy = x - px, y - py
                if not (-gate <= dx <= gate and -gate <= dy <= gate):
                    continue
                away = float(np.hypot(dx, dy))
                if away <= gate:
                    if color is not None and kits[j] is not None:
                        unlike = 0.0
                        for p, q in zip(color, kits[j]):
                            unlike += (p - q) * (p - q)
                        away += KIT_WEIGHT * math.sqrt(unlike)
                    out[i, j] = away
        return out

    def frame(self, frame: int, xy, sigma, kits: list, hints: list) -> list[int]:
        """Track ids of one frame's detections. ``kits``: color or None; ``hints``: upstream id or None."""
        self.live = {k: s for k, s in self.live.items() if frame - s[2] <= self.memory}
        if len(self.by_hint) > 2 * len(self.live) + 64:  # hints of tracks that are gone
            self.by_hint = {h: k for h, k in self.by_hint.items() if k in self.live}
        xy = [(float(x), float(y)) for x, y in xy]
        near = [self._near(float(s)) for s in sigma]
        kits = [None if k is None else [float(v) for v in k] for k in kits]
        given = [-1] * len(xy)
        ids = sorted(self.live)
        if ids:
            for i, j in match_few(self._allowed(frame, ids, xy, near, kits)):
                given[j] = ids[i]
                self._follow(ids[i], frame, xy[j], kits[j])
                if hints[j] is not None:
                    self.by_hint[hints[j]] = ids[i]
        for j, known in enumerate(given):
            if known >= 0:
                continue
            hinted = self.by_hint.get(hints[j]) if ids and hints[j] is not None else None
            if hinted is not None and hinted in self.live:
                (x, y), (vx, vy), seen, _ = self.live[hinted]
                gap = frame - seen
                gate = near[j] * self._slack(gap)
                dx, dy = xy[j][0] - (x + vx * gap), xy[j][1] - (y + vy * gap)
                if -gate <= dx <= gate and -gate <= dy <= gate and np.linalg.norm(np.array([dx, dy])) <= gate:
                    self._follow(hinted, frame, xy[j], kits[j])
                    given[j] = hinted
                    continue
            given[j] = self.next_id
            self.next_id += 1
            self.live[given[j]] = [xy[j], (0.0, 0.0), frame, kits[j]]
            if hints[j] is not None:
                self.by_hint[hints[j]] = given[j]
        return given


class _PeopleWalk(Walk):
    """Collects one frame at a time for the tracker. Tracks that live as it begins have the first numbers, in the order of
    their state."""

    def __init__(self, key, body):
        self.key, self.frame, self.rows = key, None, []
        self.tracker = PeopleTracker(key[1])
        if body is not None:
            self.tracker.take_up(json.loads(body))

    def _flush(self):
        if not self.rows:
            return []
        rows, self.rows = self.rows, []
        kits = [r.kit[1:6] if r.kit is not None and r.kit[0] > MIN_KIT else None for r in rows]
        hints = [None if r.hint is None or r.hint != r.hint else int(r.hint) for r in rows]
        ids = self.tracker.frame(int(self.frame), [(r.x, r.y) for r in rows], [r.sigma_m for r in rows], kits, hints)
        return [(*self.key, r.frame, r.det_id, k) for r, k in zip(rows, ids)]

    def step(self, row):
        out = []
        if row.frame != self.frame:
            out, self.frame = self._flush(), row.frame
        self.rows.append(row)
        return out

    def close(self):
        return self._flush()

    def snapshot(self, at):
        return json.dumps([state for state, _ in self.tracker.told(at)])

    def remark(self):
        return json.dumps([self.tracker.next_id, [k for _, k in self.tracker.told(None)]])


class _Numbers(Fold):
    """What a block's track numbers are in the match: its first ones are tracks of the block before, the others are new."""

    def __init__(self, key):
        self.key, self.memory, self.next, self.held = key, frames_for(MEMORY_S, key[1]), 0, []

    def step(self, row):
        entry = [number for state, number in self.held if row.at - state[0] <= self.memory]
        count, ids = json.loads(row.remark)
        first, self.next = self.next, self.next + count - len(entry)
        numbers = [entry[k] if k < len(entry) else first + k - len(entry) for k in ids]
        self.held = list(zip(json.loads(row.exit), numbers))
        return [(*self.key, row.blk, entry, first)]


#: how long before its block a walk begins, in seconds: a shirt's color forgets slowest
LEAD_S = 60.0


def track_people(dets: DataFrame, rate: float | DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``track_id`` per on-pitch detection ``(match_id, frame, det_id, x, y, sigma_m, kit ARRAY, hint)``.

    ``rate``: one for all, or ``match_id, rate``; gates, memory and gains follow each match's own. Ids count up through a match in order of first appearance, as one uninterrupted pass would give. Blocks of ``block``
    frames are walked side by side (``speculate``); the numbers of their tracks are joined up by one row for each block.
    """
    rows = dets.select("match_id", "frame", "det_id", "x", "y", "sigma_m", "kit", F.col("hint").cast("long").alias("hint"))
    key = [StructField("match_id", LongType()), StructField("rate", DoubleType())]
    schema = StructType([*key, *(StructField(c, LongType()) for c in ("frame", "det_id", "local"))])
    local, ends = fold_blocks(rated(rows, rate), ["match_id", "rate"], ["frame", "det_id"], _PeopleWalk, schema, block=block,
                              lead=frames_in(LEAD_S, F.col("rate")))
    named = StructType([*key, StructField("blk", LongType()), StructField("entry", ArrayType(LongType())),
                        StructField("first", LongType())])
    numbers = fold_sorted(ends, ["match_id", "rate"], ["blk"], _Numbers, named)
    at = F.col("local") - F.size("entry")
    return local.join(numbers.drop("rate"), ["match_id", "blk"]).select(
        "match_id", "frame", "det_id", F.when(at >= 0, F.col("first") + at).otherwise(F.get("entry", F.col("local").cast("int"))).alias("track_id"))


def fragments(obs: DataFrame) -> DataFrame:
    """First and last sighting of each track: ``match_id, track_id, f0, x0, y0, f1, x1, y1``."""
    at = F.struct("x", "y")
    out = obs.groupBy("match_id", "track_id").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(at, "frame").alias("a"),
        F.max_by(at, "frame").alias("b"))
    return out.select("match_id", "track_id", "f0", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), "f1",
                      F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def _pairs(frags: DataFrame, most_s: float) -> DataFrame:
    """Fragment pairs (``rate`` among their columns) at most ``most_s`` seconds apart, by two adjacent time buckets."""
    max_gap = frames_in(most_s, F.col("rate"))
    bucket = F.floor(F.col("f1") / max_gap)
    before = frags.select("match_id", "rate", F.col("track_id").alias("before"), "f1", "x1", "y1", F.col("kit").alias("kit_b"),
                          F.explode(F.array(bucket, bucket + 1)).alias("_t"))
    after = frags.select("match_id", F.col("track_id").alias("after"), "f0", "x0", "y0", F.col("kit").alias("kit_a"),
                         F.floor(F.col("f0") / max_gap).alias("_t"))
    gap = F.col("f0") - F.col("f1")
    pairs = before.join(after, ["match_id", "_t"]).where((gap > 0) & (gap <= max_gap) & (F.col("before") != F.col("after")))
    kit = F.sqrt(F.aggregate(F.zip_with("kit_b", "kit_a", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select("match_id", "rate", "before", "after", gap.alias("gap"),
                        F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")).alias("distance"),
                        F.when(F.col("kit_b").isNotNull() & F.col("kit_a").isNotNull(), kit).alias("kit_distance"))


def stitch_candidates(frags: DataFrame, rate: float | DataFrame) -> DataFrame:
    """Pairs that may be one player: ``match_id, before, after, cost``. ``frags`` carry ``kit ARRAY(5)`` or NULL."""
    pairs = _pairs(rated(frags, rate), STITCH_GAP_S)
    sprint = F.lit(SPRINT_MS) / F.col("rate")
    known = F.col("kit_distance").isNotNull()
    fits = F.when(known, (F.col("kit_distance") <= STITCH_KIT) & (F.col("distance") <= F.col("gap") * sprint + STITCH_BASE_M)
                  ).otherwise(F.col("distance") <= F.col("gap") * (F.lit(NO_KIT_FACTOR) * sprint) + STITCH_BASE_M)
    cost = F.col("distance") / F.col("gap") + F.when(known, F.col("kit_distance") * 2.0).otherwise(0.5)
    return pairs.where(fits).select("match_id", "before", "after", cost.alias("cost"))


def stitch_report(frags: DataFrame, rate: float | DataFrame) -> DataFrame:
    """Every pair inside a loose window with the reason it is refused (or ``pass``)."""
    pairs = _pairs(rated(frags, rate), LOOSE_GAP_S)
    sprint = F.lit(SPRINT_MS) / F.col("rate")
    near = frames_in(STITCH_GAP_S, F.col("rate"))
    envelope = F.col("gap") * sprint + STITCH_BASE_M
    bare = F.col("gap") * (F.lit(NO_KIT_FACTOR) * sprint) + STITCH_BASE_M
    known = F.col("kit_distance").isNotNull()
    reason = (F.when(F.col("gap") > near, "gap")
              .when(known & (F.col("kit_distance") > STITCH_KIT), "kit")
              .when(known & (F.col("distance") > envelope), "distance")
              .when(~known & (F.col("distance") > bare), "distance-no-kit").otherwise("pass"))
    gap_s = F.col("gap") / F.col("rate")
    spread = (F.when((gap_s >= 6) & (gap_s < 8), "6-8").when((gap_s >= 8) & (gap_s < 10), "8-10")
              .when((gap_s >= 10) & (gap_s < 15), "10-15").when((gap_s >= 15) & (gap_s < 20), "15-20")
              .when((gap_s >= 20) & (gap_s < 31), "20-31"))
    out = pairs.where(F.col("distance") <= envelope * LOOSE_FACTOR)
    ratio = F.col("distance") / F.when(known, envelope).otherwise(bare)
    return out.select("match_id", "before", "after", "gap", "distance", reason.alias("reason"),
                      (F.col("distance") <= envelope).alias("reachable"), ratio.alias("ratio"),
                      F.when(F.col("gap") > near, spread).alias("spread"))


def stitch_samples(report: DataFrame, best: int = 6) -> DataFrame:
    """The refusals nearest to passing, ``best`` per match and reason (a report, kept small by a bounded top-k)."""
    from .topk import top_k
    close = report.where(((F.col("reason") == "gap") & F.col("reachable")) | (F.col("reason") == "distance-no-kit"))
    return top_k(close, ["match_id", "reason"], [F.col("ratio"), F.col("before"), F.col("after")], best)


def resolve_chains(joins: DataFrame, limit: int = 40) -> DataFrame:
    """Head of each joined fragment's chain: ``match_id, track_id, head`` by pointer jumping.

    Each round doubles the reach, so 40 rounds are more than any chain takes; a ring of joins raises.
    """
    links = stored(joins.select("match_id", F.col("after").alias("track_id"), F.col("before").alias("head")))
    for _ in range(limit):
        up = links.select("match_id", F.col("track_id").alias("head"), F.col("head").alias("_up"))
        after = stored(links.join(up, ["match_id", "head"], "left").select(
            "match_id", "track_id", F.coalesce("_up", "head").alias("head"), F.col("_up").isNotNull().alias("_moved")))
        discard(links)
        links = after
        if after.where("_moved").isEmpty():
            return links.drop("_moved")
    raise RuntimeError("joins go round in a ring")


def stitch_tracks(obs: DataFrame, kits: DataFrame, rate: float | DataFrame) -> DataFrame:
    """Observations with fragments of one player under one id. ``kits``: ``match_id, track_id, kit ARRAY(5)``."""
    # one row a fragment, read from both ends of a pair
    frags = cut(fragments(obs).join(kits.select("match_id", "track_id", "kit"), ["match_id", "track_id"], "left"))
    heads = resolve_chains(match_fragments(stitch_candidates(frags, rate)))
    out = obs.join(heads, ["match_id", "track_id"], "left")
    return out.withColumn("track_id", F.coalesce("head", "track_id")).drop("head")
