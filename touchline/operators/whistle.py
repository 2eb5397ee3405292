"""Whistle candidates from audio: windowed spectra, tone islands, and the gates that keep voices out.

Only the Fourier transform runs in Python, on Arrow batches of audio blocks; it returns seven numbers per window, so the
spectra themselves are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import BLOCK, clip, exact_percentiles, halo, prefix, runs
from .joins import neighbors

# Fixed values of the audio rules (samples, hertz, seconds)
WINDOW, HOP = 512, 128
BAND, VOICE, LOW = (2200.0, 4600.0), (80.0, 1200.0), (150.0, 1500.0)
PEAK_SIGMAS, SILENCE, MIN_WINDOWS = 6.0, 1e-9, 13
MIN_GAP_S, MIN_DURATION_S, MIN_PROMINENCE, MAX_VOICE, MAX_LOW = 1.0, 0.20, 50.0, 0.5, 3.0
LOW_SPAN_S, LOW_CONTEXT_S = 0.1, 1.0
#: blocks whose windows are handed on together
HELD_BLOCKS = 64


def _power(samples) -> np.ndarray:
    wave = np.asarray(samples, dtype=np.float32)
    if len(wave) < WINDOW:
        return np.zeros((0, WINDOW // 2 + 1), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(wave, WINDOW)[::HOP]
    return (np.abs(np.fft.rfft(frames * np.hanning(WINDOW), axis=1)) ** 2).astype(np.float32)


OVERLAP = WINDOW - HOP


def stitch_audio(blocks: DataFrame, clips: DataFrame, size: int = HOP * 4096) -> DataFrame:
    """Blocks of clips ``(match_id, path, offset, sr, samples)`` cut anew on the game's sample clock.

    The result's blocks start at multiples of ``size`` (itself a multiple of the hop) and reach 384 samples into the
    next, so windows run across the joins of clips and none is counted twice. Where blocks overlap, the earlier one's
    samples count; a hole before samples is silence, and a block ends with its last sample. Only a block is gathered.
    """
    c = clips.select("match_id", "path", F.col("start_s").alias("_at"))
    start = F.bround(F.col("_at") * F.col("sr"), 0).cast("long") + F.col("offset")
    rows = blocks.join(c, ["match_id", "path"]).withColumn("_s", start).withColumn("_e", start + F.size("samples"))
    cell = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_s") - OVERLAP) / size)).cast("long"), F.floor((F.col("_e") - 1) / size).cast("long"))
    rows = rows.where(F.size("samples") > 0).withColumn("_c", F.explode(cell))
    low = F.greatest(F.col("_s"), F.col("_c") * size)
    high = F.least(F.col("_e"), (F.col("_c") + 1) * size + OVERLAP)
    part = F.struct(low.alias("s"), F.slice("samples", (low - F.col("_s") + 1).cast("int"), (high - low).cast("int")).cast("array<float>").alias("a"))
    cells = rows.where(low < high).groupBy("match_id", "sr", "_c").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    begin = F.col("_c") * size
    zero = F.struct(begin.alias("to"), F.array().cast("array<array<float>>").alias("all"))

    def add(acc, p):
        skip = F.greatest(F.lit(0), acc["to"] - p["s"]).cast("int")
        hole = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), p["s"] - acc["to"]).cast("int"))
        rest = F.slice(p["a"], skip + 1, F.greatest(F.lit(0), F.size(p["a"]) - skip))
        return F.struct(F.greatest(acc["to"], p["s"] + F.size(p["a"])).alias("to"), F.concat(acc["all"], F.array(hole, rest)).alias("all"))

    return cells.select("match_id", begin.alias("start"), "sr", F.aggregate("_p", zero, add, lambda acc: F.flatten(acc["all"])).alias("samples"))


def spectra(blocks: DataFrame) -> DataFrame:
    """Power spectrum per window from blocks ``(match_id, start, sr, samples)``; a block overlaps the next by 384."""
    def run(batches):
        for pdf in batches:
            for match, start, wave in zip(pdf["match_id"], pdf["start"], pdf["samples"]):
                power = _power(wave)
                if len(power):
                    yield pd.DataFrame({"match_id": match, "w": start // HOP + np.arange(len(power)), "power": list(power)})

    return blocks.select("match_id", "start", "samples").mapInPandas(run, "match_id long, w long, power array<float>")


def window_features(blocks: DataFrame) -> DataFrame:
    """Per window: band peak, median and level, tone frequency, voice, low and total energy."""
    def run(batches):
        for pdf in batches:
            held = []
            for match, start, sr, wave in zip(pdf["match_id"], pdf["start"], pdf["sr"], pdf["samples"]):
                power = _power(wave)
                if not len(power):
                    continue
                freqs = np.fft.rfftfreq(WINDOW, 1.0 / sr)
                band, voice, low = ((freqs >= lo) & (freqs <= hi) for lo, hi in (BAND, VOICE, LOW))
                tones = power[:, band].astype(np.float64)
                peak = tones.max(axis=1)
                loud = tones > 0.5 * peak[:, None]
                freq = (loud * freqs[band]).sum(axis=1) / np.maximum(loud.sum(axis=1), 1)
                freq = np.where(loud.any(axis=1), freq, freqs[band][tones.argmax(axis=1)])
                held.append((np.full(len(power), match), start // HOP + np.arange(len(power)), peak, np.median(tones, axis=1),
                             tones.sum(axis=1), freq, *(power[:, part].sum(axis=1, dtype=np.float64) for part in (voice, low)),
                             power.sum(axis=1, dtype=np.float64)))
                if len(held) == HELD_BLOCKS:
                    yield table(held)
                    held = []
            if held:
                yield table(held)

    def table(held):
        """One table for many blocks: making one costs as much as a block's transforms."""
        return pd.DataFrame({c: np.concatenate(parts) for c, parts in zip(("match_id", "w", *names), zip(*held))})

    names = ("peak", "local", "level", "freq", "voice", "low", "total")
    schema = "match_id long, w long, " + ", ".join(f"{n} double" for n in names)
    return blocks.select("match_id", "start", "sr", "samples").mapInPandas(run, schema)


def tone_islands(windows: DataFrame, sr: int) -> DataFrame:
    """Unbroken spells in which one tone stands out of the band: time, duration, frequency, score, prominence."""
    rows = halo(windows, "w", BLOCK, back=2, ahead=2)
    ratio = F.col("peak") / (F.col("local") + 1e-12)
    near = Window.partitionBy("match_id", "_blk").orderBy("w").rangeBetween(-2, 2)
    rows = cut(rows.withColumn("smooth", F.sum(ratio).over(near) / 5.0).where("_own").select(
        "match_id", "w", "smooth", "level", "freq"))
    base = exact_percentiles(rows, ["match_id"], F.col("smooth"), {"base": 0.5})
    base = cut(base)
    off = exact_percentiles(rows.join(base, "match_id"), ["match_id"], F.abs(F.col("smooth") - F.col("base")), {"mad": 0.5})
    loud = exact_percentiles(rows, ["match_id"], F.col("level"), {"usual": 0.5})
    count = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("_n"))
    gate = base.join(off, "match_id").join(loud, "match_id").join(count, "match_id").where(
        (F.col("usual") >= SILENCE) & (F.col("_n") >= MIN_WINDOWS)).select(
        "match_id", "usual", (F.col("base") + (F.col("mad") * 1.4826 + 1e-9) * PEAK_SIGMAS).alias("threshold"))
    gate = cut(gate)
    marked = cut(runs(rows.join(gate, "match_id"), ["match_id"], "w", F.col("smooth") > F.col("threshold")))
    best = F.max_by(F.struct("freq", "smooth"), F.struct("smooth", -F.col("w")))
    islands = marked.groupBy("match_id", "run").agg(F.min("w").alias("a"), (F.max("w") + 1).alias("z"), best.alias("b"),
                                                    F.max("usual").alias("usual"))
    # an island is a few windows: a plain percentile
    level = marked.groupBy("match_id", "run").agg(F.percentile("level", F.lit(0.5)).alias("lv"))
    step = HOP / sr
    return islands.join(level, ["match_id", "run"]).select(
        "match_id", (F.col("a") * step).alias("time_s"), ((F.col("z") - F.col("a")) * step).alias("duration_s"),
        F.col("b.freq").alias("frequency_hz"), F.col("b.smooth").alias("score"),
        (F.col("lv") / F.col("usual")).alias("prominence"))


def merge_close(islands: DataFrame, gap: float = MIN_GAP_S) -> DataFrame:
    """Blasts closer than ``gap`` to the end of the kept one are one event; the higher score describes it."""
    from .blocks import Fold, fold_sorted

    class Merge(Fold):
        def __init__(self, gap_s):
            self.gap, self.kept = gap_s, None

        def step(self, row):
            if self.kept is not None and row.time_s - (self.kept.time_s + self.kept.duration_s) < self.gap:
                if row.score > self.kept.score:
                    self.kept = row
                return ()
            done, self.kept = self.kept, row
            return () if done is None else (done,)

        def close(self):
            return () if self.kept is None else (self.kept,)

    rows = cut(prefix(islands, ["match_id"], ["time_s"], 600.0,
                      lags={"before": F.col("time_s") + F.col("duration_s")}))
    first = F.col("before").isNull() | (F.col("time_s") - F.col("before") >= gap)
    rows = prefix(rows.withColumn("first", F.when(first, F.col("time_s"))), ["match_id"], ["time_s"], 600.0,
                  fills={"piece": F.col("first")}).drop("first", "before")
    return fold_sorted(rows, ["match_id", "piece"], ["time_s"], lambda key: Merge(gap), rows.schema).drop("piece")


def _spans(cands: DataFrame, sr: int) -> DataFrame:
    """The windows each candidate is judged on, labeled blast / low / around."""
    per_s = sr / HOP
    a = F.greatest(F.lit(0), F.bround(F.col("time_s") * per_s, 0).cast("long") - 1)
    rows = cands.withColumn("a", a)
    rows = rows.withColumn("z", F.greatest(F.col("a") + 1, F.bround(
        (F.col("time_s") + F.col("duration_s")) * per_s, 0).cast("long")))
    grace = int(LOW_SPAN_S * per_s)
    rows = rows.withColumns({"la": F.greatest(F.lit(0), F.col("a") - grace)})
    rows = rows.withColumn("lz", F.greatest(F.col("la") + 1, F.col("z") + grace))
    guard = max(1, int(0.1 * per_s))
    context = max(guard + 1, int(LOW_CONTEXT_S * per_s))

    def span(kind, lo, hi):
        return F.when(hi > lo, F.transform(F.sequence(lo, hi - 1), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))
                      ).otherwise(F.array().cast("array<struct<kind:string,w:bigint>>"))

    zero = F.lit(0).cast("long")
    spans = F.concat(span("blast", F.col("a"), F.col("z")), span("low", F.col("la"), F.col("lz")),
                     span("around", F.greatest(zero, F.col("la") - context), F.greatest(zero, F.col("la") - guard)),
                     span("around", F.col("lz") + guard, F.col("lz") + context))
    return rows.select("match_id", "time_s", F.explode(spans).alias("s")).select("match_id", "time_s", "s.kind", "s.w")


def voice_gates(cands: DataFrame, windows: DataFrame, sr: int) -> DataFrame:
    """Add ``voice_share`` and ``low_gain`` to candidates."""
    seen = _spans(cands, sr).join(windows.select("match_id", "w", "voice", "low", "total"), ["match_id", "w"])
    value = F.when(F.col("kind") == "blast", F.col("voice") / (F.col("total") + 1e-12)).otherwise(F.col("low"))
    med = exact_percentiles(seen, ["match_id", "time_s", "kind"], value, {"m": 0.5})

    def of(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("m")))

    wide = med.groupBy("match_id", "time_s").agg(of("blast").alias("_v"), of("low").alias("_l"), of("around").alias("_r"))
    gain = F.when(F.col("_r") > 0, F.coalesce("_l", F.lit(0.0)) / F.nullif("_r", F.lit(0.0)))
    return cands.join(wide, ["match_id", "time_s"], "left").select(
        *cands.columns, F.coalesce("_v", F.lit(0.0)).alias("voice_share"), F.coalesce(gain, F.lit(0.0)).alias("low_gain"))


def detect_whistles(windows: DataFrame, sr: int, min_prominence: float = MIN_PROMINENCE,
                    max_voice: float | None = MAX_VOICE, max_low: float | None = MAX_LOW) -> DataFrame:
    merged = merge_close(tone_islands(windows, sr))
    kept = merged.where((F.col("duration_s") >= MIN_DURATION_S) & (F.col("prominence") >= min_prominence))
    out = voice_gates(cut(kept), windows, sr)
    if max_voice is not None:
        out = out.where(F.col("voice_share") < max_voice)
    return out if max_low is None else out.where(F.col("low_gain") < max_low)


def whistle_events(whistles: DataFrame, video: str = "") -> DataFrame:
    """Whistles as review candidates."""
    note = F.concat(F.lit("whistle at "), F.bround("frequency_hz", 0).cast("long").cast("string"), F.lit(" Hz ("),
                    F.format_string("%.2f", F.col("duration_s")), F.lit("s, "),
                    F.bround("prominence", 0).cast("long").cast("string"), F.lit("x the match level) - stoppage candidate"))
    return whistles.select("match_id", "time_s", F.lit("other").alias("type"), F.lit(-1).cast("long").alias("team"),
                           note.alias("note"), F.lit("audio").alias("source"),
                           clip(F.col("prominence") / 300.0, 0.0, 0.9).alias("confidence"), F.lit(video).alias("video"))


def label_candidates(verdicts: DataFrame, cands: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """The nearest candidate of each reviewed event, if closer than ``tolerance``."""
    cols = ["prominence", "voice_share", "low_gain", "frequency_hz", "duration_s"]
    out = neighbors(verdicts, cands, ["match_id"], "time_s", payload=cols, reach=tolerance)
    back, ahead = F.col("time_s") - F.col("prev.t"), F.col("next.t") - F.col("time_s")
    near = F.when(F.col("next").isNull() | (back <= ahead), F.coalesce("prev", "next")).otherwise(F.col("next"))
    out = out.withColumn("near", near)
    return out.where(F.abs(F.col("near.t") - F.col("time_s")) < tolerance).select(
        *verdicts.columns, F.col("near.t").alias("candidate_s"), *[F.col(f"near.{c}") for c in cols])


def gate_report(labeled: DataFrame) -> DataFrame:
    """Per gate: value range by verdict, and what its threshold loses and removes."""
    long = labeled.select("verdict", F.expr("stack(3, 'prominence', prominence, 'voice_share', voice_share, 'low_gain', low_gain)")
                          .alias("gate", "value"))
    at = F.when(F.col("gate") == "prominence", MIN_PROMINENCE).when(F.col("gate") == "voice_share", MAX_VOICE).otherwise(MAX_LOW)
    refuses = F.when(F.col("gate") == "prominence", F.col("value") < at).otherwise(F.col("value") >= at)
    yes, no = F.col("verdict") == "true", F.col("verdict") == "false"
    out = long.groupBy("gate").agg(
        F.min(F.when(yes, F.col("value"))).alias("true_min"), F.max(F.when(yes, F.col("value"))).alias("true_max"),
        F.min(F.when(no, F.col("value"))).alias("false_min"), F.max(F.when(no, F.col("value"))).alias("false_max"),
        F.count(F.when(yes & refuses, 1)).alias("confirmed_lost"), F.count(F.when(no & refuses, 1)).alias("rejected_removed"))
    return out.where(F.col("true_min").isNotNull() & F.col("false_min").isNotNull())
