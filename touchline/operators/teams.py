"""Team labels from kit colors: evidence per track, seeded weighted Lloyd over all matches at once, propagation.

Detections carry ``kit ARRAY<DOUBLE>(12)``: kit share, L, a, b, saturation, value, six hue bins. A descriptor is the
last eleven. Centers are one small row per match; tracks stay distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .blocks import clip, exact_percentiles

TRACK = ["match_id", "track_id"]
DIM = 11
A, SAT = 1, 3
# Fixed values of the evidence and labeling rules
MIN_KIT, MIN_OBS, MAX_HEIGHT, MIN_HEIGHT, LABEL_HEIGHT, QUANTILE = 0.2, 6, 200.0, 60.0, 32.0, 0.75
MIN_SHARE, MAX_DISTANCE, MIN_MARGIN, WEAK = 0.55, 2.5, 0.35, 0.35
FULL_FRAMES, FLOOR_LOW, FLOOR_HIGH = 21552.0, 2.6, 6.0


def kit_rows(dets: DataFrame, min_height: float = MIN_HEIGHT) -> DataFrame:
    """The observations a track's color is read from: player-sized, the largest quarter when that leaves enough."""
    usable = dets.where(F.col("kit")[0] > MIN_KIT).withColumn("_h", F.abs("height_px"))
    in_band = F.col("_h").between(min_height, MAX_HEIGHT)
    enough = usable.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_u"), F.count(F.when(in_band, 1)).alias("_b")).where(
        (F.col("_u") >= MIN_OBS) & (F.col("_b") >= MIN_OBS)).select(*TRACK)
    band = usable.where(in_band).join(enough, TRACK, "left_semi")
    marked = band.join(band.groupBy(*TRACK).agg(F.percentile(F.col("_h").cast("double"), F.lit(QUANTILE)).alias("_q")), TRACK).withColumn(
        "_big", F.col("_h") >= F.col("_q"))
    many = marked.groupBy(*TRACK).agg((F.count(F.when(F.col("_big"), 1)) >= MIN_OBS).alias("_use_big"))
    return marked.join(many, TRACK).where(~F.col("_use_big") | F.col("_big")).select(*dets.columns)


def kit_evidence(dets: DataFrame, min_height: float = MIN_HEIGHT) -> DataFrame:
    """``descriptor ARRAY(11)`` (component medians), ``weight`` (root of the count) and mean kit share per track.

    From the rows of :func:`kit_rows`. A track is a small group, so its rows in the band meet once, and the choice and all
    medians are made on them.
    """
    height = F.abs("height_px").cast("double")
    band = dets.where((F.col("kit")[0] > MIN_KIT) & F.abs("height_px").between(min_height, MAX_HEIGHT)).select(
        *TRACK, height.alias("_h"), "kit")
    tracks = band.groupBy(*TRACK).agg(F.collect_list(F.struct("_h", "kit")).alias("_all"), F.percentile("_h", F.lit(QUANTILE)).alias("_q"))
    tracks = tracks.where(F.size("_all") >= MIN_OBS).withColumn("_big", F.filter("_all", lambda o: o["_h"] >= F.col("_q")))
    tracks = tracks.withColumn("_used", F.when(F.size("_big") >= MIN_OBS, F.col("_big")).otherwise(F.col("_all"))["kit"])

    def ordered(i):
        return F.sort_array(F.array_compact(F.transform("_used", lambda k: k[i].cast("double"))))

    def median(c):
        last = F.size(c) - 1
        return (F.get(c, F.floor(last / 2).cast("int")) + F.get(c, F.ceil(last / 2).cast("int"))) / 2.0

    values = tracks.select(*TRACK, F.size("_used").alias("_n"), *[ordered(i).alias(f"_v{i}") for i in range(DIM + 1)])
    share = F.aggregate("_v0", F.lit(0.0), lambda s, v: s + v) / F.col("_n")
    return values.select(*TRACK, F.array(*[median(f"_v{i}") for i in range(1, DIM + 1)]).alias("descriptor"),
                         F.sqrt("_n").alias("weight"), share.alias("kit_share"))


def evidence_floor(rows: Column, rate: Column) -> Column:
    """How much evidence a voter needs, by the number of detection rows at 5 per second."""
    same = F.greatest(rows * 5.0 / F.greatest(rate, F.lit(1e-6)), F.lit(1.0))
    return clip(F.sqrt(same / FULL_FRAMES) * 6.0, FLOOR_LOW, FLOOR_HIGH)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def lloyd(z: np.ndarray, weight: np.ndarray, centers: np.ndarray, max_rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Lloyd for one match: the label of each row of ``z``, and the centers.

    An empty cluster keeps its center, and of equally near centers the first is taken. Raises after ``max_rounds``.
    """
    labels = np.full(len(z), -1)
    for _ in range(max_rounds):
        near = np.sqrt(((z[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)).argmin(axis=1)
        if (near == labels).all():
            return labels, centers
        labels = near
        centers = np.stack([(z[labels == i] * weight[labels == i, None]).sum(axis=0) / weight[labels == i].sum()
                            if (labels == i).any() else c for i, c in enumerate(centers)])
    raise RuntimeError(f"team colors not settled after {max_rounds} rounds")


def _seeded(tracks: pd.DataFrame) -> pd.DataFrame:
    """The voters of one match with their clusters: greenest and reddest track first, then the dullest of six or more."""
    tracks = tracks.sort_values("track_id", ignore_index=True)
    points = np.stack(tracks["descriptor"].to_numpy()).astype(float)
    mean, spread = points.mean(axis=0), points.std(axis=0) + 1e-6
    z = (points - mean) / spread
    first = [z[:, A].argmax(), z[:, A].argmin()] + ([z[:, SAT].argmin()] if len(z) >= 6 else [])
    labels, centers = lloyd(z, tracks["weight"].to_numpy(), z[first])
    own = [labels == i for i in range(len(centers))]
    out = tracks[TRACK].assign(label=labels)
    for name, value in (("mean", mean), ("spread", spread), ("centers", centers), ("sizes", np.array([o.sum() for o in own])),
                        ("sats", np.array([z[o, SAT].mean() if o.any() else -1.0 for o in own]))):
        out[name] = [value.tolist()] * len(out)
    out["within"] = float(np.sqrt(((z - centers[labels]) ** 2).sum(axis=1)).mean())
    return out


def assign_teams(evidence: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cluster the voters. Returns ``(voters with team and quality, per-match model)``.

    ``floors``: ``match_id, floor``. The model row has mean, spread, centers and the cluster index of each team. Matches
    of fewer than four voters have none. A match's voters are its tracks with much evidence, a small table of one row
    a track: they are clustered in one group, and nothing runs while the plan is built.
    """
    strong = evidence.join(floors, "match_id").where((F.col("kit_share") >= MIN_SHARE) & (F.col("weight") >= F.col("floor")))
    enough = strong.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 4).select("match_id")
    m = strong.select(*TRACK, "descriptor", "weight").join(enough, "match_id").groupBy("match_id").applyInPandas(
        _seeded, "match_id long, track_id long, label long, mean array<double>, spread array<double>, "
        "centers array<array<double>>, sizes array<long>, sats array<double>, within double")
    m = m.withColumn("k", F.size("centers"))
    idx = F.sequence(F.lit(0), F.col("k") - 1)
    middle = F.sort_array("sizes")[1]
    all_n = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, v: s + v)
    odd = F.filter(idx, lambda i: ((F.get("sizes", i) < F.greatest(middle, F.lit(1)) * 0.4) | (F.get("sats", i) <= 0.0))
                   & ((all_n - F.get("sizes", i)) >= all_n * 0.5))
    m = m.withColumn("other", F.when(F.col("k") == 3, F.try_element_at(odd, F.lit(1))))
    by_sat = F.transform(F.sort_array(F.transform(idx, lambda i: F.struct((-F.get("sats", i)).alias("s"), i.alias("i")))),
                         lambda s: s["i"])
    kept = F.when(F.col("other").isNotNull(), F.filter(idx, lambda i: i != F.col("other"))).otherwise(F.slice(by_sat, 1, 2))
    m = m.withColumn("kept", kept)
    ordered = F.sort_array(F.transform("kept", lambda i: F.struct((-F.get("centers", i)[A]).alias("a"), i.alias("i"))))
    m = m.withColumn("teams", F.transform(ordered, lambda s: s["i"].cast("long")))
    m = m.withColumn("between", _distance(
        F.get("centers", F.get("teams", F.lit(0)).cast("int")), F.get("centers", F.get("teams", F.lit(1)).cast("int"))))
    m = m.withColumn("separation", clip((F.col("between") - F.col("within")) / (F.col("between") + F.col("within") + 1e-9),
                                        0.0, 1.0))
    names = ["mean", "spread", "centers", "teams", "separation"]
    model = m.groupBy("match_id").agg(F.first(F.struct(*names)).alias("_m")).select("match_id", "_m.*")
    voters = m.select(*TRACK, (F.array_position("teams", F.col("label")) - 1).cast("long").alias("team"),
                      F.col("separation").alias("quality"))
    return voters, model


def propagate_labels(voters: DataFrame, model: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Team and quality of every track with evidence: voters keep theirs, others take a close and clear center.

    ``near``: evidence from player-sized crops; ``far``: from smaller ones, for tracks without the former.
    """
    rest = near.select(*TRACK, "descriptor").unionByName(
        far.join(near, TRACK, "left_anti").select(*TRACK, "descriptor")).join(voters, TRACK, "left_anti")
    z = F.zip_with(F.zip_with("descriptor", "mean", lambda p, q: p - q), "spread", lambda p, q: p / q)
    rows = rest.join(model, "match_id").withColumn("z", z)
    ranked = F.sort_array(F.transform("centers", lambda c, i: F.struct(_distance(F.col("z"), c).alias("d"), i.alias("i"))))
    rows = rows.withColumn("_r", ranked)
    best = F.col("_r")[0]
    rows = rows.where((best["d"] <= MAX_DISTANCE) & (F.col("_r")[1]["d"] - best["d"] >= MIN_MARGIN))
    team = (F.array_position("teams", best["i"].cast("long")) - 1).cast("long")
    found = rows.select(*TRACK, team.alias("team"),
                        F.when(team >= 0, clip(1.0 - best["d"] / MAX_DISTANCE, 0.0, 1.0)).otherwise(0.0).alias("quality"))
    return voters.unionByName(found)


def team_colors(labeled: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per match and team: median Lab of its tracks and the display color."""
    rows = labeled.where(F.col("team") >= 0).join(evidence, TRACK)
    parts = rows.select("match_id", "team", F.posexplode(F.slice("descriptor", 1, 5)).alias("c", "v"))
    med = exact_percentiles(parts, ["match_id", "team", "c"], F.col("v"), {"m": 0.5})
    wide = med.groupBy("match_id", "team").agg(*[F.max(F.when(F.col("c") == i, F.col("m"))).alias(n)
                                                 for i, n in enumerate(("kit_l", "kit_a", "kit_b"))])
    return labels.with_kit_rgb(wide, F.col("kit_l"), F.col("kit_a"), F.col("kit_b"))


def is_weak() -> Column:
    """A team label whose kit lies nearly as close to the other team's."""
    return (F.col("team") >= 0) & (F.col("quality") < WEAK)


def weak_labels(labeled: DataFrame) -> DataFrame:
    return labeled.where(is_weak())


def histogram_teams(samples: DataFrame, bins: int, min_tracks: int = 10, same: float = 0.95) -> DataFrame:
    """Two teams from color histograms ``(match_id, track_id, hist ARRAY)``: the center of the higher norm is team 0.

    Seeded with the lowest track and the track farthest from it (a fixed choice instead of random restarts). All get
    team 0 when the centers point the same way; matches with fewer than ``min_tracks`` tracks give no rows. A match's
    tracks, one mean histogram each, are clustered in one group.
    """
    mean = samples.groupBy(*TRACK).agg(F.array(*[F.avg(F.col("hist")[i]) for i in range(bins)]).alias("h"))

    def split(tracks: pd.DataFrame) -> pd.DataFrame:
        tracks = tracks.sort_values("track_id", ignore_index=True)
        if len(tracks) < min_tracks:
            return tracks[TRACK].head(0).assign(team=0)
        z = np.stack(tracks["h"].to_numpy()).astype(float)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        far = np.linalg.norm(z - z[0], axis=1).argmax()
        labels, centers = lloyd(z, np.ones(len(z)), z[[0, far]])
        low, high = np.linalg.norm(centers, axis=1)
        if centers[0] @ centers[1] / (low * high + 1e-12) > same:
            return tracks[TRACK].assign(team=0)
        return tracks[TRACK].assign(team=labels if low > high else 1 - labels)

    return mean.groupBy("match_id").applyInPandas(split, "match_id long, track_id long, team long")
