"""Near-duplicate notes by min-max hashing: one scan of signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import any_key, mix, records, rows_of, shingle_hashes, signed, word_hashes
from .graph import components

SKETCH_BITS = 1024
_LAST = 2**63 - 1


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingles of each note as ascending hashes; a note of fewer words is one shingle, one without is none."""
    words, counts = word_hashes(texts, lower=True)
    runs = shingle_hashes(words, size)
    sets, start = [], 0
    for count in counts.tolist():
        if 0 < count < size:
            sets.append(mix(shingle_hashes(words[start:start + count], count) + np.uint64(count)))
        else:
            sets.append(np.unique(runs[start:max(start, start + count - size + 1)]))
        start += count
    return sets


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    return (rng.integers(0, 2**63, count, np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band. Under each permutation the least *and* the greatest image are kept, so ``bands * rows``
    signature values take half as many hash evaluations; each value agrees between two sets as often as they are alike."""
    odd, add = _permutations(bands * rows // 2)
    low, high = np.full(len(odd), 2**64 - 1, np.uint64), np.zeros(len(odd), np.uint64)
    for start in range(0, len(shingles), 4096):
        image = shingles[start:start + 4096, None] * odd + add
        low, high = np.minimum(low, image.min(axis=0)), np.maximum(high, image.max(axis=0))
    # a permutation's two values go to different bands
    values = np.concatenate([low, high]).reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(17))
    for column in range(rows):
        key = mix(key ^ values[:, column])
    return key


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the set's hashes in 1,024 cells: two sets differ in at least as many shingles as cells."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches):
            sets = shingle_sets(texts, size)
            d1 = [int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0]) for s in sets]
            d2 = [int(signed(np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5DEECE66D)), initial=np.uint64(0))]))[0]) for s in sets]
            keyed = [signed(band_keys(s, bands, rows)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()),
                pa.array(d2, pa.int64()), pa.array(keyed, pa.list_(pa.int64())), pa.array(map(_sketch, sets), pa.binary())],
                names=["id", "n", "d1", "d2", "bands", "sketch"])

    return run


def _close(a: dict, b: dict, percent: int) -> np.ndarray:
    """Which pairs may reach the likeness: a bound by sizes and one by sketches, neither of which loses a pair."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(a["sketch"][at] ^ b["sketch"][at]).sum(axis=1, dtype=np.int64)
    ok[at] = (100 + percent) * differ <= (100 - percent) * (na[at] + nb[at])
    return ok


def _columns(batch: pa.RecordBatch, suffix: str) -> dict:
    size = batch.column(f"s{suffix}")
    return {"n": batch.column(f"n{suffix}").to_numpy(), "sketch": np.frombuffer(b"".join(size.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)}


# a pair of ids, least first, and their components, least first: the pair brings them along, so that no join looks them up again
_PAIR = ["a", "b", "ca", "cb"]
_PAIR_DDL = "a bigint, b bigint, ca bigint, cb bigint"


def _pair(x: str, y: str, of_x: str, of_y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.least(of_x, of_y).alias("ca"), F.greatest(of_x, of_y).alias("cb")]


def _sieve(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _close(_columns(batch, "a"), _columns(batch, "b"), percent)
                yield batch.select(_PAIR).filter(pa.array(ok))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb")):
                a, b = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[spot] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_pairs(percent: int):
    """Within one pair of blocks of a bucket: the pairs of different components that pass the bounds."""

    def run(members: pa.Table) -> pa.Table:
        ours = members.column("side").to_numpy()
        x, y = (members.filter(pa.array(ours == side)).combine_chunks().to_batches() for side in (0, 1))
        out = [np.empty((4, 0), np.int64)]
        if x and y:
            x, y = x[0], y[0]
            xs, ys = _columns(x, ""), _columns(y, "")
            xi, yi = x.column("id").to_numpy(), y.column("id").to_numpy()
            xc, yc = x.column("component").to_numpy(), y.column("component").to_numpy()
            for i in range(len(xi)):
                j = np.flatnonzero(yc != xc[i])
                one = {k: np.repeat(v[i:i + 1], len(j), axis=0) for k, v in xs.items()}
                j = j[_close(one, {k: v[j] for k, v in ys.items()}, percent)]
                out.append(np.stack([np.full(len(j), xi[i]), yi[j], np.full(len(j), xc[i]), yc[j]]))
        a, b, ca, cb = np.concatenate(out, axis=1)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "ca": np.minimum(ca, cb), "cb": np.maximum(ca, cb)})

    return run


@any_key("component")
def near_duplicates(events: DataFrame, *, key: str = "event_id", text: str = "note", shingle: int = 5, percent: int = 80,
                    bands: int = 24, rows: int = 4, rounds: int = 2, block: int = 256) -> DataFrame:
    """``key, n_shingles, component, kept``: notes linked where their shingle sets are alike by ``percent`` or more.

    1. One scan gives each note the size, a 128-bit digest, the band keys and a parity sketch of its shingle set.
    2. Notes of equal digest are one class, stood for by its least id; what follows is between classes.
    3. Classes that share a band key are a bucket. In each of ``rounds`` rounds every bucket that still holds more than
       one component pairs its members with one member, another one each round; the pairs are confirmed and joined up.
    4. What is still apart is compared exactly, component against component, in pairs of blocks of ``block`` members
       dealt to all tasks; only pairs that pass two exact bounds leave a block. So no link is lost between notes that
       share a bucket, and no bucket is paired out in full where its members hang together.
    A link at 80 % is missed by all of 24 bands of 4 values with a chance of 3 in a million, less above.

    ``kept`` is true for the least id of a component. Words are parted at x20 and x09-x0D, A-Z count as a-z. A note of
    fewer than ``shingle`` words is one shingle; a null note or one without words has no shingles and no links. A null id
    has no component, is linked with nothing, and is kept. Each row has a result row, repeated rows equal ones; an id with
    several texts links by the one of fewest shingles. Other columns are not read; an empty table gives no rows.
    """
    if bands * rows % 2:
        raise ValueError("each permutation gives two values: bands * rows must be even")
    notes = records(events, key, text)
    base = cut(notes.mapInArrow(_signatures(shingle, bands, rows),
                                "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"))
    full = base.where("n > 0 and id is not null")
    classes = cut(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members")))
    # an id stands for one class only
    chosen = classes.groupBy(F.col("class").alias("id")).agg(F.min(F.struct("n", "d1", "d2")).alias("_h")).select("id", "_h.*")
    heads = full.join(chosen, ["id", "n", "d1", "d2"], "left_semi")

    buckets = heads.select("id", F.posexplode("bands").alias("band", "bucket")).select("id", F.xxhash64("band", "bucket").alias("bucket"))
    shared = buckets.groupBy("bucket").agg((F.min("id") < F.max("id")).alias("_two")).where("_two").select("bucket")
    members = cut(buckets.join(shared, "bucket").distinct())
    involved = members.select("id").distinct()
    facts = cut(heads.join(involved, "id", "left_semi").select("id", "n", "sketch").distinct())
    sets = cut(notes.withColumnRenamed("key", "id").join(involved, "id", "left_semi").mapInArrow(_set_rows(shingle), "id bigint, s binary")
               .groupBy("id").agg(F.min(F.struct(F.length("s").alias("_l"), "s")).alias("_s")).select("id", "_s.s"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", "sa", "sb").mapInArrow(_confirm(percent), "a bigint, b bigint")

    def sieved(pairs: DataFrame) -> DataFrame:
        side = lambda c: facts.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select(*_PAIR, "na", "nb", "sa", "sb").mapInArrow(_sieve(percent), _PAIR_DDL)

    parts = cut(involved.withColumn("component", F.col("id")))
    for turn in range(rounds + 1):
        placed = members.join(parts, "id")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_n"),
                                             F.min(F.struct(F.xxhash64("id", "bucket", F.lit(turn)).alias("_r"), "id", "component")).alias("_c"))
        mixed = mixed.where("_lo < _hi").select("bucket", "_n", F.col("_c.id").alias("center"), F.col("_c.component").alias("_of"))
        if turn < rounds:
            pairs = sieved(placed.join(mixed, "bucket").where(F.col("component") != F.col("_of")).select(
                *_pair("id", "center", "component", "_of")).distinct())
        else:
            pairs = _rest(placed.join(mixed.select("bucket", "_n"), "bucket"), facts, percent, block)
        # links join components; what they join is found on the components alone
        merged = components(confirmed(pairs))
        parts = cut(parts.join(merged.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select(
            "id", F.coalesce("_to", "component").alias("component")))

    named = classes.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").select(
        "n", "d1", "d2", "class", "members", F.coalesce("component", "class").alias("component"))
    multiple = cut(named.where("members > 1 or component <> class").select("n", "d1", "d2", "component"))
    out = base.select("id", "n", "d1", "d2").join(multiple, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component"),
                      (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches, chars=1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())],
                                             names=["id", "s"])

    return run


def _rest(placed: DataFrame, facts: DataFrame, percent: int, block: int) -> DataFrame:
    """All pairs of different components in the given buckets that pass the bounds, by pairs of blocks."""
    dealt = placed.withColumn("_k", F.ceil(F.col("_n") / block).cast("int")).withColumn("_i", F.pmod(F.xxhash64("id", "bucket"), "_k").cast("int"))
    dealt = dealt.join(facts, "id")
    every = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(
        F.least(j, "_i").alias("x"), F.greatest(j, "_i").alias("y"), F.when(F.col("_i") <= j, 0).otherwise(1).alias("side")))
    # a block meets itself once: there its members stand on both sides
    twice = F.transform(F.array(F.lit(1)), lambda s: F.struct(F.col("_i").alias("x"), F.col("_i").alias("y"), s.alias("side")))
    rows = dealt.select("bucket", "id", "component", "n", "sketch", F.explode(F.concat(every, twice)).alias("_b")).select(
        "bucket", "_b.x", "_b.y", "_b.side", "id", "component", "n", "sketch")
    return rows.withColumnRenamed("sketch", "s").groupBy("bucket", "x", "y").applyInArrow(
        _block_pairs(percent), _PAIR_DDL).distinct()
