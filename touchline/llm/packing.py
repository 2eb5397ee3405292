"""Packing of token runs into sequences of fixed room by best-two-fit, planned on counts of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import any_key, records, rows_of
from .tokens import REMEMBERED, RUN_CHARS, encoder


def token_pieces(events: DataFrame, vocabulary: str, *, key: str = "event_id", text: str = "note", end_id: int = 0,
                 room: int = 2048, cuts: str = "bytes", run_chars: int = RUN_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: each note's ids and an end id, cut only where longer than ``room``.

    Of a cut note the first piece is the shorter one, all others fill a sequence. A null or empty note is its end id.
    Repeated rows give repeated pieces. ``run_chars`` and ``remembered`` bound a worker's memory, see ``tokens``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, cuts, remembered)
        for keys, notes in rows_of(batches, 8000, run_chars):
            out: list[tuple] = []
            for name, own in zip(keys, coder.encode(notes)):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
                out += [(name, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                                             names=["key", "piece", "start", "length", "ids_crc32"])

    return records(events, key, text).mapInArrow(
        run, "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def plan_best_two_fit(counts: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Bins as ``(how many, lengths in each)``, from how many runs there are of each length 1..room.

    A bin takes the longest run that fits, again and again. When none fits, the bin's smallest run is put back if two
    other runs fit the widened gap more tightly than it did (the tightest pair, then the one with the longest run). As
    equal runs are interchangeable, a bin is repeated as often as its lengths last. So the plan has at most a few bins
    for each length, however many runs there are.
    """
    left = np.zeros(room + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    plan = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        free, own = left.copy(), []
        gap = room
        while gap:
            fits = np.flatnonzero(free[:gap + 1])
            if not len(fits):
                break
            own.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= own[-1]
        if gap and own:
            small = own[-1]
            wide = gap + small
            first = np.flatnonzero(free[:wide + 1])
            if len(first):
                # for each first run the longest second run that still fits
                index = np.searchsorted(first, wide - first, side="right") - 1
                second = np.where(index >= 0, first[np.maximum(index, 0)], 0)
                same = (second == first) & (free[first] < 2)
                lower = np.where(same, index - 1, index)
                second = np.where(lower >= 0, first[np.maximum(lower, 0)], 0)
                total = np.where(second > 0, first + second, 0)
                best = int(np.lexsort((first, total))[-1])
                if total[best] > small:
                    pair = sorted((int(first[best]), int(second[best])), reverse=True)
                    own = own[:-1] + pair
        lengths, uses = np.unique(own, return_counts=True)
        often = int((left[lengths] // uses).min())
        left[lengths] -= often * uses
        plan.append((often, own))


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on a place in a bin counts, that bin's first number, and the place in it."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for often, own in plan:
        offset = 0
        for length in own:
            rank = ranks.get(length, 0)
            places.setdefault(length, []).append((rank, first, offset))
            ranks[length] = rank + often
            offset += length
        first += often
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in places.items()}


def pack(pieces: DataFrame, *, key: str = "event_id", room: int = 2048, shards: int | None = None) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces`` (``key, piece, start, length, ids_crc32``, lengths 1..room).

    Only counts by length leave the workers: at most ``room`` rows, whatever the input, and the plan made of them goes
    back as a broadcast of at most a few places for each length. A run's place follows from its rank among the runs of
    its length. Ranks are counted in ``shards`` parts of each length (by key; four for each shuffle partition unless
    given), so that a length with very many runs is no single group. Null keys and repeated rows are placed like any others. An empty table has no sequences.
    """
    spark = pieces.sparkSession
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces.withColumn("_shard", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    sizes = parts.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    sizes = cut(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_best_two_fit(counts, room)))
    before = sizes.select("length", "_shard", (F.sum("_n").over(W.partitionBy("length").orderBy("_shard")) - F.col("_n"))
                          .alias("_before"))
    ranked = parts.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_shard").orderBy(key, "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_shard"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = slots.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.unique(length):
                rows = np.flatnonzero(length == own)
                since, first, at = by_length[int(own)]
                index = np.searchsorted(since, rank[rows], side="right") - 1
                sequence[rows] = first[index] + rank[rows] - since[index]
                offset[rows] = at[index]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    names = [key, "piece", "start", "length", "ids_crc32"]
    kinds = dict(pieces.dtypes)
    return ranked.select(*names, "_rank").mapInArrow(
        place, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id bigint, offset bigint")


@any_key()
def pack_notes(events: DataFrame, vocabulary: str, *, key: str = "event_id", text: str = "note", end_id: int = 0,
               room: int = 2048, **memory) -> DataFrame:
    """Token pieces of all notes with their places in sequences of ``room`` ids; see ``token_pieces`` and ``pack``."""
    pieces = cut(token_pieces(events, vocabulary, key=key, text=text, end_id=end_id, room=room, **memory))
    return pack(pieces, key=key, room=room)
