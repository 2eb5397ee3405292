"""Repeated passages across notes: seeds from winnowing, extended to full windows, removed but for the first note."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import any_key, apart, mix, rows_of, shingle_hashes, signed, sliding_least, word_hashes

SEED = 5  # words of a seed; a window of 13 words has nine of them


class _Words:
    """The words of some notes in one row of hashes, and where the windows within a note start."""

    def __init__(self, texts: list[str], window: int):
        self.words, self.counts = word_hashes(texts)
        self.note = np.repeat(np.arange(len(texts)), self.counts)
        inside = self.note[window - 1:] == self.note[:len(self.note) - window + 1] if len(self.note) >= window else np.empty(0, bool)
        self.starts = np.flatnonzero(inside)
        self.window = window

    def seeds(self) -> np.ndarray:
        """For each window the least hash among its seeds: equal windows choose equally, wherever they stand."""
        return sliding_least(shingle_hashes(self.words, SEED), self.window - SEED + 1)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def full(self) -> np.ndarray:
        """For each window the hash of all its words."""
        return shingle_hashes(self.words, self.window)[self.starts]

    def second(self, starts: np.ndarray) -> np.ndarray:
        """32 more bits for some windows, of other word hashes."""
        other = np.zeros(len(starts), np.uint64)
        for step in range(self.window):
            other = other * np.uint64(0xD6E8FEB86659FD93) + mix(self.words[starts + step] ^ np.uint64(0xA5A5A5A55A5A5A5A))
        return (mix(other) >> np.uint64(32)).astype(np.uint32)


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Which of some sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _seed_rows(window: int):
    """Distinct seeds by note. A seed that two notes of this run of notes share is known to be shared; only its
    first and last note then speak for it elsewhere, so no seed brings many rows to one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches):
            own = _Words(texts, window)
            seed, at = own.seeds(), own.note[own.starts]
            turn = _fresh(seed, at)  # neighbors mostly share their seed
            seed, note = signed(seed[turn]), np.array(keys, np.int64)[at[turn]]
            order = np.lexsort((note, seed))
            seed, note = seed[order], note[order]
            once = _fresh(seed, note)
            seed, note = seed[once], note[once]
            new = _fresh(seed)
            size = np.diff(np.append(np.flatnonzero(new), len(seed)))
            known = np.repeat(size > 1, size)
            speak = ~known | new | np.append(new[1:], True)[:len(new)]
            told = np.concatenate([np.zeros(speak.sum(), bool), np.ones(known.sum(), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seed[speak], seed[known]])),
                                              pa.array(np.concatenate([note[speak], note[known]])), pa.array(told)], names=["seed", "k", "known"])

    return run


#: a mark is a window's place in its note, with 20 bits of the note's text above it
_PLACE = 40


def _tags(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) >> 44 for t in texts], np.int64) << _PLACE


def _window_rows(window: int, repeated: bool):
    """The windows around shared seeds, each once for a note. Within this run of notes all but the least id are known
    to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            shared, order, at = batch.column(2), batch.column(3 if repeated else 0), 0
            for keys, texts in rows_of([batch]):
                own = _Words(texts, window)
                order_of = order.slice(at, len(keys))
                there = np.unique(shared.slice(at, len(keys)).flatten().to_numpy())
                at += len(keys)
                seeds = signed(own.seeds())
                hit = there[np.minimum(np.searchsorted(there, seeds), len(there) - 1)] == seeds
                if not hit.any():
                    continue
                starts = own.starts[hit]
                first, second, which = own.full()[hit], own.second(starts), own.note[starts]
                place = starts - (np.cumsum(own.counts) - own.counts)[which] + _tags(texts)[which]
                note, rank = np.array(keys, np.int64)[which], pc.rank(order_of, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()[which]
                turn = np.lexsort((place, note, rank, second, first))
                first, second, note, place, rank, which = first[turn], second[turn], note[turn], place[turn], rank[turn], which[turn]
                new = _fresh(first, second)
                least = rank[np.flatnonzero(new)][np.cumsum(new) - 1]
                once = new | _fresh(note, place >> _PLACE)
                own_key = {"o": order_of.take(pa.array(which[once]))} if repeated else {}
                yield pa.RecordBatch.from_pydict({
                    "w1": pa.array(signed(first)[once]), "w2": pa.array(second.view(np.int32)[once]), "k": pa.array(note[once]),
                    "place": pa.array(place[once]), "known": pa.array((rank > least)[once]), **own_key})

    return run


def _keep(window: int):
    """Cover the marked windows, and their equals in the same note, and join the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, copy, at = batch.column(2), batch.column(3).to_pylist(), 0
            for keys, texts in rows_of([batch]):
                own = _Words(texts, window)
                ends = np.cumsum(own.counts)
                begins = ends - own.counts
                bounds = np.searchsorted(own.starts, [0, *ends])
                full = own.full() if any(marks[at + i].is_valid and not copy[at + i] for i in range(len(keys))) else None
                tags, out = _tags(texts), []
                for i, text in enumerate(texts):
                    words, gone = text.encode().split(), 0
                    if copy[at + i]:
                        gone = len(words) if len(words) >= window else 0
                        words = words[gone:]
                    elif marks[at + i].is_valid:
                        places = marks[at + i].values.to_numpy()
                        places = places[(places >> _PLACE) << _PLACE == tags[i]] & ((1 << _PLACE) - 1)
                        lo, hi = bounds[i], bounds[i + 1]
                        removed = np.unique(full[lo:hi][places])
                        starts = np.flatnonzero(np.isin(full[lo:hi], removed))
                        cover = np.zeros(len(words) + 1, np.int64)
                        cover[starts] += 1
                        cover[starts + window] -= 1
                        covered = np.cumsum(cover[:-1]) > 0
                        gone = int(covered.sum())
                        words = [w for w, c in zip(words, covered.tolist()) if not c]
                    out.append((keys[i], int(own.counts[i]), gone, b" ".join(words).decode()))
                at += len(keys)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                                                 names=["key", "n_words", "n_removed", "kept"])

    return run


@any_key()
def remove_repeats(events: DataFrame, *, key: str = "event_id", text: str = "note", window: int = 13) -> DataFrame:
    """``key, n_words, n_removed, kept_note``: each note without the passages that an earlier note has.

    Removed is each word covered by a run of ``window`` words that also stands in a note of smaller id; runs are judged
    on the input. A maximal repeat is the union of its runs. ``kept_note`` has the remaining words joined by one blank.

    Copies of a whole note lose all their runs to the copy of least id and take no further part.

    Seeds: each run chooses the least hash of its five-word pieces, so equal runs share their seed, and only seeds that
    two ids have are followed. Extension: runs around such a seed are compared whole (by 96 bits of hash) and the least
    id of each is found. Both groupings first settle what a task sees itself, so a passage of very many notes brings a
    few rows of each task to its group. The notes are shuffled once, by id, and that exchange serves the extension and
    the rewriting.

    One result row for each row of ``events``. Null and empty notes have no words; notes of fewer than ``window`` words
    lose none; a null id counts as later than all others; rows of one id, and rows without, never repeat each other. Such
    rows are numbered (``apart``), so that none are gathered by their id. Keys may be of any type that has an order; other columns are not
    read; an empty table gives no rows.
    """
    base, names = apart(events, key, text)
    # copies of one text may be very many: each of 16 parts of them meets the text's least id
    # in what order rows come: by their key, which is k itself but where keys are missing or repeated
    keys = None if names is None else names.withColumnRenamed("key", "o")
    own = F.col("k" if keys is None else "o")
    texts = base.select("k", F.unhex(F.md5("text")).alias("h"), F.pmod(F.hash("k"), F.lit(16)).alias("_salt"))
    texts = texts if keys is None else texts.join(keys, "k")
    later = lambda least: least.isNotNull() & (own.isNull() | (own > least))
    first = texts.groupBy("h").agg(F.min(own).alias("least"), F.max(own).alias("most"), F.count_if(own.isNull()).alias("none")).where(
        "least < most or least is not null and none > 0").select("h", "least", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    copies = cut(texts.join(first, ["h", "_salt"]).where(later(F.col("least"))).select("k", F.lit(True).alias("copy")))
    is_copy = F.coalesce("copy", F.lit(False))
    told = F.when(F.col("known"), F.col("k"))

    # the joins with the notes are all by row alone and read one exchange of them
    seeds = base.join(copies, "k", "left").where(~is_copy).select("k", "text").mapInArrow(
        _seed_rows(window), "seed bigint, k bigint, known boolean").withColumn("_to", told)
    group = W.partitionBy("seed", "_to")
    shared = seeds.select("seed", "k", (F.col("known") | (F.min("k").over(group) < F.max("k").over(group))).alias("_shared")).where(
        "_shared").groupBy("k").agg(F.collect_set("seed").alias("seeds"))

    carried = [] if keys is None else ["o"]
    shared = shared if keys is None else shared.join(keys, "k")
    windows = base.join(shared, "k", "left").select("k", "text", "seeds", *carried).mapInArrow(
        _window_rows(window, bool(carried)), "w1 bigint, w2 int, k bigint, place bigint, known boolean" + (", o bigint" if carried else "")
    ).withColumn("_to", told)
    group = W.partitionBy("w1", "w2", "_to")
    marks = windows.select("k", "place", (F.col("known") | later(F.min(own).over(group))).alias("_gone")).where(
        "_gone").groupBy("k").agg(F.collect_list("place").alias("marks"))

    kept = base.join(marks, "k", "left").join(copies, "k", "left").select("k", "text", "marks", is_copy.alias("copy"))
    kept = kept.mapInArrow(_keep(window), "k bigint, n_words bigint, n_removed bigint, kept string")
    kept = kept.withColumn("key", F.col("k")) if names is None else kept.join(names, "k")
    return kept.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept").alias("kept_note"))
