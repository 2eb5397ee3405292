"""Benchmark passages in notes: a multi-pattern search over words with shift and suffix tables (Wu and Manber's).

General text operator: the match records hold no benchmark of their own; ``items`` may be any keyed texts, such as
commentary lines kept back for tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import records

# words are runs of anything but ASCII characters that are no letter or digit; A-Z count as a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class WordPatterns:
    """Search tables for patterns of one length ``m``. The block is the last two words of a window (one where m is 1)."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.size = m, min(2, m)
        self.jump = m - self.size + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for words, items in patterns.items():
            for end in range(self.size, m + 1):
                block = words[end - self.size:end]
                self.shift[block] = min(self.shift.get(block, self.jump), m - end)
            self.buckets.setdefault(words[-self.size:], {}).setdefault(words[:self.size], []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """The start and the items of every occurrence, overlapping ones included."""
        m, size, shift, jump, buckets = self.m, self.size, self.shift.get, self.jump, self.buckets
        at, count = m, len(words)
        while at <= count:
            block = tuple(words[at - size:at])
            step = shift(block, jump)
            if step:
                at += step
                continue
            start = at - m
            for pattern, items in buckets[block].get(tuple(words[start:start + size]), ()):
                if words[start:at] == pattern:
                    yield start, items
            at += 1


def item_windows(items: DataFrame, *, item_key: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``window, item``: each run of ``window`` words of an item (all words of a shorter one), joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                m = min(window, len(words))
                found = {b" ".join(words[i:i + m]).decode() for i in range(len(words) - m + 1)} if m else set()
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([str(item)] * len(found), pa.string())],
                                                 names=["window", "item"])

    return records(items, item_key, item_text).mapInArrow(run, "window string, item string").distinct()


def find_items(events: DataFrame, items: DataFrame, *, key: str = "event_id", text: str = "note", item_key: str = "item_id",
               item_text: str = "text", window: int = 10, max_windows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``key, n_words, spans, items``: where a note holds passages of the items.

    A passage is any run of ``window`` consecutive words of an item, or a whole item that has fewer. ``spans`` has the
    merged runs of hit words (``first``, and ``last`` exclusive), ``items`` the ids found as strings in string order.
    One result row for each row of ``events``, no note is shuffled: the pairs of a window and an item are handed to every
    task in broadcasts of at most about ``max_windows`` pairs and ``max_bytes`` bytes of words and ids (counted before,
    parted evenly by a hash of both, so that the items of one passage are parted too). Where there are more, the notes
    pass through one search for each part, and each pass is written before the next.

    Null and empty notes have no words; items without words match nothing; an item without id counts as "None";
    repeated items count once; an empty table of items finds nothing; other columns are not read.
    """
    spark = events.sparkSession
    windows = cut(item_windows(items, item_key=item_key, item_text=item_text, window=window))
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(
        F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // max_windows), -(-size["bytes"] // max_bytes))
    state = records(events, key, text).withColumns({
        "n_words": F.lit(0).cast("bigint"), "marks": F.array().cast("array<array<bigint>>"), "items": F.array().cast("array<string>")})
    kind = dict(events.dtypes)[key]
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == part)
        by_length: dict[int, dict] = {}
        for found, names in own.groupBy("window").agg(F.collect_list("item")).collect():
            words = tuple(found.encode().split(b" "))
            by_length.setdefault(len(words), {})[words] = names
        tables = spark.sparkContext.broadcast([WordPatterns(m, p) for m, p in sorted(by_length.items())])
        last = part == parts - 1
        state = state.mapInArrow(_search(tables, last), f"key {kind}, text string, n_words bigint, "
                                 "marks array<array<bigint>>, items array<string>")
        if not last:
            state = cut(state)
    return state.select(F.col("key").alias(key), "n_words", F.transform("marks", lambda m: F.struct(
        m[0].alias("first"), m[1].alias("last"))).alias("spans"), "items")


def _search(tables, last: bool):
    """A pass: adds what one part of the windows hits to the marks and items found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks, items = [], [], []
            before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for text, (spans, names) in zip(batch.column(1), before):
                words = words_of(text.as_py())
                found, hits = set(names), list(spans)
                for patterns in tables.value:
                    for start, own in patterns.search(words):
                        found.update(own)
                        hits.append([start, start + patterns.m])
                merged: list[list[int]] = []
                for first, end in sorted(hits):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                counts.append(len(words)), marks.append(merged), items.append(sorted(found))
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(counts, pa.int64()), pa.array(marks, pa.list_(pa.list_(pa.int64()))),
                 pa.array(items, pa.list_(pa.string()))], names=["key", "text", "n_words", "marks", "items"])

    return run


def hit_words() -> Column:
    """How many words the merged ``spans`` of ``find_items`` cover."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
