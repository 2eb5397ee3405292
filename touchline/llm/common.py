"""What the text operators share: picking columns, Arrow batches, word tables, bounded worker caches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SPACE = b" \t\n\x0b\x0c\r"  # what bytes.split() parts at: exactly x20 and x09 to x0D


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text of each record, under fixed names; null texts become empty, other columns go."""
    return df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def any_key(*columns: str):
    """Let an operator whose ids are whole numbers take keys of any type that has an order.

    Keys that are no whole numbers are numbered in their order (one shuffle of the distinct keys, none of the notes'
    texts but the join that brings the numbers to them), and the numbers in the result's key and in ``columns`` go
    back to keys. A null key stays null.
    """

    def wrap(operator):
        @wraps(operator)
        def run(events: DataFrame, *args, key: str = "event_id", text: str = "note", **options) -> DataFrame:
            kind = dict(events.dtypes)[key]
            if kind in _WHOLE:
                return operator(events, *args, key=key, text=text, **options)
            own = events.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("note"))
            numbers = cut(own.select("key").where("key is not null").distinct().orderBy("key").select(
                "key", F.monotonically_increasing_id().alias("event_id")))
            out = operator(own.join(numbers, "key", "left").select("event_id", "note"), *args, **options)
            out = out.withColumnsRenamed({"kept_note": f"kept_{text}"} if text != "note" and "kept_note" in out.columns else {})
            for column in ("event_id", *columns):
                names = numbers.select(F.col("event_id").alias(column), F.col("key").alias("_name"))
                at = out.columns
                out = out.join(names, column, "left").select(*(F.col("_name").alias(c) if c == column else c for c in at))
            return out.withColumnRenamed("event_id", key)

        return run

    return wrap


def apart(events: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``k, text`` with a unique ``k``; and ``k, key`` with the rows' own keys, which may be null or repeated, where
    ``k`` is not the key itself. Where all keys are there and unique, ``k`` is the key; else the rows are numbered and written
    once, so that no key, however often it is repeated or missing, gathers its rows in one place."""
    rows = records(events, key, text)
    odd = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or key is null")
    if odd.isEmpty():
        return rows.select(F.col("key").cast("bigint").alias("k"), "text"), None
    numbered = cut(rows.withColumn("k", F.monotonically_increasing_id()))
    return numbered.select("k", "text"), numbered.select("k", F.col("key").cast("bigint").alias("key"))


def give_back() -> None:
    """Return the memory that a task's arrays left free to the system: workers are kept, and the next stage of a job needs
    it elsewhere."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 2000, chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts in runs of at most ``most`` records, and of one text or about ``chars`` characters, so that a
    task's Python side works on little text at once."""
    for batch in batches:
        keys, texts, held = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if keys and (len(keys) == most or held + len(text) > chars):
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
        if keys:
            yield keys, texts
    give_back()


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts (parted at x20 and x09-x0D; ``lower``: A-Z count as a-z) as 64-bit hashes in one row, and
    how many each text has. Arrow splits and numbers them; each distinct word is hashed once."""
    column = pa.array(texts, pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    coded = parts.flatten().dictionary_encode()
    words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    real = np.fromiter(map(len, words), np.int64, len(words)) > 0  # ends of a text that are white space give empty words
    keep = real[which]
    ends = np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy()]
    return hashes[which[keep]], np.diff(ends)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finishing step, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * _ODD[4]
    h = h ^ (h >> np.uint64(27))
    h = h * _ODD[5]
    return h ^ (h >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _ODD[0]
    h ^= h >> np.uint64(29)
    h += b * _ODD[1]
    return h


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive word hashes, order of words included. Runs are put together from runs
    of 1, 2, 4, ... words, so the work grows with the logarithm of ``size``."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power, held, whole, length = words, 1, None, 0
    left = size
    while left:
        if left & 1:
            whole = power if whole is None else _joined(whole[:len(words) - length - held + 1], power[length:])
            length += held
        left >>= 1
        if left:
            power = _joined(power[:len(power) - held], power[held:])
            held *= 2
    return mix(whole[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:len(values) - step], values[step:])
        done += step
    return values


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
