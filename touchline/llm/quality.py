"""Quality rules of notes, judged by note and by the source that wrote them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .common import SPACE, records, rows_of, shingle_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"


def _repeated(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per note: how many words lie in three-word runs that the note has twice or more."""
    if len(words) < 3:
        return np.zeros(len(counts), np.int64)
    note = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(note[2:] == note[:-2])
    runs = shingle_hashes(words, 3)[starts]
    order = np.lexsort((runs, note[starts]))
    same = (np.diff(runs[order]) == 0) & (np.diff(note[starts][order]) == 0)
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for step in range(3):
        cover[starts[twice] + step] = True
    return np.bincount(note[cover], minlength=len(counts))


def note_statistics(events: DataFrame, *, key: str = "event_id", text: str = "note", source: str = "source") -> DataFrame:
    """``key, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of each whole note.

    Words are parted at x20 and x09-x0D. ``n_lines`` and ``n_dup_lines`` count lines with a word, the latter those equal
    to an earlier one. Null and empty notes count as nothing. One row for each row of ``events``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_of(batches):
            raw = [t.encode() for t in texts]
            words, counts = word_hashes(texts)
            repeats = _repeated(words, counts)
            chars = [len(t) - len(b) + len(b.translate(None, SPACE)) for t, b in zip(texts, raw)]
            symbols = [len(b) - len(b.translate(None, SYMBOLS)) for b in raw]
            lines = [[x for x in b.split(b"\n") if x.strip(SPACE)] for b in raw]
            kinds = [pa.array([r["k"] for r in rows], key_type), pa.array([r["s"] for r in rows], pa.string())]
            numbers = (counts, chars, symbols, [len(x) - len(set(x)) for x in lines], repeats, [len(x) for x in lines])
            yield pa.RecordBatch.from_arrays([*kinds, *(pa.array(x, pa.int64()) for x in numbers)], names=names)

    kind = dict(events.dtypes)[key]
    key_type = to_arrow_type(events.schema[key].dataType)
    names = ["key", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    both = events.select(F.struct(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").cast("string").alias("s")).alias("_id"),
                         F.col(f"`{text}`").alias("_text"))
    out = records(both, "_id", "_text").mapInArrow(run, f"key {kind}, source string, " + ", ".join(f"{n} bigint" for n in names[2:]))
    return out.withColumnRenamed("key", key)


#: a note fails a rule where its expression is true; those of _BASE reject the note whatever its source is
_BASE = {"few_words": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words"}
_MORE = {"symbols": "10 * n_symbols > n_words", "same_lines": "10 * n_dup_lines > 3 * n_lines",
         "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words"}


def source_verdicts(statistics: DataFrame, *, source: str = "source") -> DataFrame:
    """``source, notes, failures, rate, rejected``: sources by the shrunken share of their notes that fail any rule.

    The prior is a beta distribution fitted to all sources by moments: its mean is the share of failing notes, its
    strength follows from how much the sources' shares spread beyond what chance gives (two notes' worth at least,
    10,000 at most). ``rate`` is the posterior mean ``(failures + a) / (notes + a + b)``, so a source of few notes is
    judged by the rest. A source is rejected where ``rate`` is over a half and over half of its own notes fail. Notes are counted before anything is
    shuffled; the prior is one row of sums over sources. Notes without a source are a source of their own (null).
    """
    failed = " or ".join(f"({rule})" for rule in (*_BASE.values(), *_MORE.values()))
    hosts = statistics.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("notes"), F.sum(F.expr(failed).cast("bigint")).alias("failures"))
    sums = hosts.agg(F.sum("notes").alias("n"), F.sum("failures").alias("x"), F.count(F.lit(1)).alias("hosts"),
                     F.sum(F.expr("failures * 1e0 * failures / notes")).alias("xx"),
                     F.sum(F.expr("notes * 1e0 * notes")).alias("nn"))
    prior = sums.select(F.expr("x * 1e0 / n").alias("mean"), F.expr("n * 1e0").alias("n"), "hosts", "nn",
                        F.expr("xx - x * 1e0 * x / n").alias("spread"))
    # moments: E[spread] = mean (1 - mean) ((hosts - 1) + rho (n - nn / n - hosts + 1)), strength = 1 / rho - 1
    prior = prior.select("mean", F.expr(
        "(spread / nullif(mean * (1e0 - mean), 0e0) - (hosts - 1)) / nullif(n - nn / n - hosts + 1, 0e0)").alias("rho"))
    prior = prior.select("mean", F.expr("case when rho > 0e0 then greatest(2e0, least(10000e0, 1e0 / rho - 1e0)) else 10000e0 end").alias("strength"))
    rate = F.expr("(failures + mean * strength) / (notes + strength)")
    return hosts.crossJoin(F.broadcast(prior)).select(  # the prior is a single row of sums
        "source", "notes", "failures", rate.alias("rate"), ((rate > 0.5) & F.expr("2 * failures > notes")).alias("rejected"))


def judge_notes(events: DataFrame, *, key: str = "event_id", text: str = "note", source: str = "source") -> DataFrame:
    """The note's statistics with ``base_failed``, ``source_rate`` and ``kept``.

    A note is kept unless it fails a base rule itself (under 50 words, or over half of its words in repeated runs) or
    its source is rejected (see ``source_verdicts``). The texts are scanned once; the statistics are written, then
    aggregated by source and joined to the verdicts, whose size the planner knows when it joins them. A hot source
    reaches its group as one row from each task. An empty table gives no rows.
    """
    statistics = cut(note_statistics(events, key=key, text=text, source=source))
    verdicts = source_verdicts(statistics).select(F.col("source").alias("_source"), F.col("rate").alias("source_rate"), "rejected")
    judged = statistics.join(verdicts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    base = F.expr(" or ".join(f"({rule})" for rule in _BASE.values()))
    return judged.withColumn("base_failed", base).withColumn("kept", ~base & ~F.col("rejected"))
