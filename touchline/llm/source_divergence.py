"""How unlike the sources of one kind of record use words: exact distances of term shares by a tree of term rows.

The library's own records are reviewed events: ``type`` is the kind, ``source`` who or what wrote the ``note``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import give_back

#: a term is a run of letters A-Z and of whatever lies outside ASCII; only A-Z are folded
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of all texts, the number of each place's term, and the text it stands in."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(data[int(offsets[0]):int(offsets[-1])] if data is not None else b"").translate(_FOLD)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))
    parts = pc.ascii_split_whitespace(folded)
    coded = parts.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    keep = real[which] if len(which) else np.zeros(0, bool)
    return coded.dictionary, which[keep], text[keep]


def count_terms(events: DataFrame, *, kind: str = "type", source: str = "source", text: str = "note") -> DataFrame:
    """``kind, source, term, n, notes``: how often each source writes a term, and in how many notes; counted in each task
    before anything is shuffled. Null kinds, sources and notes count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups: dict[tuple, int] = {}
            own = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            names = list(groups)
            dictionary, which, place = _terms(batch.column(2))
            width = max(1, len(dictionary))
            keys, n = np.unique(own[place] * width + which, return_counts=True)
            once = np.unique(place * width + which)
            notes = np.unique(own[once // width] * width + once % width, return_counts=True)[1]
            group = keys // width
            yield pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in names], pa.string()).take(pa.array(group)),
                pa.array([g[1] for g in names], pa.string()).take(pa.array(group)),
                dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(notes, pa.int64())],
                names=["kind", "source", "term", "n", "notes"])
        give_back()

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    found = events.select(empty(kind), empty(source), empty(text)).mapInArrow(run, "kind string, source string, term string, n bigint, notes bigint")
    return found.groupBy("kind", "source", "term").agg(F.sum("n").alias("n"), F.sum("notes").alias("notes"))


class _Tree:
    """Rows come in the order of their paths, so that only one path of the tree is open at a time.

    A node is a source with its share of a term, below the sources before it. When a node closes, all rows through it are
    counted, and it adds one correction for each of its ancestors, times that count, to the pair of both sources.
    """

    def __init__(self):
        self.source, self.share, self.none = (np.zeros(64, np.int64) for _ in range(3))
        self.rows: list[int] = []
        self.sums: dict[int, np.ndarray] = {}

    def close(self, depth: int) -> None:
        while len(self.rows) > depth:
            at, rows = len(self.rows) - 1, self.rows.pop()
            if not at:
                continue
            self.rows[-1] += rows
            p, none, q, absent = self.share[at], self.none[at], self.share[:at], self.none[:at]
            # both sources have the term, where the pair's base and both single corrections took one of them as without
            more = np.abs(p - q) - np.abs(p - absent) - np.abs(none - q) + np.abs(none - absent)
            source, others = int(self.source[at]), self.source[:at]
            sums = self.sums.get(source)
            if sums is None:
                sums = self.sums[source] = np.zeros(source + 1, np.int64)
            sums[others] += rows * more

    def add(self, depth: int, sources: np.ndarray, shares: np.ndarray, none: np.ndarray, rows: int) -> None:
        """A row that has the first ``depth`` nodes in common with the open path."""
        self.close(depth)
        size = len(sources)
        if size > len(self.source):
            self.source, self.share, self.none = (np.concatenate([a, np.zeros(size, np.int64)]) for a in (self.source, self.share, self.none))
        for held, own in ((self.source, sources), (self.share, shares), (self.none, none)):
            held[depth:size] = own[depth:]
        self.rows += [0] * (size - depth)
        self.rows[-1] += rows

    def held(self) -> int:
        return sum(map(len, self.sums.values()))


def _corrections(most_held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, kind, last = _Tree(), None, None

        def flush() -> pa.RecordBatch:
            b = np.concatenate([np.full(len(s), k) for k, s in tree.sums.items()])
            a = np.concatenate([np.arange(len(s)) for s in tree.sums.values()])
            value = np.concatenate(list(tree.sums.values()))
            tree.sums.clear()
            some = np.flatnonzero(value)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.string()), pa.array(a[some], pa.int32()), pa.array(b[some], pa.int32()),
                                               pa.array(value[some], pa.int64())], names=["kind", "a", "b", "value"])

        for batch in batches:
            path, rows = batch.column(1), batch.column(2).to_numpy()
            offsets = path.offsets.to_numpy()
            flat = path.flatten()
            base = int(offsets[0]) if len(offsets) else 0
            source, share, none = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != kind:
                    tree.close(0)
                    if tree.sums:
                        yield flush()
                    kind, last = own, None
                lo, hi = int(offsets[i]) - base, int(offsets[i + 1]) - base
                here = (source[lo:hi], share[lo:hi])
                depth = 0
                if last is not None:
                    size = min(len(last[0]), hi - lo)
                    differ = np.flatnonzero((last[0][:size] != here[0][:size]) | (last[1][:size] != here[1][:size]))
                    depth = int(differ[0]) if len(differ) else size
                tree.add(depth, *here, none[lo:hi], int(rows[i]))
                last = here
                if tree.held() > most_held:
                    yield flush()
        tree.close(0)
        if tree.sums:
            yield flush()
        give_back()

    return run


def pair_corrections(cells: DataFrame, *, most_held: int = 4_000_000) -> DataFrame:
    """``kind, a, b, value`` (``a < b``, numbers of sources): by how much the terms that both sources have change the sum of
    distances that counts each as the other one's only.

    ``cells`` (``kind, term, sid, p, none``) are the sources' shares ``p`` of the terms that they have, and their share
    ``none`` of any they lack. A term's cells in the order of their sources are a row; equal rows are one with a
    multiplicity. Rows are ranged by kind and the beginning of their path and read in order by the tree. A node that a border between
    partitions divides is two nodes with a part of the rows each, so that any number of rows may share a path. A task
    holds one path and at most about ``most_held`` sums of pairs.
    """
    rows = cells.groupBy("kind", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "none"))).alias("path"))
    rows = rows.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("rows"))
    # ranges by the path's first nodes, so that the samples they are cut by stay small, then by hash, so that no range is too large
    ordered = rows.repartitionByRange("kind", F.slice("path", 1, 3), F.xxhash64("path")).sortWithinPartitions("kind", "path")
    parts = ordered.select("kind", "path", "rows").mapInArrow(_corrections(most_held), "kind string, a int, b int, value bigint")
    return parts.groupBy("kind", "a", "b").agg(F.sum("value").alias("value"))


def _share(n: str, total: str, smoothing: int, scale: int) -> F.Column:
    """``1 + floor(scale * (n + smoothing) / total)`` in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (cast({scale} as decimal(12, 0)) * cast({n} + {smoothing} as decimal(20, 0))) div cast({total} as decimal(20, 0))")


def audit_sources(events: DataFrame, *, kind: str = "type", source: str = "source", text: str = "note", least_notes: int = 30,
                  smoothing: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """``kind, source, part, item, value, rank``: how a source's words differ from those of the others of its kind.

    A kind's terms are those in at least ``least_notes`` of its notes. Of each, every source of the kind (also one whose
    notes have none) and the kind itself have the share ``1 + floor(scale * (n + smoothing) / (N + smoothing * V))``: n
    its occurrences there, N the occurrences of all terms there, V the number of terms. Whole numbers throughout.

    Part ``pair`` has each other source of the kind with the sum over all terms of the absolute difference of both
    shares (0 without terms). Part ``term`` has the ``top`` terms that the source uses and more than the kind does, with
    that difference. Ranks count from 1 by source and part, values descending, then items by their UTF-8 bytes.

    A pair's sum is put together from what it would be were each term missing in both (one product), from how each
    source's own terms change that (by its distinct shares), and from the terms that both have
    (``pair_corrections``). No table of all terms by all pairs is made; the only rows for each pair are the result's.
    A kind or source with most of all notes reaches a group as counts. A term's row is as long as its kind has sources.

    Null kinds, sources and notes count as empty; repeated notes count again; other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    counts = count_terms(events, kind=kind, source=source, text=text)
    whole = W.partitionBy("kind", "term")
    cells = counts.withColumn("notes", F.sum("notes").over(whole)).where(F.col("notes") >= least_notes)
    cells = cut(cells.select("kind", "source", "term", "n", F.sum("n").over(whole).alias("kind_n")))

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    every = events.select(empty(kind).alias("kind"), empty(source).alias("source")).distinct()
    kinds = cells.groupBy("kind").agg(F.sum("n").alias("kind_total"), F.count_distinct("term").alias("terms"))
    totals = cells.groupBy("kind", "source").agg(F.sum("n").alias("own"))
    total = F.coalesce("own", F.lit(0)) + smoothing * F.col("terms")
    sources = every.join(kinds, "kind", "left").join(totals, ["kind", "source"], "left").withColumn("total", total).select(
        "kind", "source", (F.row_number().over(W.partitionBy("kind").orderBy("source")) - 1).alias("sid"), "total", "terms",
        _share("0", "total", smoothing, scale).alias("none"),
        (F.col("kind_total") + smoothing * F.col("terms")).alias("kind_total"))
    sources = cut(sources)

    known = cells.join(sources, ["kind", "source"]).withColumn("p", _share("n", "total", smoothing, scale))
    a = sources.select("kind", F.col("sid").alias("a"), F.col("none").alias("none_a"), "terms")
    b = sources.select("kind", F.col("sid").alias("b"), F.col("none").alias("none_b"))
    base = a.join(b, "kind").where("a < b").select("kind", "a", "b", F.expr("coalesce(terms * abs(none_a - none_b), 0)").alias("value"))
    distinct = known.groupBy("kind", F.col("sid").alias("a"), "p", F.col("none").alias("none_a")).agg(F.count(F.lit(1)).alias("m"))
    # a kind with most of all sources is dealt to several tasks
    salted = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    alone = distinct.withColumn("_salt", F.pmod(F.hash("a", "p"), F.lit(16))).join(salted, ["kind", "_salt"]).where("a <> b").groupBy("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum(F.expr("m * (abs(p - none_b) - abs(none_a - none_b))")).alias("value"))
    both = pair_corrections(known.select("kind", "term", "sid", "p", "none"))
    sums = base.unionByName(alone).unionByName(both).groupBy("kind", "a", "b").agg(F.sum("value").alias("value"))
    sums = sums.select("kind", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_ab")).select(
        "kind", "value", "_ab.a", "_ab.b")
    name = lambda at, column: sources.select("kind", F.col("sid").alias(at), F.col("source").alias(column))
    pairs = sums.join(name("a", "source"), ["kind", "a"]).join(name("b", "item"), ["kind", "b"])
    by_value = W.partitionBy("kind", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("kind", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    more = known.withColumn("q", _share("kind_n", "kind_total", smoothing, scale)).where("p > q")
    terms = more.select("kind", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
