"""Toxic spans in notes by a linear-chain conditional random field, and note scores from its marginals."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import give_back, mix, records, rows_of, shingle_hashes

_WORD = re.compile(r"\w+")
SEGMENT = 32


BEGINNINGS = range(3, 9)


def features(word: str) -> tuple[str, ...]:
    """What the tagger sees of a word, in lower case: itself, its first 3 to 8 letters, and its end."""
    word = word.lower()
    return "w" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS), "e" + word[-4:]


WIDTH = len(features(""))


def _kinds(texts: list[np.ndarray]) -> np.ndarray:
    """A number for each text (word numbers), equal for copies and near copies: texts that share the least of three
    hashes of their three-word runs are of one kind."""
    kind = np.arange(len(texts))
    for seed in (0x1234567, 0x89ABCDE, 0xF0F0F0F):
        first: dict[int, int] = {}
        for i, words in enumerate(texts):
            runs = shingle_hashes(mix(words.astype(np.uint64) + np.uint64(1)), 3)
            least = int(mix(runs ^ np.uint64(seed)).min()) if len(runs) else -1 - i
            j = first.setdefault(least, i)
            if kind[i] != kind[j]:
                kind[kind == kind[i]] = kind[j]
    return kind


class _Chain:
    """Words of some notes laid out in segments of 32, so that the recursions run over all segments at once.

    States are clean and toxic; the state before a note is clean. A segment is first reduced to its 2x2 product, the
    products are scanned along each note, and the scan's values start the recursion inside each segment. This is the
    exact forward-backward pass.
    """

    def __init__(self, counts: np.ndarray):
        self.segs = -(-counts // SEGMENT)
        self.first = np.cumsum(self.segs) - self.segs
        starts = np.cumsum(counts) - counts
        note = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(note)) - starts[note]
        self.spot = self.first[note] * SEGMENT + within
        self.total = int(self.segs.sum())
        self.real = np.zeros(self.total * SEGMENT, bool)
        self.real[self.spot] = True
        self.real = self.real.reshape(self.total, SEGMENT)
        self.begin = within == 0
        self.longest = np.argsort(-self.segs, kind="stable")

    def marginals(self, emission: np.ndarray, trans: np.ndarray):
        """For each word: the forward and the backward weight of toxic (each pair scaled to 1), and the marginal."""
        move = np.exp(trans)
        odds = np.ones(self.total * SEGMENT)
        odds[self.spot] = np.exp(np.clip(emission, -30, 30))
        odds = odds.reshape(self.total, SEGMENT)
        product = np.broadcast_to(np.eye(2), (self.total, 2, 2)).copy()
        for t in range(SEGMENT):
            step = product @ move
            step[:, :, 1] *= odds[:, t, None]
            step /= step.max(axis=(1, 2), keepdims=True)
            product = np.where(self.real[:, t, None, None], step, product)
        ahead, behind = np.empty((self.total, 2)), np.empty((self.total, 2))
        sizes = self.segs[self.longest]
        a, b = np.tile([1.0, 0.0], (len(sizes), 1)), np.ones((len(sizes), 2))
        for k in range(int(sizes[0]) if len(sizes) else 0):
            some = int(np.searchsorted(-sizes, -k, side="left"))  # notes with more than k segments
            own = self.longest[:some]
            at, back = self.first[own] + k, self.first[own] + self.segs[own] - 1 - k
            ahead[at], behind[back] = a[:some], b[:some]
            a[:some] = np.einsum("ni,nij->nj", a[:some], product[at])
            b[:some] = np.einsum("nij,nj->ni", product[back], b[:some])
            a[:some] /= a[:some].sum(axis=1, keepdims=True)
            b[:some] /= b[:some].sum(axis=1, keepdims=True)
        f, g = np.empty((self.total, SEGMENT)), np.empty((self.total, SEGMENT))
        a1 = ahead[:, 1] / ahead.sum(axis=1)
        for t in range(SEGMENT):
            clean = (1 - a1) * move[0, 0] + a1 * move[1, 0]
            toxic = ((1 - a1) * move[0, 1] + a1 * move[1, 1]) * odds[:, t]
            a1 = np.where(self.real[:, t], toxic / (clean + toxic), a1)
            f[:, t] = a1
        b1 = behind[:, 1] / behind.sum(axis=1)
        for t in range(SEGMENT - 1, -1, -1):
            g[:, t] = b1
            clean = move[0, 0] * (1 - b1) + move[0, 1] * odds[:, t] * b1
            toxic = move[1, 0] * (1 - b1) + move[1, 1] * odds[:, t] * b1
            b1 = np.where(self.real[:, t], toxic / (clean + toxic), b1)
        f, g = f.ravel()[self.spot], g.ravel()[self.spot]
        both = f * g
        return f, g, both / (both + (1 - f) * (1 - g))


@dataclass
class SpanModel:
    """A fitted tagger: a weight for each feature, a bias, transitions, and the weights that turn marginals to a score."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    score: np.ndarray

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


class _Emissions(dict):
    def __init__(self, model: SpanModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.model.emission(word)
        return value


def _summary(marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per note: 1, log of 1 + expected toxic words, their share, and the largest marginal."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    expected = np.maximum(0, total[ends] - total[ends - counts])
    most = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        most[some] = np.maximum.reduceat(marginal, (ends - counts)[some])
    return np.stack([np.ones(len(counts)), np.log1p(expected), np.minimum(20 * expected / np.maximum(counts, 1), 2), most], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit(notes: list[str], toxic: list[int], *, shares: tuple[int, int] | None = None, ratio: float = 12.0,
        steps: int = 40, penalty: float = 2e-2) -> SpanModel:
    """Fit tagger and scorer on labelled notes held in memory.

    Only whole notes carry labels. A word of a toxic note is labelled toxic where its form or a beginning of it stands in
    ``ratio`` times as large a share of the toxic notes as of the clean ones (near copies count once), with a likelihood
    ratio that few of all forms and beginnings would reach by chance; all other words are labelled clean. On these labelled words the field is fitted by gradient steps on its likelihood.
    The scorer is a logistic regression on ``_summary``; ``shares`` (clean, toxic notes in all) corrects for a sample
    that doesn't have the classes in proportion. Without toxic or without clean notes among them nothing is learned: the score
    is 0 for every note, as no note can then be told to be toxic.
    """
    shares = shares or (len(toxic) - sum(toxic), sum(toxic))
    base = float(np.log((shares[1] + 0.5) / (shares[0] + 0.5)))
    trans = np.array([[0.0, -4.0], [0.0, -2.0]])
    if not 0 < sum(toxic) < len(toxic):
        return SpanModel({}, 0.0, trans, np.array([-np.inf, 0, 0, 0]))
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(n.lower())], np.int32) for n in notes]
    names: dict[str, int] = {}
    table = np.array([[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary], np.int32).reshape(-1, WIDTH)
    words = np.concatenate(texts)
    counts = np.array([len(t) for t in texts])
    label = np.array(toxic)
    kinds = _kinds(texts)
    seen, size = np.zeros((2, len(names))), [1, 1]
    for known in (0, 1):  # near copies speak once
        for kind in np.unique(kinds[label == known]):
            every = np.concatenate([texts[i] for i in np.flatnonzero((kinds == kind) & (label == known))])
            if len(every):
                seen[known, np.unique(table[np.unique(every)][:, :-1])] += 1
                size[known] += 1
    share = (seen[1] + 0.1) / size[1] / ((seen[0] + 0.1) / size[0])
    expected = np.outer(size, seen.sum(axis=0) / sum(size))
    evidence = 2 * (seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    telling = (share >= ratio) & (evidence >= 1.6 * np.log(max(2, len(names))))
    marked = telling[table[:, :-1]].any(axis=1)
    y = marked[words] & (label[np.repeat(np.arange(len(counts)), counts)] == 1)

    chain = _Chain(counts)
    weights, bias = np.zeros(len(names)), -3.0
    speed_w, speed_o = np.full(len(names), 1e-6), np.full(4, 1e-6)
    before = np.concatenate([[False], y[:-1]]) & ~chain.begin
    told = np.array([np.sum(before & ~y), np.sum(~before & y), np.sum(before & y)])
    spread = np.sqrt(np.bincount(table[words].ravel(), minlength=len(names)) + 1.0)
    for _ in range(steps):
        emission = (bias + weights[table].sum(axis=1))[words]
        f, g, p = chain.marginals(emission, trans)
        move, odds = np.exp(trans), np.exp(np.clip(emission, -30, 30))
        prior = np.concatenate([[0.0], f[:-1]]) * ~chain.begin
        pair = np.stack([prior * move[1, 0] * (1 - g), (1 - prior) * move[0, 1] * odds * g, prior * move[1, 1] * odds * g])
        pair /= pair.sum(axis=0) + (1 - prior) * move[0, 0] * (1 - g)
        by_word = np.bincount(words, weights=y - p, minlength=len(vocabulary))
        slope = np.bincount(table.ravel(), weights=np.repeat(by_word, WIDTH), minlength=len(names)) / spread - penalty * weights
        other = np.append(told - pair.sum(axis=1), (y - p).sum()) / np.sqrt(len(words))
        speed_w += slope**2
        speed_o += other**2
        weights += 0.5 * slope / np.sqrt(speed_w)
        change = 0.3 * other / np.sqrt(speed_o)
        trans = trans + np.array([[0, change[1]], [change[0], change[2]]])
        bias += change[3]
    emission = (bias + weights[table].sum(axis=1))[words]
    x = _summary(chain.marginals(emission, trans)[2], counts)
    score = np.zeros(4)
    for _ in range(25):  # Newton steps with a small ridge
        p = _sigmoid(x @ score)
        ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
        score += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ score)
    score[0] += base - float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)))
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02}
    return SpanModel(kept, float(bias), trans, score)


def train(events: DataFrame, labels: DataFrame, *, key: str = "event_id", text: str = "note", label: str = "toxic",
          use: Column | None = None, most_notes: int = 1200, most_chars: int = 50_000) -> SpanModel:
    """Fit on a bounded sample of labelled notes: ``most_notes`` of each class are drawn by hash of key, and those of at
    most ``most_chars`` characters teach (of an id's several texts the least). ``labels`` has ``key`` and a 0/1 column ``label``; ``use`` (over the
    key) tells which rows may be learned from. Null labels teach nothing; a key labelled twice counts as its least
    label. The class shares are counted over all labelled rows.
    """
    told = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    told = told.where(F.col("toxic").isin(0, 1) & F.col("key").isNotNull() & (F.lit(True) if use is None else use))
    told = told.groupBy("key").agg(F.min("toxic").alias("toxic"))
    shares = Counter({r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    drawn = [told.where(F.col("toxic") == known).orderBy(F.xxhash64("key"), "key").limit(most_notes) for known in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * most_notes keys
    sample = records(events, key, text).join(chosen, "key").where(F.length("text") <= most_chars).groupBy("key", "toxic").agg(
        F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["key"])
        model = fit([r["text"] for r in rows], [r["toxic"] for r in rows], shares=(shares[0], shares[1]))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the bounded sample is fitted in one task; the driver sees the model only
    row = sample.select("key", "text", "toxic").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], [], shares=(shares[0], shares[1]))


def _scored(fitted: SpanModel, emissions: _Emissions, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, the words' marginals, and the texts' scores."""
    parts = [_WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    emission = np.fromiter((emissions[w] for p in parts for w in p), float, int(counts.sum()))
    marginal = _Chain(counts).marginals(emission, fitted.trans)[2]
    return counts, marginal, _sigmoid(_summary(marginal, counts) @ fitted.score)


def without_toxic(events: DataFrame, model: SpanModel, *, text: str = "note", least: float = 0.5) -> DataFrame:
    """The rows of ``events`` whose score is under ``least``, with all their columns. Each row is judged by its own text,
    whatever its id; nothing is shuffled."""
    shared = events.sparkSession.sparkContext.broadcast(model)
    place = events.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        emissions = _Emissions(fitted)
        for batch in batches:
            judged = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place).fill_null("")], names=["key", "text"])
            for keys, texts in rows_of([judged], chars=2_000_000):
                low = _scored(fitted, emissions, texts)[2] < least
                yield batch.slice(keys[0], len(keys)).filter(pa.array(low))

    return events.mapInArrow(run, events.schema)


def score_notes(events: DataFrame, model: SpanModel, *, key: str = "event_id", text: str = "note") -> DataFrame:
    """``key, score, n_words, spans``: how toxic each whole note is, and where.

    ``score`` is between 0 and 1. ``spans`` has the runs of words whose marginal is at least a half: ``start`` and
    ``end`` in characters (end exclusive) and the run's largest marginal ``p``. One result row for each row of
    ``events``; nothing is shuffled and no other column is read. A null or empty note, or one without words, gets the
    score of no toxic word. The model is broadcast; its size is bounded by the training sample.
    """
    shared = events.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        emissions = _Emissions(fitted)
        for keys, texts in rows_of(batches, chars=2_000_000):
            counts, marginal, scores = _scored(fitted, emissions, texts)
            ends = np.cumsum(counts)
            spans: list[list[dict]] = [[] for _ in texts]
            hot = np.flatnonzero(marginal >= 0.5)
            for i in np.unique(np.searchsorted(ends, hot, side="right")).tolist():
                begin = ends[i] - counts[i]
                last = -2
                places = [m.span() for m in _WORD.finditer(texts[i])]
                for at in (hot[(hot >= begin) & (hot < ends[i])] - begin).tolist():
                    p = float(marginal[begin + at])
                    if at == last + 1:
                        spans[i][-1].update(end=places[at][1], p=max(p, spans[i][-1]["p"]))
                    else:
                        spans[i].append({"start": places[at][0], "end": places[at][1], "p": p})
                    last = at
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(scores), pa.array(counts), pa.array(spans, kind)],
                                             names=["key", "score", "n_words", "spans"])

    kind = dict(events.dtypes)[key]
    key_type = to_arrow_type(events.schema[key].dataType)
    return records(events, key, text).mapInArrow(run, f"key {kind}, score double, n_words bigint, "
                                                 "spans array<struct<start: bigint, end: bigint, p: double>>").withColumnRenamed("key", key)
