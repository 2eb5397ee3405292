"""Byte-level pair encoding by replaying a vocabulary's merges over all distinct words of a run of notes, and decoding.

The library's own records are the notes of reviewed events (``match_id, event_id, note``); any keyed text works.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import give_back

#: the pattern whose rules ``split_words`` follows (fixed values: its text and its contractions)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ONE, _TWO = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4
#: characters that a worker takes in at a time, and words that it remembers between runs: memory against time, results
#: are the same
RUN_CHARS, REMEMBERED = 6_000_000, 600_000
_NEVER = np.int64(1) << 40
_LOADED: dict[str, "MergeReplay"] = {}


class Classes:
    """Letter, number, blank or other for each code point, as an engine of the pattern sees them.

    Unicode versions differ between engines, so a code point is asked for when it first comes up: ``together`` tells of two
    characters whether the engine has them in one word, and is asked behind one of each class.
    """

    def __init__(self, together: Callable[[str], bool]):
        self.table = np.zeros(0x110000, np.uint8)
        self.together = together
        self.of(np.arange(128, dtype=np.uint32))

    def _ask(self, point: int) -> int:
        return next((kind for lead, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if self.together(lead + chr(point))), BLANK)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if len(found) and not found.all():
            for point in np.unique(points[found == 0]).tolist():
                self.table[point] = self._ask(point)
            found = self.table[points]
        return found


@cache
def rank_file_classes() -> Classes:
    """Those of the library for rank files, asked with a vocabulary in which any character merges with any byte behind it."""
    import tiktoken
    ranks = {bytes([i]): i for i in range(256)} | {lead + bytes([i]): 256 * (1 + n) + i for n, lead in enumerate((b"a", b"1", b"!")) for i in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Classes(lambda pair: probe.encode_ordinary(pair)[0] >= 256)


def split_words(texts: list[str], classes: Classes | None = None) -> tuple[pa.Array, np.ndarray]:
    """All matches of ``PATTERN`` in all texts as one array of bytes, and how many each text has.

    The pattern covers every character, so only the places where words begin are looked for, for all texts at once: where
    the class changes; at the last blank before something else, which a space joins to what follows; and around
    contractions, which count where a word begins with their mark.
    """
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(points)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    kind = (classes or rank_file_classes()).of(points)
    fresh = np.zeros(n + 4, bool)  # where a text begins; the end counts as one
    fresh[0] = True
    fresh[ends[ends < n]] = True
    fresh[n:] = True
    begins = fresh.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~fresh[1:n]) + 1
    begins[after - 1] = True
    begins[after] = points[after - 1] != 0x20
    marks = np.flatnonzero((points == 0x27) & begins[:n])
    marks = marks[~fresh[marks + 1]]
    first = points[marks + 1]
    short = np.isin(first, [ord(c) for c in _ONE])
    has_two = ~fresh[marks + 2]
    second = np.where(has_two, points[np.minimum(marks + 2, n - 1)], 0)
    long = np.zeros(len(marks), bool)
    for a, b in _TWO:
        long |= (first == ord(a)) & (second == ord(b))
    for at, size in ((marks[short], 2), (marks[long], 3)):
        begins[at + 1] = False
        begins[at + size] = True
    starts = np.flatnonzero(begins[:n])
    raw = whole.encode()
    if len(raw) == n:
        offsets = np.append(starts, n)
    else:
        sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        upto = np.cumsum(sizes, dtype=np.int32 if len(raw) < 2**31 else np.int64)
        offsets = np.append((upto[starts] - sizes[starts]).astype(np.int64), len(raw))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return words, counts


class MergeReplay:
    """A vocabulary of byte strings and ranks, and the replay of its merges."""

    def __init__(self, path: str, most: int = REMEMBERED):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.most, self.known = most, {}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.span = max(self.tokens) + 1
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get, span = self.ranks.get, self.span
        pairs = {}
        for token, rank in self.ranks.items():  # any two neighbors that join to a token merge by that token's rank
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * span + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], _NEVER)

    def _alone(self, word: bytes) -> list[int]:
        """One word by itself, the lowest rank first and the leftmost of equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers.

        All words lie in one row of places. ``index`` leads from a pair (by the rank that both merge to) to the places
        where it stands. Ranks are taken in ascending order; a rank's places merge at once, the left one of two that
        overlap, and only the pairs with the left and right neighbors of a merged place are looked up anew and entered in
        the index. A merge whose new pair ranks below it would be due before its word's other places of the same rank:
        such words are done again by themselves.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        if not n:
            return [b"" for _ in words]
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, _NEVER)
        has = np.flatnonzero(after >= 0)
        rank[has] = self._rank(token[has], token[has + 1])
        there = np.ones(n, bool)
        odd: list[np.ndarray] = []
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks)) + 1
            for own, key in zip(np.split(places, edges), ranks[np.concatenate([[0], edges])].tolist()):
                if key in index:
                    index[key].append(own)
                else:
                    index[key] = [own]
                    heapq.heappush(due, key)

        first = np.flatnonzero(rank < _NEVER)
        if len(first):
            enter(first, rank[first])
        while due:
            now = heapq.heappop(due)
            lists = index.pop(now)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[rank[places] == now]
            if not len(places):
                continue
            right = after[places]
            if len(places) > 1:
                touching = right[:-1] == places[1:]
                if touching.any():  # in each chain of touching places every other one merges
                    heads = np.concatenate([[True], ~touching])
                    number = np.arange(len(places))
                    nth = number - np.maximum.accumulate(np.where(heads, number, 0))
                    places = places[nth % 2 == 0]
                    right = after[places]
            token[places] = now
            there[right] = False
            rank[right] = _NEVER
            beyond = after[right]
            after[places] = beyond
            behind = beyond >= 0
            before[beyond[behind]] = places[behind]
            left = before[places]
            left = left[left >= 0]
            touched = np.concatenate([places, left])
            follow = after[touched]
            fresh = np.where(follow >= 0, self._rank(token[touched], token[follow]), _NEVER)
            rank[touched] = fresh
            if fresh.min() <= now:
                odd.append(touched[fresh <= now])
            real = fresh < _NEVER
            if real.any():
                enter(touched[real], fresh[real])
        data = token[there].astype("<u4").tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], ends])]).tolist()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for at in {int(i) for places in odd for i in np.searchsorted(ends, places, side="right")}:
            out[at] = np.array(self._alone(words[at]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text as bytes, and how many they are."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > self.most:
            self.known.clear()
        data = list(map(self.known.get, names))
        new = [i for i, d in enumerate(data) if d is None]
        merge = []
        for i in new:
            rank = self.ranks.get(names[i])
            if rank is None:
                merge.append(i)
            else:
                data[i] = rank.to_bytes(4, "little")
        for i, own in zip(merge, self.replay([names[i] for i in merge])):
            data[i] = own
        for i in new:
            if len(names[i]) <= 64:  # longer words hardly come again
                self.known[names[i]] = data[i]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        flat = np.frombuffer(b"".join(data), "<u4")
        starts = np.cumsum(sizes) - sizes
        bounds = np.concatenate([[0], np.cumsum(counts)])
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        out, begin = [], 0
        while begin < len(texts):  # the ids of some texts at a time
            stop = max(begin + 1, int(np.searchsorted(ends[bounds], ends[bounds[begin]] + 2_000_000, side="right")) - 1)
            lo, hi = bounds[begin], bounds[stop]
            ids = flat[np.repeat(starts[which[lo:hi]] - ends[lo:hi], own[lo:hi]) + np.arange(ends[lo], ends[hi])].tobytes()
            edges = (4 * (ends[bounds[begin:stop + 1]] - ends[lo])).tolist()
            out += [ids[a:b] for a, b in zip(edges, edges[1:])]
            begin = stop
        return out, np.diff(ends[bounds])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def replayer(path: str, most: int = REMEMBERED) -> MergeReplay:
    """The worker's replay of a vocabulary file, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = MergeReplay(path)
    _LOADED[path].most = most
    return _LOADED[path]


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def encode_notes(events: DataFrame, ranks: str, *, key: str | Sequence[str] = ("match_id", "event_id"), text: str = "note",
                 run_chars: int = RUN_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """``key..., n_tokens, ids`` of each whole note: ids as little-endian unsigned 32-bit integers in one binary.

    ``ranks`` is a file of base64 byte strings and ranks that every worker can read. A note is split by ``PATTERN``; each
    match is encoded by itself, as an encoder without special tokens does. The distinct words of a run of about
    ``run_chars`` characters of notes that the worker does not remember are merged together, see ``MergeReplay.replay``.
    No shuffle: a lost executor's partitions are encoded again from the table.

    A null or empty note has no tokens. One row for each row of ``events``, repeated rows included; an empty table gives
    no rows. Key columns, of any number and type, null or not, go through as they are; other columns, whatever their
    names, are not read. A key may not be named ``n_tokens`` or ``ids``.
    """
    keys = _names(key)
    if {"n_tokens", "ids"} & set(keys):
        raise ValueError("a key column is named like a result")
    picked = events.select(*(F.col(f"`{k}`") for k in keys), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    schema = StructType([*(events.schema[k] for k in keys), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(ranks, remembered)
        for batch in batches:
            texts = batch.column(len(keys))
            sizes = np.fromiter((len(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(texts):
                held = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, held + run_chars, side="right")))
                ids, counts = coder.encode(texts.slice(begin, stop - begin).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, stop - begin) for c in batch.columns[:len(keys)]), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*keys, "n_tokens", "ids"])
                begin = stop
        give_back()

    return picked.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, ranks: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its ids stand for in a binary column ``into``.

    Null ids stay null, none give no bytes; an id that the vocabulary lacks raises. Other columns go through as they are;
    ``into`` may not be among them.
    """
    if into in tokens.columns:
        raise ValueError(f"there is a column {into} already")
    at = tokens.columns.index(ids)
    schema = StructType([*tokens.schema.fields, StructField(into, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(ranks)
        for batch in batches:
            out = pa.array([None if b is None else coder.decode(b) for b in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=schema.fieldNames())
        give_back()

    return tokens.mapInArrow(run, schema)
