"""Token ids of texts, and files of ids coded by an interleaved asymmetric numeral system.

The library's own records are the notes of reviewed events (``event_id, note``); any keyed text works.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_path
from .common import any_key, records, rows_of
from .merge_replay import Classes, split_words

# Texts are encoded piece by piece and pieces are remembered. A cut is safe where the vocabulary's own pre-tokenizer
# always cuts. With "words" that is at blanks and line ends, as white space is dropped there. With "bytes" pieces are the
# words of the byte-level pattern, found for all texts at once (``split_words``); a text that holds the name of a special
# token is encoded whole.
_STOPS = (".", ",")
#: how many pieces a worker remembers, and how many characters it encodes at a time: more costs memory (some 600 MB a
#: worker with these), less costs time; results are the same
REMEMBERED, RUN_CHARS = 900_000, 16_000_000
_LOADED: dict[tuple[str, str], "PieceEncoder"] = {}
# Most new pieces are Latin letters with some ASCII marks behind them, or none. Where the vocabulary's own steps do nothing
# to such letters but lower them and write their bytes (``_plain`` tries all pairs), the merges alone are run on them.
_LETTERS, _MARKS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that the byte-level alphabet writes for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTES = _byte_letters()


def _written(letters: str) -> str:
    """Letters in lower case, by their bytes in the byte-level alphabet."""
    return letters if letters.isascii() else letters.lower().encode().decode("latin-1").translate(_BYTES)


def _plain(tokenizer) -> bool:
    """Whether the tokenizer's steps before the merges keep every two letters of ``_LETTERS`` together, lowered and written by
    their bytes, and cut every letter from every mark of ``_MARKS``; and no added token is letters and then marks."""
    every = list(map(chr, range(256)))
    letters, marks = ([c for c in every if re.fullmatch(f"[{kind}]", c)] for kind in (_LETTERS, _MARKS))
    normal, pre = tokenizer.normalizer, tokenizer.pre_tokenizer

    def cut(text: str) -> list[str]:
        text = normal.normalize_str(text) if normal else text
        return [p for p, _ in pre.pre_tokenize_str(text)] if pre else [text]

    added = (t.content for t in tokenizer.get_added_tokens_decoder().values())
    return (not any(re.fullmatch(f"[{_LETTERS}]*[{_MARKS}]*", t) for t in added)
            and all(cut(a + b) == [_written(a + b)] for a in letters for b in letters)
            and all(cut(a + b) == [_written(a), b] for a in letters for b in marks))


class PieceEncoder:
    """Encodes whole texts with a tokenizer file; equal to encoding each text at once (tested).

    Texts are split and their pieces numbered by Arrow; only distinct pieces are looked up, and only new ones encoded. With
    "words" the letters and the marks of a new piece are encoded apart, letters by the merges alone (``_plain``); any other that ends in a Latin-1 letter or digit and one stop or comma is put together from both, as every
    pre-tokenizer here cuts between them (other letters may end in a mark when folded), and A-Z count as a-z, which the vocabulary does anyway.
    """

    def __init__(self, path: str, cuts: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.words = cuts == "words"
        if self.words:
            self.plain = _PLAIN.fullmatch if _plain(self.tokenizer) else lambda piece: None
        else:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.classes = Classes(lambda pair: len(split(pair)) == 1)
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn_plain(self, pieces: list[str]) -> list[str]:
        """Learns the pieces of letters and marks, and gives back the others."""
        known, plain, merge, other = self.known, self.plain, self.tokenizer.model.tokenize, []
        for piece in pieces:
            found = plain(piece)
            if found is None:
                other.append(piece)
                continue
            letters, marks = found.groups()
            data = known.get(letters)
            if data is None:
                data = known[letters] = array("I", [t.id for t in merge(_written(letters))]).tobytes()
            if marks:
                end = known.get(marks)
                if end is None:
                    end = known[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
                known[piece] = data + end
        return other

    def _learn(self, pieces: list) -> None:
        known = self.known
        if self.words:
            pieces = self._learn_plain(pieces)
            parts = [(p[:-1], p[-1]) if p[-1:] in _STOPS and p[-2:-1].isalnum() and p[-2] < "\u0100" else (p, "") for p in pieces]
            pieces = [p for p in {p for both in parts for p in both} if p not in known]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces if self.words else [p.decode() for p in pieces], add_special_tokens=False)]
        data, at = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0
        for piece, own in zip(pieces, ids):
            known[piece] = data[at:at + 4 * len(own)]
            at += 4 * len(own)
        if self.words:
            for head, tail in parts:
                if tail:
                    known[head + tail] = known[head] + known[tail]

    def _look_up(self, pieces: list) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        data = list(map(self.known.get, pieces))
        missing = [i for i, d in enumerate(data) if d is None]
        self._learn([pieces[i] for i in missing])
        for i in missing:
            data[i] = self.known[pieces[i]]
        return data

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        on = gc.isenabled()
        gc.disable()  # many short lists come and go here, none in a cycle; scans for cycles would cost a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str], gather: int = 2_000_000) -> list[np.ndarray]:
        whole: dict[int, np.ndarray] = {}
        if self.words:
            column = pc.replace_substring(pc.ascii_lower(pa.array(texts, pa.large_string())), "\n", " ")
            split = pc.split_pattern(column, " ")
            bounds = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            del column, split
        else:
            named = [i for i, t in enumerate(texts) if any(name in t for name in self.special)]
            found = self.tokenizer.encode_batch_fast([texts[i] for i in named], add_special_tokens=False)
            whole = {i: np.array(e.ids, "<u4") for i, e in zip(named, found)}
            words, counts = split_words(texts, self.classes)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            coded = words.dictionary_encode()
            del words
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        del coded
        data = self._look_up(pieces)
        sizes = np.fromiter(map(len, data), np.int32, len(data)) // 4
        flat = np.frombuffer(b"".join(data), "<u4")
        starts = np.cumsum(sizes, dtype=np.int32) - sizes  # fewer ids than bytes, and Arrow's texts have fewer than 2**31
        ends = np.concatenate([[0], np.cumsum(sizes[which], dtype=np.int64)])
        out, begin = [], 0
        while begin < len(texts):  # some texts' ids at a time
            stop = max(begin + 1, int(np.searchsorted(ends[bounds], ends[bounds[begin]] + gather, side="right")) - 1)
            lo, hi = bounds[begin], bounds[stop]
            own, count = which[lo:hi], sizes[which[lo:hi]]
            place = np.repeat(starts[own] - (ends[lo:hi] - ends[lo]).astype(np.int32), count)
            place += np.arange(len(place), dtype=np.int32)
            ids = flat.take(place, mode="clip")
            edges = (ends[bounds[begin:stop + 1]] - ends[lo]).tolist()
            out += [whole[begin + i] if begin + i in whole else ids[a:b] for i, (a, b) in enumerate(pairwise(edges))]
            begin = stop
        return out


def encoder(path: str, cuts: str, most: int = REMEMBERED) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, cuts) not in _LOADED:
        _LOADED[path, cuts] = PieceEncoder(path, cuts)
    _LOADED[path, cuts].most = most
    return _LOADED[path, cuts]


# ---- coding: 64-bit states, 32-bit words, LANES states of a block advance together ---------------------------------

SCALE_BITS, LOW, LANES, BLOCK = 20, np.uint64(1 << 31), 256, 131_072
_MAGIC = b"TLR1"
_U = np.uint64


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and their whole frequencies, at least 1 each, that add up to 2**SCALE_BITS."""
    every = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    scale = 1 << SCALE_BITS
    freqs = np.maximum(1, counts * (scale - len(symbols)) // max(1, counts.sum())).astype(np.int64)
    if len(symbols):
        freqs[np.argmax(counts)] += scale - freqs.sum()
    return symbols.astype("<u4"), freqs.astype("<u4")


def _code(ranks: np.ndarray, freqs: np.ndarray, starts: np.ndarray):
    """``ranks`` (blocks, steps, lanes) -> final states and each block's words in the order that decoding reads them."""
    blocks, steps, lanes = ranks.shape
    state = np.full((blocks, lanes), LOW)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    sent = np.zeros((steps, blocks, lanes), bool)
    shift = _U(63 - SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        rank = ranks[:, step]
        freq = freqs[rank]
        full = (state >> shift) >= freq
        words[step] = state.astype(np.uint32)
        sent[step] = full
        state = np.where(full, state >> _U(32), state)
        high = state // freq
        state = (high << _U(SCALE_BITS)) + (state - high * freq) + starts[rank]
    return state, [words[:, b][sent[:, b]] for b in range(blocks)]


def _decode(state: np.ndarray, words: list[np.ndarray], steps: int, slots: np.ndarray, freqs: np.ndarray,
            starts: np.ndarray) -> np.ndarray:
    blocks, lanes = state.shape
    stream = np.concatenate([*words, np.zeros(1, np.uint32)])
    at = np.cumsum([0, *map(len, words[:-1])])[:, None]
    last = len(stream) - 1
    out = np.empty((blocks, steps, lanes), np.uint32)
    mask = _U((1 << SCALE_BITS) - 1)
    for step in range(steps):
        slot = state & mask
        rank = slots[slot]
        out[:, step] = rank
        state = freqs[rank] * (state >> _U(SCALE_BITS)) + slot - starts[rank]
        low = state < LOW
        taken = np.cumsum(low, axis=1)
        state = np.where(low, (state << _U(32)) | stream[np.minimum(at + taken - 1, last)], state)
        at = at + taken[:, -1:]
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment: the shared frequency table, then independent blocks, each with its checkpoint (ids before it, final
    states) and the checksum of its ids. A segment without ids has an empty table and no block."""
    symbols, freqs = frequency_table(ids)
    wide = freqs.astype(np.uint64)
    starts = np.cumsum(wide) - wide
    rank_of = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int32)
    rank_of[symbols] = np.arange(len(symbols))
    ranks = rank_of[ids]
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freqs.tobytes(), 1)
    whole = len(ids) // BLOCK
    parts = []
    for first, count in ((0, whole), (whole * BLOCK, int(whole * BLOCK < len(ids)))):
        if not count:
            continue
        own = ranks[first:first + count * BLOCK]
        pad = -len(own) % (count * LANES)
        own = np.concatenate([own, np.full(pad, own[-1])]) if pad else own
        states, words = _code(own.reshape(count, -1, LANES), wide, starts)
        for b in range(count):
            block = ids[first + b * BLOCK:first + (b + 1) * BLOCK]
            head = struct.pack("<QIII", first + b * BLOCK, len(block), len(words[b]), zlib.crc32(block.astype("<u4").tobytes()))
            parts.append(head + states[b].astype("<u8").tobytes() + words[b].astype("<u4").tobytes())
    return b"".join([_MAGIC, struct.pack("<QIII", len(ids), len(symbols), len(table), len(parts)), table, *parts])


def decode_segment(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a segment from place ``start`` to ``stop``, all unless given. Only blocks that hold some of them are decoded: a
    block's checkpoint says where it begins and from which states. Raises ``ValueError`` where one of their checksums or the
    layout is wrong.
    """
    if data[:4] != _MAGIC:
        raise ValueError("not a token segment")
    total, count, packed, blocks = struct.unpack_from("<QIII", data, 4)
    start = min(max(0, start), total)
    stop = total if stop is None else max(start, min(stop, total))
    at = 24 + packed
    table = np.frombuffer(zlib.decompress(data[24:at]), "<u4")
    symbols, freqs = np.cumsum(table[:count], dtype=np.uint32), table[count:].astype(np.uint64)
    starts = np.cumsum(freqs) - freqs
    slots = np.repeat(np.arange(count, dtype=np.uint32), freqs.astype(np.int64))
    groups: dict[int, list] = {}
    for _ in range(blocks):
        first, length, words, check = struct.unpack_from("<QIII", data, at)
        at += 20
        if first < stop and first + length > start:
            states = np.frombuffer(data, "<u8", LANES, at)
            groups.setdefault(-(-length // LANES), []).append((first, length, check, states, np.frombuffer(data, "<u4", words, at + 8 * LANES)))
        at += 8 * LANES + 4 * words
    out = np.empty(stop - start, np.uint32)
    for steps, members in groups.items():  # blocks of one length advance together
        ranks = _decode(np.stack([m[3] for m in members]), [m[4] for m in members], steps, slots, freqs, starts)
        for (first, length, check, *_), own in zip(members, ranks):
            ids = symbols[own.ravel()[:length]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError(f"checksum of the block at id {first} differs")
            lo, hi = max(first, start), min(first + length, stop)
            out[lo - start:hi - start] = ids[lo - first:hi - first]
    return out


# ---- files -----------------------------------------------------------------------------------------------------------

_FILE = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("keys", pa.list_(pa.int64())),
                   ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
_FILE_DDL = "part int, start bigint, keys array<bigint>, lengths array<bigint>, n_ids bigint, payload binary"


def write_token_files(events: DataFrame, path: str, vocabulary: str, *, key: str = "event_id", text: str = "note",
                      cuts: str = "words", end_id: int = 1, segment_ids: int = 2_000_000) -> None:
    """Encode every whole note and write the ids in ascending order of key to ``path``.

    One range shuffle puts the notes in order. Each partition then writes segments of about ``segment_ids`` ids (a note
    is never cut): a row with the keys, their id counts, the ids before it in its partition, and the coded payload of
    ``encode_segment``. The commit of Spark's own writer makes a lost executor's part files harmless.

    A null or empty note is its end id alone; equal keys are ordered by note, a null key comes first; an empty table
    writes no segment; other columns are not read. ``vocabulary`` is a tokenizer file that every worker can read.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary, cuts), TaskContext.get().partitionId()
        keys: list = []
        ids: list[np.ndarray] = []
        start = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, start, held
            row = {"part": [part], "start": [start], "keys": [keys], "lengths": [[len(x) for x in ids]], "n_ids": [held],
                   "payload": [encode_segment(np.concatenate(ids))]}
            start, keys, ids, held = start + held, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_FILE)

        for some, notes in rows_of(batches, 8000, RUN_CHARS):
            for name, own in zip(some, coder.encode(notes)):
                keys.append(name)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= segment_ids:
                    yield flush()
        if keys:
            yield flush()

    spark = events.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = records(events, key, text).repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(run, _FILE_DDL).write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, key: str = "event_id") -> DataFrame:
    """Decode the files at ``path``: ``key, start, n_tokens, ids_crc32`` for each note, in no order.

    ``start`` is the number of ids of all notes before it. Only one row per partition file takes part in the running
    sum. Every block's checksum is compared; a damaged block raises.
    """
    files = spark.read.parquet(path)
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, keys, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = decode_segment(payload).astype("<u4")
                ends = np.cumsum(lengths)
                checks = [zlib.crc32(ids[e - n:e].tobytes()) for n, e in zip(lengths, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                    pa.array(start + ends - np.array(lengths), pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(checks, pa.int64())], names=["part", "key", "own", "n_tokens", "ids_crc32"])

    rows = files.select("part", "start", "keys", "lengths", "payload").mapInArrow(
        run, "part int, key bigint, own bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(before, "part").select(F.col("key").alias(key), (F.col("base") + F.col("own")).alias("start"),
                                            "n_tokens", "ids_crc32")


@any_key()
def token_files(events: DataFrame, vocabulary: str, *, key: str = "event_id", text: str = "note", **options) -> DataFrame:
    """Write the notes' ids to a new place in the shared folder and read them back."""
    path = shared_path(events.sparkSession, "tokens")
    write_token_files(events, path, vocabulary, key=key, text=text, **options)
    return read_token_files(events.sparkSession, path, key=key)
