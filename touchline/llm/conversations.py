"""Faults of conversations and their cheapest repair.

The match records hold no conversations (an event log has no roles that take turns), so these operators are general: they
work on rows of ``conv_id, turn, role, text``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut
from .common import give_back

# What may be done to a row: D delete 3, I insert a row before it 2, K keep 0, R give it the role user or assistant 2; a
# truncated row that stays costs 1. Left over is nothing, or pairs of user and assistant, with or without a system row
# ahead. So there are four states: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NO = 1 << 60
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # after an inserted row or one of new role
_TAIL = ((0, ""), (4, "II"), (2, "I"), (0, ""))  # what ends a conversation from each state
# a row's class: twice its role's number (0 system, 1 user, 2 assistant, 3 any other), plus 1 if truncated; or to go
GONE = 8


def _words(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest, then least, letters that take one row from a state to a state. Rows are inserted before one that stays;
    before a deleted one they would come later just as cheaply and in a lesser order."""
    best: dict[tuple[int, int], tuple[int, str]] = {(q, q): (3, "D") for q in range(4)}
    if kind == GONE:
        return best
    role, extra = divmod(kind, 2)
    for q in range(4):
        at, cost, word = q, 0, ""
        for _ in range(4):
            ways = [(_NEXT[at], 2, "R")]
            if role == 0 and at == _START:
                ways.append((_SYSTEM, 0, "K"))
            elif role == 1 and at != _USER or role == 2 and at == _USER:
                ways.append((_NEXT[at], 0, "K"))
            for to, price, letter in ways:
                best[q, to] = min(best.get((q, to), (_NO, "")), (cost + price + extra, word + letter))
            at, cost, word = _NEXT[at], cost + 2, word + "I"
    return best


_WORDS = [_words(kind) for kind in range(GONE + 1)]
# A vector is what leads to the four states: costs less the least of them, and the order of the letters so far. Few
# different ones come up, so steps are remembered.


@lru_cache(maxsize=100_000)
def _forward(vector: tuple, kind: int) -> tuple[tuple, int]:
    costs, order = vector
    found = []
    for to in range(4):
        ways = [(costs[q] + _WORDS[kind][q, to][0], order[q], _WORDS[kind][q, to][1]) for q in range(4)
                if costs[q] < _NO and (q, to) in _WORDS[kind]]
        found.append(min(ways) if ways else (_NO, 0, ""))
    least = min(f[0] for f in found)
    # letters that lead to different states differ before either ends, so their order goes on
    ranks = {f: i for i, f in enumerate(sorted({f[1:] for f in found if f[0] < _NO}))}
    return (tuple(f[0] - least if f[0] < _NO else _NO for f in found), tuple(ranks.get(f[1:], 0) if f[0] < _NO else 0 for f in found)), least


@lru_cache(maxsize=100_000)
def _backward(costs: tuple, kind: int) -> tuple[tuple, int]:
    found = [min((w[0] + costs[to] for (own, to), w in _WORDS[kind].items() if own == q and costs[to] < _NO), default=_NO) for q in range(4)]
    least = min(found)
    return tuple(c - least if c < _NO else _NO for c in found), least


def _from(state: int) -> tuple:
    return tuple(0 if q == state else _NO for q in range(4)), (0, 0, 0, 0)


def forward(kinds: bytes, lo: int, hi: int, state: int) -> tuple[tuple, int]:
    """The vector behind rows ``lo`` to ``hi`` when they begin in ``state``, and the cost that it was lessened by."""
    vector, total = _from(state), 0
    for kind in kinds[lo:hi]:
        if kind == GONE:  # changes no state
            total += 3
        else:
            vector, more = _forward(vector, kind)
            total += more
    return vector, total


def backward(kinds: bytes, lo: int, hi: int, costs: tuple) -> tuple[tuple, int]:
    total = 0
    for kind in reversed(kinds[lo:hi]):
        if kind == GONE:
            total += 3
        else:
            costs, more = _backward(costs, kind)
            total += more
    return costs, total


def crossing(vector: tuple, costs: tuple) -> int:
    """Of the states through which the way is cheapest the one with the least letters before it."""
    return min((vector[0][q] + costs[q], vector[1][q], q) for q in range(4) if vector[0][q] < _NO and costs[q] < _NO)[2]


def letters(kinds: bytes, lo: int, hi: int, begin: int, end: int, out: list[str], states: list[int]) -> None:
    """Each row's letters on the cheapest way, of least letters in all, from ``begin`` to ``end``, and the state before it.

    Forward and backward vectors of four states meet in the middle; the way crosses there in one state, and both halves
    are done in the same manner. What is held is a few vectors for each level of halves.
    """
    while hi - lo > 1:
        mid = (lo + hi) // 2
        state = crossing(forward(kinds, lo, mid, begin)[0], backward(kinds, mid, hi, _from(end)[0])[0])
        letters(kinds, lo, mid, begin, state, out, states)
        lo, begin = mid, state
    if hi > lo:
        out[lo], states[lo] = _WORDS[kinds[lo]][begin, end][1], begin


def last_state(kinds: bytes, begin: int = _START) -> int:
    vector, _ = forward(kinds, 0, len(kinds), begin)
    return crossing(vector, tuple(t[0] for t in _TAIL))


@lru_cache(maxsize=50_000)
def _short(kinds: bytes) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    return _solve(kinds)


def _solve(kinds: bytes, begin: int = _START, end: int | None = None):
    end = last_state(kinds, begin) if end is None else end
    out, states = [""] * len(kinds), [0] * len(kinds)
    letters(kinds, 0, len(kinds), begin, end, out, states)
    return tuple(out), tuple(states), end


def solve(kinds: bytes, begin: int = _START, end: int | None = None) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    """Each row's letters, the state before each row, and the state at the end (the best one unless given)."""
    return _short(kinds) if len(kinds) <= 40 and begin == _START and end is None else _solve(kinds, begin, end)


_PRICE = {"D": 3, "I": 2, "K": 0, "R": 2}


# ---- conversations as rows -------------------------------------------------------------------------------------------

_SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. A null is one
    space in the checked name, as a role and as a text; null conversations and turns stay null."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
                                (F.crc32(F.concat(blank(key), F.lit(":"), blank(turn))) % 20).alias("_h")).where("_h <> 0")
    text_ = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"),
                       F.explode(F.expr("array_repeat(0, if(_h = 3, 2, 1))")).alias("_copy"))
    return rows.drop("_copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _lines(rows: DataFrame) -> DataFrame:
    """Distinct rows by conversation and turn without their texts: ``conv_id, turn, role, digest, init, blank, cut, copies``.
    Rows are counted before they are shuffled, so a row repeated very often is one. ``init`` numbers the role's initial."""
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    first = F.substring("role", 1, 1)
    init = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", _digest().alias("digest"), init.alias("init"), (tail == "").alias("blank"),
                       (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut")).groupBy(
        "conv_id", "turn", "role", "digest", "init", "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))


def _judged(lines: DataFrame) -> DataFrame:
    """``lines`` with ``again``: role and text seen in an earlier turn of the conversation. The first turn is an aggregate
    (its least, nulls first), joined back."""
    same = lambda: F.struct("conv_id", "role", "digest").alias("_same")  # noqa: E731  (structs with nulls compare equal)
    nth = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = lines.groupBy(same()).agg(F.min(nth).alias("_first"))
    return lines.select("*", same()).join(first, "_same").withColumn("again", nth > F.col("_first")).drop("_same", "_first")


def _differ(column: pa.Array) -> np.ndarray:
    """Whether each row of a column differs from the one before; the first one does not count."""
    a, b = column[1:], column[:-1]
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole conversations of a sorted partition: tables and where conversations begin in them. A conversation that goes on
    is held as it came until its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        goes_on = held and not _differ(pa.concat_arrays([held[-1].column(0)[-1:], batch.column(0)[:1]])).any()
        starts = np.concatenate([[] if goes_on else [0], np.flatnonzero(_differ(batch.column(0))) + 1]).astype(np.int64)
        if not len(starts):
            held.append(batch)
            continue
        if held and starts[0] == 0:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, np.array([0, table.num_rows])
            held = []
        cut_at = int(starts[-1])
        if cut_at:
            table = pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks()
            more = sum(b.num_rows for b in held)
            yield table, np.concatenate([[0] if held else [], starts + more]).astype(np.int64)
            held = []
        held.append(batch.slice(cut_at))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, place, at, to, cost, nth, head, last``: what a partition's first and last conversation lead to from each state,
    as others may hold the rest of them: from state ``at`` to state ``to`` the cost, and which of its letters come first."""
    first = last = None
    for table, starts in _conversations(batches):
        for lo, hi in ((starts[0], starts[1]), (starts[-2], starts[-1])):
            own = table.slice(int(lo), int(hi - lo))
            if first is None:
                first = last = own
            elif (lo, hi) == (starts[-2], starts[-1]):
                last = own
    rows = []
    for place, own in enumerate([] if first is None else [first] if first is last else [first, last]):
        kinds, copies = _kinds(own)
        init = own.column("init").combine_chunks().to_numpy()
        for at in range(4):
            (costs, order), total = forward(kinds, 0, len(kinds), at)
            rows += [(own.column("block")[0].as_py(), place, at, to, costs[to] + total if costs[to] < _NO else None, order[to],
                      int(init[0]), int(init[-1])) for to in range(4)]
    keys = [x for own in ([] if first is None else [first] if first is last else [first, last]) for x in [own.column("conv_id")[0].as_py()] * 16]
    kinds_of = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) if rows else [()] * 8
    kind = pa.null() if first is None else first.column("conv_id").type
    yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(list(c), t) for c, t in zip(columns, kinds_of))],
                                     names=["conv_id", "block", "place", "at", "to", "cost", "nth", "head", "last"])
    give_back()


def _kinds(own: pa.Table) -> tuple[bytes, np.ndarray]:
    """The classes of a conversation's rows in a partition, copies written out: all copies but a row's first go."""
    kind, copies = (own.column(c).combine_chunks().to_numpy() for c in ("kind", "copies"))
    if int(copies.max(initial=1)) == 1:
        return kind.astype(np.uint8).tobytes(), copies
    out = np.full(int(copies.sum()), GONE, np.uint8)
    out[np.cumsum(copies) - copies] = kind
    return out.tobytes(), copies


def _meet(found: list) -> dict[tuple[int, int], tuple[int, int, int, bool]]:
    """``(block, place) -> begin, end, initial before, whether the conversation ends there``, for conversations in several
    partitions. ``found`` are the rows of ``_ends``: 32 for each partition at most, whatever the rows behind them.

    The blocks of a conversation are crossed like rows: vectors forward, then states from its end backward.
    """
    parts: dict[tuple[int, int], dict] = {}
    for r in found:
        own = parts.setdefault((r["block"], r["place"]), {"conv": r["conv_id"], "head": r["head"], "last": r["last"], "to": {}})
        if r["cost"] is not None:
            own["to"][r["at"], r["to"]] = (r["cost"], r["nth"])
    chains: list[list[tuple[int, int]]] = []
    for place in sorted(parts):
        before = chains[-1][-1] if chains else None
        if before is not None and before[0] != place[0] and parts[before]["conv"] == parts[place]["conv"]:
            chains[-1].append(place)
        else:
            chains.append([place])
    out = {}
    for chain in (c for c in chains if len(c) > 1):
        costs, order, back = [0, _NO, _NO, _NO], [0, 0, 0, 0], []
        for place in chain:
            to_ = parts[place]["to"]
            best = [min(((costs[q] + to_[q, to][0], order[q], to_[q, to][1], q) for q in range(4) if costs[q] < _NO and (q, to) in to_),
                        default=(_NO, 0, 0, 0)) for to in range(4)]
            ranks = {b: i for i, b in enumerate(sorted({b[1:3] for b in best if b[0] < _NO}))}
            back.append([b[3] for b in best])
            costs, order = [b[0] for b in best], [ranks.get(b[1:3], 0) for b in best]
        end = crossing((costs, order), tuple(t[0] for t in _TAIL))
        for i in range(len(chain) - 1, -1, -1):
            begin = back[i][end]
            before = parts[chain[i - 1]]["last"] if i else -1
            out[chain[i]] = (begin, end, before, i == len(chain) - 1)
            end = begin
    return out


def _repairs(meet: dict):
    """For each row its letters and the state before it; for each conversation in a partition one more row (``at`` -1) with all its letters, what
    they cost, and how many adjacent rows have roles that do not follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting = 0, None

        def told(table: pa.Table, starts: np.ndarray, ends: list) -> pa.RecordBatch:
            nonlocal seen
            init, kind, copies = (table.column(c).combine_chunks().to_numpy() for c in ("init", "kind", "copies"))
            follows = np.zeros((4, 4), bool)
            follows[0, 1] = follows[1, 2] = follows[2, 1] = True
            wrong = np.concatenate([[0], np.cumsum(~follows[init[:-1], init[1:]])]) if len(init) else np.zeros(1, int)
            extra = np.concatenate([[0], np.cumsum(copies - 1)])  # a copy next to its like never follows
            words: list[str] = []
            states: list[int] = []
            audits, costs, illegal, tails, final = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                own = table.slice(lo, hi - lo)
                kinds, often = _kinds(own)
                begin, end, before, last = ends[i] or (_START, None, -1, True)
                out, at, end = solve(kinds, begin, end)
                tail = _TAIL[end][1] if last else ""
                audit = "".join(out) + tail
                stays = sum(k % 2 for k, w in zip(kinds, out) if k != GONE and w != "D")
                audits.append(audit)
                costs.append(sum(_PRICE[c] * audit.count(c) for c in _PRICE) + stays)
                illegal.append(int(wrong[hi - 1] - wrong[lo] + extra[hi] - extra[lo]) + (before >= 0 and not follows[before, init[lo]]))
                firsts = range(len(out)) if len(out) == hi - lo else (np.cumsum(often) - often).tolist()
                words += [out[j] for j in firsts]
                states += [at[j] for j in firsts]
                tails.append(tail)
                final.append(end)
            n, m = table.num_rows, len(audits)
            heads = pa.array(starts[:-1])
            column = lambda name: table.column(name).combine_chunks()
            both = lambda a, b: pa.concat_arrays([a, b])
            batch = pa.RecordBatch.from_arrays([
                both(column("conv_id"), column("conv_id").take(heads)), both(column("turn"), pa.nulls(m, table.column("turn").type)),
                both(column("role"), pa.nulls(m, table.column("role").type)), both(column("digest"), pa.nulls(m, table.column("digest").type)),
                both(column("block"), column("block").take(heads)),
                both(pa.array(np.arange(seen, seen + n)), pa.array(np.full(m, -1))),
                both(pa.array(words, pa.string()), pa.array(tails, pa.string())), both(pa.array(states, pa.int32()), pa.array(final, pa.int32())),
                both(pa.nulls(n, pa.string()), pa.array(audits, pa.string())), both(pa.nulls(n, pa.int64()), pa.array(costs, pa.int64())),
                both(pa.nulls(n, pa.int64()), pa.array(illegal, pa.int64()))],
                names=["conv_id", "turn", "role", "digest", "block", "at", "word", "state", "audit", "cost", "illegal"])
            seen += n
            return batch

        first = True
        for table, starts in _conversations(batches):
            if waiting is not None:
                yield told(*waiting)
            ends = [None] * (len(starts) - 1)
            if first:
                ends[0] = meet.get((table.column("block")[0].as_py(), 0))
                first = False
            waiting = (table, starts, ends)
        if waiting is not None:
            table, _, ends = waiting
            ends[-1] = ends[-1] or meet.get((table.column("block")[0].as_py(), 1))
            yield told(*waiting)
        give_back()

    return run


def repair_conversations(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its rows after the cheapest repair.

    The first table has a row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``. A row's first fault counts: blank (no character but white space x20, x09-x0D), duplicate (role and text
    stood in the conversation before), truncated (its last character but white space is no stop, exclamation or question
    mark). ``gaps`` is how many turns are missing between the least and the greatest one, ``illegal`` how many adjacent
    rows have roles whose initials are not system-user, user-assistant or assistant-user. ``audit`` has the initials of
    the cheapest edits in order and of these the least in ASCII; ``cost`` is theirs. A row may be kept (0), given the role user or
    assistant (2) or deleted (3; blank and duplicate ones are); empty rows may be inserted (2 each); a truncated row that
    stays costs 1. What is left is nothing, or a system row or none and then pairs of user and assistant.

    The second table has the rows after that: ``conv_id, block, at, nth, role, text``, in the order of ``block, at, nth``.

    A conversation's rows stand by turn (nulls first), those of one turn by role and SHA-256 of their text. Rows are ranged by conversation and
    all of that, so that one with most of all rows lies in many partitions. There, forward and backward vectors of four states
    meet mid-conversation (``letters``); for the first and last conversation of each partition one pass tells what its
    rows lead to from each state, which is all that the driver sees (32 rows a partition) and joins up. What is held of a
    conversation in a task is some bytes a row, never texts.

    Null roles and texts are one space; a null conversation is one of its own; repeated rows are duplicates; other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = rows.select(F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    lines = _judged(_lines(rows))
    kind = F.when(F.col("blank") | F.col("again"), GONE).otherwise(2 * F.col("init") + F.col("cut").cast("int"))
    lines = lines.withColumn("kind", kind)
    order = ("conv_id", "turn", "role", "digest")
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    lines = cut(lines.select(*order, "init", "blank", "cut", "again", "kind", "copies", "block"))

    conv = rows.schema["conv_id"]
    number = [StructField(n, LongType()) for n in ("cost", "illegal")]
    sent = lines.select(*order, "init", "kind", "copies", "block")
    found = sent.mapInArrow(_ends, StructType([conv, *(StructField(n, t) for n, t in zip(
        ("block", "place", "at", "to", "cost", "nth", "head", "last"), map(_type, "iiiiliii")))])).collect()
    told = StructType([conv, rows.schema["turn"], StructField("role", StringType()), lines.schema["digest"], StructField("block", _type("i")),
                       StructField("at", LongType()), StructField("word", StringType()), StructField("state", _type("i")),
                       StructField("audit", StringType()), *number])
    edits = cut(sent.mapInArrow(_repairs(_meet(found)), told))

    faults = lines.groupBy("conv_id").agg(
        F.expr("coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)").cast("bigint").alias("gaps"),
        F.expr("sum(if(blank, copies, 0))").cast("bigint").alias("blank"),
        F.expr("sum(if(blank, 0, if(again, copies, copies - 1)))").cast("bigint").alias("duplicate"),
        F.expr("sum(if(kind < 8 and cut, 1, 0))").cast("bigint").alias("truncated"))
    audits = edits.where("at = -1").groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("_parts"))
    audits = audits.withColumn("audit", F.array_join(F.transform("_parts", lambda p: p["audit"]), "")).drop("_parts")
    faults = faults.select(F.struct("conv_id").alias("_c"), *faults.columns[1:]).join(
        audits.select(F.struct("conv_id").alias("_c"), "illegal", "cost", "audit"), "_c")
    faults = faults.select("_c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    same = lambda df: F.struct("conv_id", "turn", "role", "digest").alias("_same")
    texts = rows.select(F.struct("conv_id", "turn", "role", _digest().alias("digest")).alias("_same"), "text").groupBy("_same").agg(F.first("text").alias("text"))
    stay = edits.where("at >= 0 and word <> 'D'").select(same(edits), "block", "at", "word", "state").join(texts, "_same").select(
        "_same.conv_id", "block", "at", "word", "state", F.col("_same.role").alias("role"), "text")
    tails = edits.where("at = -1 and word <> ''").select("conv_id", "block", F.lit(2**62).alias("at"), "word", "state",
                                                         F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    out = stay.unionByName(tails).select("*", F.posexplode(F.split("word", "")).alias("nth", "letter"))
    user = (F.col("nth") % 2 == 0) != (F.col("state") == _USER)
    out = out.select("conv_id", "block", "at", "nth", F.when(F.col("letter") == "K", F.col("role")).when(user, "user").otherwise("assistant").alias("role"),
                     F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"))
    return faults, out


def _type(letter: str):
    from pyspark.sql.types import IntegerType
    return IntegerType() if letter == "i" else LongType()


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, sha256``: SHA-256 of a conversation's rows as ``role:text``, joined by line ends. A checksum of all bytes in order is one
    after the other by its nature: a conversation's sorted rows pass through one task, which holds the checksum's state
    and no more than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, name, kind = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            starts = [0, *(np.flatnonzero(_differ(batch.column(0))) + 1).tolist(), batch.num_rows]
            goes_on = name is not None and not _differ(pa.concat_arrays([name, batch.column(0)[:1]])).any()
            done_names, done = [], []
            lines = batch.column(1).to_pylist()
            for i, (lo, hi) in enumerate(zip(starts, starts[1:])):
                if i or not goes_on:
                    if state is not None:
                        done_names.append(name)
                        done.append(state.hexdigest())
                    state, name = hashlib.sha256(), batch.column(0)[lo:lo + 1]
                    state.update("\n".join(lines[lo:hi]).encode())
                else:
                    state.update(("\n" + "\n".join(lines[lo:hi])).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(done_names), pa.array(done, pa.string())], names=["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([name, pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at", "nth")
    return ordered.select("conv_id", F.concat_ws(":", "role", "text")).mapInArrow(
        run, StructType([repaired.schema["conv_id"], StructField("sha256", StringType())]))
