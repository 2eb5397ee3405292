"""Secrets in notes by a trigram index, with built-in functions only: index, intersect, verify."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import records
from .spans import INNER, matches, pieces

#: kind: the pattern that finds (Java and Python syntax alike), how a match is shown to the check, and the check
RULES: dict[str, tuple] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?)([A-Za-z0-9+/_.=-]+)""", f"$1{INNER}$2",
               lambda m: F.length(F.element_at(F.split(m, INNER), 2)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", "$0", lambda m: F.length(m) >= 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", "$0", None),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "$0", None),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36}", "$0", None),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "$0", None),
}


def trigram_query(pattern: str, most: int = 16) -> list[frozenset[str]]:
    """A Boolean query that every text with a match of ``pattern`` fulfils: one of the sets, all its trigrams (in lower
    case). Runs of literals, options and alternatives are followed as sets of possible strings; whatever else a pattern
    has ends a run. A pattern without a mandatory trigram gives an empty list: its rule has to scan every text.
    """
    from re import _constants as op
    from re import _parser as parser
    queries: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if strings and frozenset() not in sets:
            queries.append(sorted(sets, key=sorted))

    def strings_of(items) -> set[str] | None:
        """All strings an expression stands for, or nothing if they are many or unbounded."""
        found = {""}
        for kind, value in items:
            if kind is op.LITERAL:
                own = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                own = {chr(v).lower() for _, v in value}
            elif kind is op.SUBPATTERN:
                own = strings_of(value[-1])
            elif kind is op.BRANCH:
                parts = [strings_of(x) for x in value[1]]
                own = None if None in parts else set().union(*parts)
            elif kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 2:
                once = strings_of(value[2])
                own = None if once is None else {"".join(c) for n in range(value[0], value[1] + 1) for c in product(once, repeat=n)}
            else:
                own = None
            if own is None or len(own) * len(found) > most:
                return None
            found = {a + b for a in found for b in own}
        return found

    def walk(items) -> None:
        run = {""}
        for item in items:
            own = strings_of([item])
            if own is not None and len(own) * len(run) <= most:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = own or {""}
            if own is None and item[0] is op.SUBPATTERN:
                walk(item[1][-1])
        close(run)

    walk(parser.parse(pattern))
    alternatives = [frozenset().union(*choice) for choice in product(*queries)] if queries else []
    return sorted(set(alternatives), key=sorted)


def trigram_postings(events: DataFrame, trigrams: list[str], *, key: str = "event_id", text: str = "note") -> DataFrame:
    """The index ``trigram, key`` of the given trigrams over whole notes, in lower case. Null notes hold none."""
    there = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return records(events, key, text).select("key", F.lower("text").alias("low")).select(
        F.explode(there).alias("trigram"), F.col("key").alias(key))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str], *, key: str = "event_id") -> DataFrame:
    """``key, rules``: for which rules the postings of a key fulfil a query. The postings of all rules are intersected
    at once, as bits of one row for each key: a task first unites those it has itself."""
    words = range(-(-len(trigrams) // 60))
    bit = lambda w: F.create_map(*(F.lit(x) for i, t in enumerate(trigrams) if i // 60 == w for x in (t, 1 << (i % 60))))
    bits = postings.select(key, *(F.coalesce(bit(w)[F.col("trigram")].cast("bigint"), F.lit(0).cast("bigint")).alias(f"_b{w}") for w in words))
    masks = bits.groupBy(key).agg(*(F.bit_or(f"_b{w}").alias(f"_b{w}") for w in words))

    def holds(trigram_set: frozenset[str]) -> Column:
        need = [sum(1 << (i % 60) for i, t in enumerate(trigrams) if t in trigram_set and i // 60 == w) for w in words]
        out = F.lit(True)
        for w, mask in zip(words, need):
            out = out & (F.col(f"_b{w}").bitwiseAND(F.lit(mask)) == mask)
        return out

    def any_of(sets: list[frozenset[str]]) -> Column:
        out = F.lit(False)
        for s in sets:
            out = out | holds(s)
        return out

    rules = F.filter(F.array(*(F.when(any_of(sets), F.lit(rule)) for rule, sets in queries.items())), lambda r: r.isNotNull())
    return masks.select(key, rules.alias("rules")).where(F.size("rules") > 0)


def find_secrets(events: DataFrame, *, key: str = "event_id", text: str = "note") -> DataFrame:
    """``key, spans``: secrets in each whole note by start, then by kind in the order of ``RULES``.

    A span has ``kind, start, end`` (code points, end exclusive). From each rule's pattern a trigram query is derived;
    an inverted index of the trigrams that any query names gives each rule's candidates; only those are verified with
    the pattern itself. Rules without a mandatory trigram (``hex``) scan every note. The index has a few postings of each
    note; the notes are shuffled once, to meet their candidates, and nothing runs in Python.

    For each kind the leftmost non-overlapping matches are taken; one that its check refuses is gone. One result row for
    each row of ``events``; a null note is empty; other columns are not read.
    """
    queries = {kind: trigram_query(pattern) for kind, (pattern, *_) in RULES.items()}
    queries = {kind: sets for kind, sets in queries.items() if sets}
    trigrams = sorted(set().union(*(s for sets in queries.values() for s in sets)))
    index = trigram_postings(events, trigrams, key=key, text=text)
    chosen = candidates(index, queries, trigrams, key=key).select(F.col(key).alias("_key"), "rules")
    both = records(events, key, text).join(chosen, F.col("key").eqNullSafe(F.col("_key")), "left")
    note = F.col("text")
    parts = both.select("key", *(
        (F.when(F.array_contains("rules", kind), pieces(note, pattern, shown)).otherwise(F.array(note)) if kind in queries
         else pieces(note, pattern, shown)).alias(f"_{kind}") for kind, (pattern, shown, _) in RULES.items()))
    found = parts.select("key", *(matches(F.col(f"_{kind}")).alias(f"_{kind}") for kind in RULES))

    def kept(number: int, kind: str) -> Column:
        check = RULES[kind][2]
        right = F.filter(f"_{kind}", lambda s: check(s["text"])) if check else F.col(f"_{kind}")
        return F.transform(right, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("_n"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*(kept(i, kind) for i, kind in enumerate(RULES))))
    return found.select(F.col("key").alias(key), F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


