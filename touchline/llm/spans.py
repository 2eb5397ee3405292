"""Positions of pattern matches with built-in functions only.

A text is marked around every match of a pattern and split at the marks; the pieces at odd places are the matches, and
their positions are running sums of the pieces' lengths. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, INNER = "\u0001", "\u0002"
_RUN = 64


def pieces(text: Column, pattern: str, replacement: str = "$0") -> Column:
    """``text`` split around the leftmost non-overlapping matches of ``pattern`` (Java syntax). Marks that the text holds
    itself are replaced by a character that no pattern treats otherwise. ``replacement`` must keep the match's length,
    but for ``INNER`` marks that part a match in two."""
    clean = F.translate(text, MARK + INNER, "\u0003\u0003")
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}{replacement}{MARK}")), MARK, -1)


def matches(parts: Column) -> Column:
    """``array<struct<start, end, text, before, after>>`` of the matches in ``parts`` (a column, see ``pieces``).

    Sums run over blocks of 64 pieces, so a text with very many matches takes little more than linear time.
    """
    size = lambda piece: F.length(F.translate(piece, INNER, "")).cast("bigint")
    total = lambda some: F.aggregate(some, F.lit(0).cast("bigint"), lambda n, piece: n + size(piece))
    count = F.size(parts)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / _RUN).cast("int")), lambda b: total(F.slice(parts, b * _RUN + 1, F.lit(_RUN))))
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("at"))
    starts = F.aggregate(blocks, empty, lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")),
                         lambda acc: acc["at"])

    def place(i: Column, starts: Column) -> Column:
        block = F.floor(i / _RUN).cast("int")
        start = F.get(starts, block) + total(F.slice(parts, block * _RUN + 1, F.pmod(i, F.lit(_RUN))))
        own = F.get(parts, i)
        return F.struct(start.alias("start"), (start + size(own)).alias("end"), own.alias("text"),
                        F.lower(F.right(F.get(parts, i - 1), F.lit(40))).alias("before"),
                        F.lower(F.left(F.get(parts, i + 1), F.lit(40))).alias("after"))

    odd = F.sequence(F.lit(1), F.greatest(F.lit(1), count - 1), F.lit(2))
    # the block sums are handed to every place through a one-element array, so they are computed once a text
    found = F.flatten(F.transform(F.array(starts), lambda s: F.transform(odd, lambda i: place(i, s))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>")
    return F.when(count > 1, found).otherwise(none)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
