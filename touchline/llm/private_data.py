"""Personal data in notes with built-in functions only: patterns propose, checksums confirm, nearby words adjust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import records
from .spans import matches, pieces

# Patterns as they find; written so that no text makes them backtrack far: a run is taken whole, and from its first
# character (or where the last match ended) only.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: how long an account number is in each country
_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
            22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
            26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
            30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _account(length: int, countries: str) -> str:
    rest = f" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{length // 4 - 1}}}{rest}(?![A-Za-z0-9])"


# by the country's length first, so that a word of capitals behind an account is not taken for its next group
_IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_account(*one) for one in _LENGTHS.items())
         + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))")
_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.substring(F.lit("0246813579"), value(i) + 1, F.lit(1)).cast("int"))
    return F.aggregate(places, F.lit(0), lambda n, i: n + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number (letters and digits, country first) leaves 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    add = lambda n, i: F.when(code(i) < 65, (n * 10 + code(i) - 48) % 97).otherwise((n * 100 + code(i) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1)


#: kind: pattern, what the text must hold for it, the check, the score without context, words that raise it by 0.3
#: (within 40 characters). A span counts from 0.5 on.
KINDS: dict[str, tuple] = {
    "email": (_EMAIL, "@", None, 0.9, "mail|contact|kontakt|correo"),
    "ip": (_IP, ".", lambda m: m.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"), 0.6, "ip|addr|host|server"),
    "card": (_CARD, "", lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), 0.7, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (_PHONE, "+", lambda m: F.length(_digits(m)).between(9, 15), 0.6, "tel|phone|call|fax|mobil"),
    "iban": (_IBAN, "", mod_97, 0.8, "iban|account|konto|compte|cuenta"),
    "number": (_NUMBER, "-", None, 0.3, "ssn|social|passport|identi|insurance"),
}


def find_private(events: DataFrame, *, key: str = "event_id", text: str = "note") -> DataFrame:
    """``key, note, spans``: personal data in each whole note, by kind in the order of ``KINDS`` and then by start.

    A span has ``kind, start, end`` (code points, end exclusive) and ``score``. For each kind the leftmost
    non-overlapping matches are taken; one that its check refuses is gone, nothing shorter is tried in its place. One
    result row for each row of ``events``, in one pass without a shuffle and without Python. A null note is empty and
    has no spans; other columns are not read.
    """
    note = F.col("text")
    parts = records(events, key, text).select("key", "text", *(
        F.when(F.contains(note, F.lit(needs)) if needs else note.rlike("[0-9]"), pieces(note, pattern)).otherwise(F.array(note)).alias(f"_{kind}")
        for kind, (pattern, needs, *_) in KINDS.items()))
    found = parts.select("key", "text", *(matches(F.col(f"_{kind}")).alias(f"_{kind}") for kind in KINDS))

    def kept(kind: str) -> Column:
        _, _, check, base, words = KINDS[kind]
        near = lambda s: s["before"].rlike(words) | s["after"].rlike(words)
        scored = F.transform(f"_{kind}", lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (F.lit(base) + F.when(near(s), 0.3).otherwise(0.0)).alias("score"), s["text"].alias("text")))
        right = F.filter(scored, lambda s: (s["score"] >= 0.5) & (check(s["text"]) if check else F.lit(True)))
        return F.transform(right, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(s["score"], F.lit(1.0)).alias("score")))

    return found.select(F.col("key").alias(key), F.col("text").alias(text), F.concat(*map(kept, KINDS)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string,last:bigint>>").alias("own"))

    def add(acc: Column, s: Column) -> Column:
        own = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"), acc["at"].alias("last"))
        return F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), F.concat(acc["own"], F.array(own)).alias("own"))).otherwise(acc)

    def rebuilt(acc: Column) -> Column:
        cut = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
        heads = F.transform(acc["own"], lambda s: F.concat(cut(s["last"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(heads, ""), cut(acc["at"], F.length(text).cast("bigint")))

    return F.when(F.size(spans) > 0, F.aggregate(order, first, add, rebuilt)).otherwise(text)
