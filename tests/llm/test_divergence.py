"""The divergence of sources over rows of an event log, against all terms by all pairs."""

import re
from collections import Counter, defaultdict

import pytest
from touchline.llm.source_divergence import audit_sources
from touchline.session import ship_package
from touchline.sources.reports import read_events, write_events


def plain(rows, least, smoothing=5, scale=10**9, top=50):
    """(kind, source, part, item, value, rank) for rows of (kind, source, note)."""
    seen, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for kind, source, note in rows:
        kind, source = kind or "", source or ""
        groups[kind].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), note or ""))
        own[kind, source].update(terms)
        seen[kind].update(set(terms))
    out = set()
    for kind, sources in groups.items():
        kept = sorted(t for t, n in seen[kind].items() if n >= least)
        counts = {s: {t: own[kind, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(c[t] for c in counts.values()) for t in kept}
        shares = {s: {t: 1 + scale * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(shares[s][t] - shares[None][t], t) for t in kept if counts[s][t] and shares[s][t] > shares[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(kind, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def log_rows():
    words = ["shot", "Saved", "wide", "CORNER", "Ćurling", "keeper", "tackle", "won", "late", "漢", "naïve", "box"]
    rows = []
    for i in range(400):
        kind = ("shot", "goal", None, "")[i % 4 if i % 3 else 0]
        source = ("manual", "whistle", "ball", None, "Ä")[i * i % 5]
        note = " ".join(words[(i * k + k * k) % (7 + 5 * (i % 2))] for k in range(i % 9)) + ("!, 7x" if i % 5 else "")
        rows.append((i % 3, i, kind, source, None if i % 50 == 7 else note))
    rows += [(0, 5000 + i, "shot", "manual", "shot saved") for i in range(150)]  # most rows of one source
    rows += [(1, 6000, "shot", "silent", "9 - 9"), (1, 6001, "foul", "manual", "a foul"), (1, 6001, "foul", "manual", "a foul"), (1, 6002, "foul", "x", " ".join(["late"] * 3000))]
    return rows


def test_event_log(spark, tmp_path, log_rows):
    ship_package(spark)
    log = spark.createDataFrame(log_rows, "match_id bigint, event_id bigint, type string, source string, note string")
    log = log.withColumns({"time_s": log.event_id.cast("double"), "confidence": log.event_id * 0.0 + 1, "kind": log.type, "term": log.note, "p": log.note})
    found = {tuple(r) for r in audit_sources(log, least_notes=10).collect()}
    assert found == plain([r[2:] for r in log_rows], 10)
    assert {r[1] for r in found if r[0] == "shot"} >= {"silent"} and {r[4] for r in found if r[0] == "foul" and r[2] == "pair"} == {0}
    write_events(log.select("match_id", "event_id", "type", "source", "note", "time_s", "confidence"), str(tmp_path / "log"))
    stored = read_events(spark, str(tmp_path / "log"))  # the log's defaults stand in for what is missing
    found = {tuple(r) for r in audit_sources(stored, least_notes=5, top=3).collect()}
    assert found == plain([(r[2] if r[2] is not None else "other", r[3] if r[3] is not None else "manual", r[4]) for r in log_rows], 5, top=3)


def test_partitions_do_not_matter(spark, log_rows):
    from touchline.llm import source_divergence
    log = spark.createDataFrame(log_rows, "match_id bigint, event_id bigint, type string, source string, note string")
    rows = spark.createDataFrame([("k", f"t{i}", s, 100 + (i * s) % 3, 10 + s) for i in range(60) for s in range(5) if (i + s) % 3],
                                 "kind string, term string, sid int, p bigint, none bigint")
    whole = {tuple(r) for r in source_divergence.pair_corrections(rows.coalesce(1)).collect()}
    assert whole and whole == {tuple(r) for r in source_divergence.pair_corrections(rows, most_held=1).collect()}
    assert {tuple(r) for r in audit_sources(log.repartition(23), least_notes=3).collect()} == plain([r[2:] for r in log_rows], 3)


def test_no_notes(spark):
    none = spark.createDataFrame([], "type string, source string, note string")
    assert audit_sources(none).count() == 0
    bare = spark.createDataFrame([(None, None, None), ("a", "b", "")], "type string, source string, note string")
    assert audit_sources(bare).count() == 0  # two sources of different kinds, no terms, no pairs
