import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from brute import items_in, split
from pyspark.sql import functions as F

from touchline.llm import decontamination, quality, toxicity

NOTE = "event_id bigint, note string"
SF = "/root/testdata/sf0.01"


def test_find_items(spark, notes_df, no_notes, note_rows):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB") + rng.choice([" ", " ", "-", "é", "_"]) for _ in range(n))
    items = [*((i, text(rng.choice([3, 9, 12, 40]))) for i in range(12)), (1, "a b a"), (20, None), (21, ""), (22, "a"), (22, "a")]
    rows = [*((i, text(rng.randrange(120))) for i in range(80)), *note_rows]
    events = spark.createDataFrame(rows, NOTE).withColumns({c: F.lit(c) for c in ("text", "key", "items", "marks")})
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("note", F.lit(1))
    want = Counter()
    for key, note in rows:
        n, hit, found = items_in(note, items, 10)
        want[key, n, tuple(sorted(hit)), tuple(found)] += 1
    for limits in ({}, {"max_windows": 25}, {"max_bytes": 1500}):  # one pass, and many
        got = decontamination.find_items(events, table, **limits).collect()
        assert want == Counter((r.event_id, r.n_words, tuple(i for s in r.spans for i in range(s.first, s.last)), tuple(r["items"])) for r in got)
    assert decontamination.find_items(no_notes, table).count() == 0
    nothing = decontamination.find_items(notes_df, table.limit(0)).collect()
    assert len(nothing) == len(note_rows) and all(not r.spans and not r["items"] for r in nothing)


def test_a_passage_of_very_many_items_is_parted(spark, monkeypatch):
    """No broadcast holds more than its share of the items of one passage, and none is lost."""
    sizes, build = [], decontamination.WordPatterns.__init__

    def counted(self, m, patterns):
        sizes.append(sum(map(len, patterns.values())))
        build(self, m, patterns)

    monkeypatch.setattr(decontamination.WordPatterns, "__init__", counted)
    passage = " ".join(f"w{i}" for i in range(10))
    items = spark.range(4000).selectExpr("concat('item', id) AS item_id", f"'{passage}' AS text")
    events = spark.createDataFrame([(1, "so " + passage), (2, "w1 w2"), (2, passage + " " + passage)], NOTE)
    got = sorted((r.event_id, r.n_words, len(r["items"])) for r in
                 decontamination.find_items(events, items, max_windows=1000).collect())
    assert got == [(1, 11, 4000), (2, 2, 0), (2, 20, 4000)]
    assert sum(sizes) == 4000 and max(sizes) < 1200


def plain_stats(text):
    words, lines = split(text), [x for x in (text or "").encode().split(b"\n") if x.split()]
    runs = Counter(zip(words, words[1:], words[2:]))
    cover = {j for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_judge_notes(spark, note_rows, no_notes):
    good = " ".join(f"w{i}ord" for i in range(60))
    rows = [(k, n, "feed") for k, n in note_rows] + [(100 + i, good + f" z{i}", "good") for i in range(30)]
    rows += [(200 + i, ("# " * 70 if i % 5 else good), "bad") for i in range(40)] + [(300, good, "rare"), (301, "short", None), (302, good, None)]
    df = spark.createDataFrame(rows, NOTE + ", source string").withColumns({c: F.lit(c) for c in ("key", "text", "n_words", "rejected", "_id")})
    got = quality.judge_notes(df).collect()
    want = Counter()
    for key, note, source in rows:
        s = plain_stats(note)
        base = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want[key, source, *s, base, not base and source != "bad" and source != "feed"] += 1
    assert want == Counter((r.event_id, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert quality.judge_notes(no_notes.withColumn("source", F.lit("x"))).count() == 0


def test_prior_pulls_small_sources(spark):
    rows = [(f"s{i}", 100, 5) for i in range(20)] + [("tiny", 1, 1), ("bad", 100, 95)]
    stats = spark.createDataFrame([(s, int(j < bad)) for s, n, bad in rows for j in range(n)], "source string, bad int").selectExpr(
        "source", "case when bad = 1 then 10L else 100L end as n_words", "500L word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "5L n_lines")
    got = {r["source"]: r for r in quality.source_verdicts(stats).collect()}
    assert got["bad"].rejected and not got["tiny"].rejected and got["tiny"].rate < 0.5 < got["bad"].rate and got["s0"].rate < 0.12


def test_forward_backward_is_the_sum_over_all_paths(monkeypatch):
    rng = np.random.default_rng(0)
    for segment in (2, 3, 32):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        counts = np.array([0, 1, 7, 0, 2, 6])
        emission, trans = rng.normal(0, 2, counts.sum()), rng.normal(0, 1, (2, 2))
        got = toxicity._Chain(counts).marginals(emission, trans)[2]
        at = 0
        for n in counts:
            weight = np.zeros(n)
            total = 0.0
            for path in itertools.product((0, 1), repeat=int(n)):
                w = np.exp(sum(trans[a, b] for a, b in zip((0, *path), path)) + sum(e for e, s in zip(emission[at:at + n], path) if s))
                total += w
                weight += w * np.array(path, float)
            assert np.allclose(got[at:at + n], weight / total)
            at += n


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    notes, toxic = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(15, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), "vile" + rng.choice(words))
        notes.append(" ".join(text)), toxic.append(int(bad))
    return toxicity.fit(notes, toxic), words


def test_tagger_finds_new_forms(spark, tagger, notes_df, no_notes, note_rows):
    model, words = tagger
    text = "Bal vileXYZQ, kos. " + " ".join(words[:20]) + " VILEbal viledon"
    df = spark.createDataFrame([(1, text), (2, " ".join(words)), (3, ""), (4, None)], NOTE)
    got = {r.event_id: r for r in toxicity.score_notes(df, model).collect()}
    found = [text[s.start:s.end] for s in got[1].spans]
    assert found[-1] == "VILEbal viledon" and all(f.lower().startswith("vile") for f in found)
    assert got[1].score > 0.5 > got[2].score and not got[2].spans
    assert 0 <= got[3].score == got[4].score < 0.5 and got[4].n_words == 0
    rows = toxicity.score_notes(notes_df, model).collect()
    assert Counter(r.event_id for r in rows) == Counter(k for k, _ in note_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_notes(no_notes, model).count() == 0


def test_training_without_a_class(spark, notes_df):
    for labels in ([], [(0, 0), (5, None)], [(0, 1), (0, 1)]):
        table = spark.createDataFrame(labels, "event_id bigint, toxic int")
        model = toxicity.train(notes_df, table)
        assert all(0 <= r.score <= 1 for r in toxicity.score_notes(notes_df, model).collect())


def test_held_out_rows(spark):
    if not os.path.isdir(SF):
        pytest.skip("tables not there")
    from touchline.llm import queries
    scored = queries.QUERIES["op1_span_field"](spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert sum(r.predicted > r.toxic for r in rows) <= 2
