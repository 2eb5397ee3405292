"""Pair encoding by replay, over rows of an event log, against the library that encodes a text at a time."""

import base64

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from touchline.llm import merge_replay
from touchline.session import ship_package
from touchline.sources.reports import read_events, write_events

RANKS = tok.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pattern():
    assert merge_replay.PATTERN == tok.PATTERN


PARTS = st.sampled_from(["'", "'s", "'ll", "'re", "'d", "s", "t", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "9", "½", "!", "_", "é", "漢", "\U00010d40",
                         "Ᲊ", "́", "the", "ing", "goal", "aaaaaaa", "<|endoftext|>", "\x00"])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=25).map("".join), max_size=6))
def test_any_texts(texts):
    own = test_any_texts.own
    coder = merge_replay.replayer(RANKS)
    found, counts = coder.encode(texts)
    assert [ids(f) for f in found] == [own.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(own.encode_ordinary(t)) for t in texts]
    assert [coder.decode(f).decode() for f in found] == texts


@pytest.fixture(autouse=True, scope="module")
def _library(own):
    test_any_texts.own = own


def test_merges_out_of_order(tmp_path):
    """A merge whose new pair ranks below it: each word still takes its lowest rank first."""
    path = tmp_path / "odd.ranks"
    tokens = [*(bytes([i]) for i in range(256)), b"abc", b"bc", b"ab", b"cab", b"aa", b"aab"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    coder = merge_replay.MergeReplay(str(path))
    own = tiktoken.Encoding("odd", pat_str=tok.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc"), rng.integers(1, 30))) for _ in range(500)]
    assert [ids(f) for f in coder.encode(texts)[0]] == [own.encode_ordinary(t) for t in texts]


def test_event_log(spark, own, tmp_path):
    ship_package(spark)
    notes = ["Shot from range, saved.", "", None, " ", "\n\n", "It's theirs, they'll  go\ton", "pass " * 40_000, "x" * 5_000, "Ćorner 漢字 ½", "Shot from range, saved."]
    log = spark.createDataFrame([(i % 2, i, n) for i, n in enumerate(notes)] + [(1, 9, notes[9])], "match_id bigint, event_id bigint, note string")
    write_events(log.selectExpr("*", "1.0 as time_s", "1.0 as confidence"), str(tmp_path / "log"))
    stored = read_events(spark, str(tmp_path / "log")).selectExpr("*", "note as ids", "1 as n_tokens", "note as text")
    told = merge_replay.decode_ids(merge_replay.encode_notes(stored, RANKS, run_chars=50), RANKS)
    assert told.columns == ["match_id", "event_id", "n_tokens", "ids", "decoded"]
    want = sorted((i % 2, i, own.encode_ordinary(n or ""), (n or "").encode()) for i, n in [*enumerate(notes), (9, notes[9])])
    assert sorted((r.match_id, r.event_id, ids(r.ids), bytes(r.decoded)) for r in told.collect()) == want
    assert all(r.n_tokens == len(ids(r.ids)) for r in told.collect())


def test_keys_and_empty_tables(spark, own):
    rows = spark.createDataFrame([("a", "goal"), (None, "goal"), ("a", None)], "name string, note string")
    found = {(r.name, tuple(ids(r.ids))) for r in merge_replay.encode_notes(rows, RANKS, key="name").collect()}
    goal = tuple(own.encode_ordinary("goal"))
    assert found == {("a", goal), (None, goal), ("a", ())}
    assert merge_replay.decode_ids(merge_replay.encode_notes(rows.limit(0), RANKS, key="name"), RANKS).count() == 0
    with pytest.raises(ValueError):
        merge_replay.encode_notes(rows.withColumnRenamed("name", "ids"), RANKS, key="ids")
    null = spark.createDataFrame([(1, None)], "n int, ids binary")
    assert merge_replay.decode_ids(null, RANKS).first().decoded is None
