"""The registered queries over whole given tables, against SQL or plain versions."""

import hashlib
import os
import sys

import pytest
from brute import near, private, removed, secrets

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


@pytest.fixture(scope="module")
def run(spark):
    import __spark_entry__ as entry
    found = {k.split("_")[0]: v for k, v in entry.queries().items() if k.startswith("op")}
    assert sorted(found, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 14)]
    return lambda name: found[name](spark, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def told(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op3_source_rules", "op5_wu_manber", "op7_salvage_warc", "op11_term_tree"])
def test_sql(spark, name):
    import oracle
    import __spark_entry__ as entry
    ok, note = oracle.compare(spark, oracle.duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_private_and_secret_spans(run, docs):
    assert {r.doc_id: r.base_sha256 for r in run("op2").collect()} == {k: told(private(t)) for k, t in docs}
    assert {r.doc_id: r.base_sha256 for r in run("op8").collect()} == {k: told(secrets(t)) for k, t in docs}


def test_near_duplicates(run, docs):
    assert {tuple(r) for r in run("op4").select("doc_id", "n_shingles", "component_id", "kept").collect()} == set(near(docs, 3, 85))


def test_repeats(run, docs):
    want = {(k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in removed(docs, 13)}
    assert {tuple(r) for r in run("op9").collect()} == want


def test_merges(run, docs):
    import tiktoken
    import base64
    import struct

    import public_tokenizers as tok
    with open(tok.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for key, text in docs:
        ids = own.encode_ordinary(text or "")
        want.add((key, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in run("op12").collect()} == want


def test_conversations(spark, run):
    from collections import defaultdict

    from brute_conversations import damaged, verdict
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    assert {tuple(r) for r in run("op13").collect()} == {(c, *verdict(by[c])) for c in {r[0] for r in rows}}


def test_token_files_and_packing(run, docs):
    """op6 and op10 over the whole table, against the tokenizers library a text at a time."""
    import zlib

    import numpy as np
    import public_tokenizers as tok
    from tokenizers import Tokenizer
    words, pieces = (Tokenizer.from_file(tok.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    start, want = 0, set()
    for key, text in sorted(docs):
        ids = np.array([*words.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.add((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in run("op6").select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want
    packed = run("op10").collect()
    want = set()
    for key, text in docs:
        ids = np.array([*pieces.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and sum(n for _, n in p) <= 2048 for p in places.values())
    assert len(places) <= 1 + -(-sum(r.length for r in packed) // 2048)
