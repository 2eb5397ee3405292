import random

import pytest
from brute import near

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two hundred plain documents, toxic ones, near copies, benchmark passages, personal data; null and empty rows."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeo"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    plain = [" ".join(text(rng.randrange(20, 120))) for _ in range(200)]
    toxic = []
    for _ in range(60):
        own = text(60)
        for _ in range(6):
            own.insert(rng.randrange(len(own)), "vile" + rng.choice(words))
        toxic.append(" ".join(own))
    long = text(100)
    copies = [" ".join(long[:i] + ["changed"] + long[i + 1:]) for i in range(0, 100, 20)] + [plain[0]] * 3
    passage = " ".join(text(30))
    held = [" ".join(text(10)) + " " + passage[:120] + " end" for _ in range(3)]
    private = ["write to someone@example.org or +49 30 1234567 " + " ".join(text(30)) for _ in range(4)]
    every = plain + toxic + copies + held + private + ["", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(every)] + [(None, "no id " + plain[5], "en", "s", 3)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i in range(0, 260, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            want = {k for k in left if k is None or not 200 <= k < 260}
        elif name == "near_duplicates":
            # the row without id comes after all others and goes with a copy that has one
            numbered = {10**9 if k is None else k: t for k, t in left.items()}
            want = {None if k == 10**9 else k for k, _, _, kept in near(sorted(numbered.items()), 5, 80) if kept}
            assert None not in want and 5 in want
            assert want < set(left)
        elif name == "decontamination":
            want = {k for k in left if k is None or not 268 <= k < 271}
        else:
            want = set(left)
            for k, t in left.items():
                if k is not None and 271 <= k < 275:
                    left[k] = t.replace("someone@example.org", "[EMAIL]").replace("+49 30 1234567", "[PHONE]")
                    assert got[k].n_chars == len(left[k])
        left = {k: left[k] for k in want}
        assert {k: r.text for k, r in got.items()} == left, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows[0].asDict())
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
