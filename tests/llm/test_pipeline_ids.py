"""The stages on rows whose id is missing or repeated."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeo"]
    text = lambda n: [rng.choice(words) for _ in range(n)]

    def vile():
        own = text(60)
        for _ in range(6):
            own.insert(rng.randrange(len(own)), "vile" + rng.choice(words))
        return " ".join(own)

    plain, toxic = [" ".join(text(60)) for _ in range(100)], [vile() for _ in range(60)]
    passage = text(30)
    long = text(100)
    copy = " ".join(long[:50] + ["changed"] + long[51:])
    rows = [(i, t) for i, t in enumerate(plain + toxic)]
    rows += [(None, vile()), (None, "lead " + " ".join(passage)), (None, " ".join(long)), (None, copy), (None, copy), (None, ""), (None, None), (None, None),
             (500, "a b " + " ".join(long)), (500, "a b " + " ".join(long)), (501, "c d " + copy), (501, "another " + plain[7][::-1]), (502, None), (502, None),
             (503, vile()), (503, " ".join(text(40)))]
    folder = str(tmp_path_factory.mktemp("ids"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(0, 160, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_toxic_rows_without_or_with_repeated_id_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    assert not [r for r in out if "vile" in (r.text or "")]
    assert sum(r.doc_id == 503 for r in out) == 1 and sum(r.doc_id is None for r in out) == 7


def test_benchmark_rows_without_id_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_benchmark(spark, docs, folder)
    assert out.dtypes == docs.dtypes and out.count() == docs.count() - 1
    assert not out.where("text like 'lead %'").count() and out.where("text is null").count() == 4


def test_near_copies_settle_missing_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    texts = lambda key: sorted(r.text or "" for r in rows if r.doc_id == key)
    assert len(texts(500)) == 1 and [t[:8] for t in texts(501)] == ["another "] and texts(502) == ["", ""] and len(texts(503)) == 2
    nameless = texts(None)
    assert nameless.count("") == 3 and len(nameless) == 5  # the toxic and the benchmark's; all three copies have one with an id
    assert {r.doc_id for r in rows} >= set(range(160))


def test_names_and_ids_that_might_clash(spark):
    """Columns named like what the stage needs itself, and ids at the end of their range."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, words), (2**63 - 1, words + " more"), (None, words), (-2**63, "other " * 9), (2**63 - 2, None), (2**63 - 2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", 2, "b", 3) for i, t in rows], DOCS + ", _digest string, _n int, row string, n int")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text is None) for r in out.collect()) == [(-2**63, False), (2**63 - 2, True), (2**63 - 2, True), (2**63 - 1, False)]


def test_labels_of_one_class_or_none_keep_all_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, labels in (("none", []), ("clean", [(i, 1, 0) for i in range(60)]), ("toxic", [(i, 1, 1) for i in range(60)])):
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == docs.count()
