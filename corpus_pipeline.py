"""The training-data pipeline over ``documents``: toxic rows out, near copies out, benchmark rows out, personal data
masked, the rest packed into sequences."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontamination, near_duplicates, packing, private_data, toxicity
from touchline.session import cut, shared_path, ship_package

_KEYS = {"key": "doc_id", "text": "text"}


def _stage(function):
    """Hand the package to the workers first: a stage may be called without ``run``."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, docs, sf_dir)

    return run_stage


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` but for those ids; rows without id stay."""
    return docs.join(ids.select(key).where(f"{key} is not null").distinct(), key, "left_anti").select(*docs.columns)


def _held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of a half or more go. The tagger learns from ``labels`` and all of ``documents``
    but the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, use=~_held_out("key"), **_KEYS)
    return toxicity.without_toxic(docs, model, text="text")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike by 80 % or more, and what they link) the first row stays: by
    id, then by SHA-256 of the text; rows without id come after all others. Of rows that repeat an id and a text one is
    left. Texts without words are copies of nothing, all of them stay.

    Where an id is missing or repeated the rows are numbered in that order, each with all its columns in one, so that
    no column's name matters, and are compared by their numbers.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1))
    if odd.isEmpty():
        return _without(docs, near_duplicates.near_duplicates(docs, key="doc_id", text="text").where("not kept"))
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    whole = docs.where(worded).select(F.struct(*docs.columns).alias("row"))
    one = whole.groupBy(F.col("row.doc_id").alias("id"), F.sha2("row.text", 256).alias("digest")).agg(F.min("row").alias("row"))
    rows = cut(one.orderBy(F.asc_nulls_last("id"), "digest").select("row", F.monotonically_increasing_id().alias("n")))
    texts = rows.select("n", F.col("row.text").alias("text"))
    kept = _without(rows, near_duplicates.near_duplicates(texts, key="n", text="text").where("not kept"), "n")
    return kept.select("row.*").unionByName(docs.where(~worded))


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ten words of a benchmark item go. The row travels with its text, so that each is
    judged by its own, whatever its id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_items(docs.withColumn("_row", F.struct(*docs.columns)), items, key="_row", text="text")
    return found.where(F.size("spans") == 0).select("_row.*")


@_stage
def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in a text is replaced by its kind in brackets, and ``n_chars`` follows; other texts stay as they
    are. In one pass: the other columns travel with the text."""
    kept = F.struct(*docs.columns)
    found = private_data.find_private(docs.withColumn("_row", kept), key="_row", text="text")
    masked = F.when(F.col("_row.text").isNotNull(), private_data.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("masked", masked).select(*(
        F.col("masked").alias("text") if c == "text" else
        F.when(F.size("spans") > 0, F.length("masked").cast("bigint")).otherwise(F.col(f"_row.{c}")).alias(c) if c == "n_chars" else
        F.col(f"_row.{c}").alias(c) for c in docs.columns))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048 tokens. Runs are small, as the workers have other stages
    behind them."""
    return packing.pack_notes(docs, public_tokenizers.path("byte_bpe_50k.json"), room=2048, run_chars=3_000_000,
                              remembered=400_000, **_KEYS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_benchmark),
          ("private_data", mask_private), ("packing", pack_sequences)]

#: the tagger's fit and the tokenizer cannot be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
