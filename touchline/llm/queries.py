"""The registered queries: each maps the given tables to an operator's own records and its results back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (conversations, decontamination, merge_replay, near_duplicates, packing, private_data, quality, repeats, secret_scan,
               source_divergence, tokens, toxicity, warc)
from .spans import joined

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as notes of reviewed events: id, note, and the source that wrote it."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("note"), "source")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = tokens.token_files(notes(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.withColumnRenamed("event_id", "doc_id")


@query("op10_best_two_fit")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack_notes(notes(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, room=2048)
    return out.withColumnRenamed("event_id", "doc_id")


@query("op5_wu_manber", oracle=r"""
WITH folded AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
worded AS (SELECT kind, id, rid, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (SELECT id, w, least(10, len(w)) AS m FROM worded WHERE kind = 1 AND len(w) > 0),
wins AS (SELECT DISTINCT id AS item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM items)),
places AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM worded CROSS JOIN (SELECT DISTINCT m FROM wins) WHERE kind = 0),
hits AS (SELECT rid, s, p.m, item_id FROM (SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win FROM places) p JOIN wins USING (m, win)),
covered AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS word FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid) WHERE kind = 0
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontamination.find_items(notes(spark, folder), items)
    n_hit = decontamination.hit_words()
    return found.select(F.col("event_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op9_seed_extend")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.remove_repeats(notes(spark, folder))
    return out.select(F.col("event_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_note", 256).alias("kept_sha256"))


@query("op4_min_max_hash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates.near_duplicates(notes(spark, folder), shingle=3, percent=85)
    return out.select(F.col("event_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def held_out(key: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, a fifth of all."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


@query("op1_span_field")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    events = notes(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("doc_id", "event_id")
    model = toxicity.train(events, labels, use=~held_out("key"))
    scored = toxicity.score_notes(events, model)
    return scored.select(F.col("event_id").alias("doc_id"), held_out("event_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("spans").cast("bigint").alias("n_spans"),
                         F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.start, s.end))).alias("spans"))


@query("op3_source_rules", oracle=r"""
WITH worded AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT rid, s, array_to_string(w[s:s + 2], ' ') AS run FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS s FROM worded)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, run) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest([s, s + 1, s + 2]) AS word FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM worded) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
stats AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM worded LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS failed FROM stats),
hosts AS (SELECT source, count(*) AS notes, sum(CAST(failed AS BIGINT)) AS failures FROM judged GROUP BY source),
sums AS (SELECT sum(notes) * 1e0 AS n, sum(failures) * 1e0 AS x, count(*) AS hosts, sum(failures * 1e0 * failures / notes) AS xx,
  sum(notes * 1e0 * notes) AS nn FROM hosts),
rho AS (SELECT x / n AS mean, ((xx - x * x / n) / nullif(x / n * (1e0 - x / n), 0e0) - (hosts - 1)) / nullif(n - nn / n - hosts + 1, 0e0) AS rho FROM sums),
prior AS (SELECT mean, CASE WHEN rho > 0e0 THEN greatest(2e0, least(10000e0, 1e0 / rho - 1e0)) ELSE 10000e0 END AS strength FROM rho),
verdicts AS (SELECT source, (failures + mean * strength) / (notes + strength) > 0.5e0 AND 2 * failures > notes AS rejected FROM hosts CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_notes(notes(spark, folder))
    return judged.select(F.col("event_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query("op2_private_spans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.find_private(notes(spark, folder))
    base = ("email", "ip", "card", "phone")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("event_id").alias("doc_id"), *map(of, base),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op8_trigram_index")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(notes(spark, folder))
    base = ("assign", "access", "hex")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("event_id").alias("doc_id"), *map(of, base),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op7_salvage_warc", oracle="""
WITH b32 AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, payload_bytes, hex, string_agg(lpad(bin(('0x' || substr(hex, k, 1))::INTEGER), 4, '0'), '' ORDER BY k) AS b
  FROM b32 CROSS JOIN range(1, 41) r(k) GROUP BY ALL),
digests AS (SELECT page_id, payload_bytes, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  list_sum([CASE WHEN substr(b, 5 * k + j, 1) = '1' THEN 1 << (5 - j) ELSE 0 END FOR j IN [1, 2, 3, 4, 5]])::INTEGER + 1, 1), '' ORDER BY k) AS payload_digest
  FROM bits CROSS JOIN range(0, 32) r(k) GROUP BY ALL),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive_pages(spark.read.parquet(f"{folder}/pages.parquet"))
    # archives written a moment ago have no gaps; one would mean lost pages
    page = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("damaged archive: "), "reason"))).otherwise(F.col("page_id"))
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_term_tree", oracle=r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) + 5 * coalesce(v, 0) AS d, lang_total + 5 * v AS lang_d
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN vocabulary USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)),
shares AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)::HUGEINT) // d AS p,
  1 + (1000000000 * (lang_n + 5)::HUGEINT) // lang_d AS q
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b
  ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("lang").alias("type"), "source", F.col("text").alias("note"))
    return source_divergence.audit_sources(events).withColumnRenamed("kind", "lang")


@query("op12_merge_replay")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    told = merge_replay.decode_ids(merge_replay.encode_notes(notes(spark, folder), ranks, key="event_id"), ranks)
    return told.select(F.col("event_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_meet_in_the_middle")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    faults, repaired = conversations.repair_conversations(conversations.damage(rows))
    named = lambda df: df.select(F.struct("conv_id").alias("_c"), *[c for c in df.columns if c != "conv_id"])
    every = named(rows.select("conv_id").distinct()).join(named(faults), "_c", "left").join(
        named(conversations.conversation_digests(repaired)), "_c", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return every.select("_c.conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
