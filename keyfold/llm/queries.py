"""The queries over the whole tables that the entry module registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import common, language_id, line_dedup, maxent_lm, ngram_quality, packing, phrase_index, pii, simhash, token_count, toxicity


TOXIC = 0.7


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    """A row without an id is not held out."""
    return F.coalesce(common.remainder("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_docs(spark, sf_dir), limit=512)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.remainder("doc_id", 3) != 1)
    return toxicity.learn(_docs(spark, sf_dir), labels.select(F.col("doc_id").alias("id"), "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_docs(spark, sf_dir), toxicity_model(spark, sf_dir))
    held_out = _held_out(3, 1)
    return found.select("doc_id", held_out, "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return ngram_quality.quality(_docs(spark, sf_dir), trusted)


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = maxent_lm.score(docs, common.remainder("doc_id", 7) != 2)
    held_out = _held_out(7, 2)
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    net = language_id.learn(docs.where(common.remainder("doc_id", 4) != 2))
    found = language_id.label(docs, net)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how many of its lines and passages go, and the spans that they cover, with where they stood first."""
    found = line_dedup.removals(_docs(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"], F.coalesce(s["first_id"].cast("string"), F.lit("")), s["first_start"])), ",")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_passages", "passage_words", spans.alias("removed"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = pii.find(docs, pii.learn(docs))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(joined("base").cast("binary"), 256)
    secret = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), digest.alias("base_sha256"), joined("spans").alias("spans"), secret, F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_quality": op2_ngram_quality,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i)),
sizes AS (SELECT DISTINCT len(p) AS n FROM iw),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
h AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw ON dw.p = iw.p),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
