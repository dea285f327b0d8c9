"""Quality rules in DataFrame functions: base counts, then a hashed n-gram log-likelihood ratio of target to corpus.

Word unigrams and bigrams are hashed to a fixed number of buckets.  Two multinomials are counted: one over every
document of the corpus, one over trusted documents.  A document's score is the mean over its n-grams of
log(p_target / p_corpus); it is kept if the score is at least `threshold`.  The trusted ids are a bounded sample
(`target_rows`, lowest hashes first) of the labelled rows with quality 1, small enough to broadcast; corpus counts,
scores and decisions cover every row.  What goes to all tasks is one row of `buckets` weights.

Null and empty texts have no words and fail the base rules.  Rows with a null id are counted and scored, but are never in
the target.  Repeated rows count and return repeatedly.  Without trusted rows all weights are 0.  An empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
THRESHOLD = -0.1
PSEUDO = 10.0
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def grams(words: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every unigram (lower half) and bigram (upper half)."""
    half = buckets // 2
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(half)).cast("int"))
    two = let(words, lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: (F.pmod(F.xxhash64(F.get(ws, i), w), F.lit(half)) + half).cast("int")))
    return F.concat(one, two)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are hashed to 64 bits.  Only where a hash repeats are they sorted with their places; places whose neighbour has
    the same hash are marked, and the union of [place, place + 3) is summed in order.
    """
    n = F.size(words)

    def hashes(ws: Column) -> Column:
        return F.transform(F.slice(ws, 3, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), w))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("until"))
        return F.aggregate(
            places,
            zero,
            lambda acc, p: F.struct((acc["total"] + p + 3 - F.greatest(p, acc["until"])).alias("total"), (p + 3).alias("until")),
            lambda acc: acc["total"],
        )

    def count(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda ps: F.filter(ps, lambda p, k: (F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"])),
        )
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(places)).otherwise(F.lit(0))

    return F.when(n < 4, F.lit(0)).otherwise(let(let(words, hashes), count)).cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select("id", words_of(F.col("text")).alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    n = F.size("words").cast("long")
    rows = rows.select(
        "id",
        "words",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row, one array: log(p_target / p_corpus) by bucket; trusted: the ids in a column id.

    Corpus counts are scaled to the target's size and both get PSEUDO counts a bucket, so that buckets too rare to tell weigh nothing.
    """
    known = trusted.where("id is not null").distinct()
    sample = common.lowest(known, F.xxhash64("id"), target_rows, known.count())
    rows = docs.select(docs[id_col].alias("id"), words_of(docs[text_col].cast("string")).alias("words"))
    rows = rows.join(F.broadcast(sample.withColumn("trusted", F.lit(1))), "id", "left")  # at most target_rows ids
    counts = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(grams(F.col("words"), buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("r"), F.sum("trusted").alias("t"))
    table = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left").na.fill(0)
    total = table.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"), F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("x"))
    ratio = F.transform("x", lambda x: F.log((x["t"] + PSEUDO) / (x["r"] * (F.col("ts") / F.col("rs")) + PSEUDO)))
    return total.select(F.when(F.col("ts") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("w"))


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, llr (null without words) and kept of every row."""
    table = F.lit(np.array(weights(docs, trusted, id_col, text_col, buckets, target_rows).first()["w"]))  # always `buckets` numbers
    rows = base_counts(docs, id_col, text_col)
    found = let(grams(F.col("words"), buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g))
    rows = rows.withColumn("llr", F.when(F.col("n_words") > 0, found))
    out = rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("words")
    return out.withColumnRenamed("id", id_col)
