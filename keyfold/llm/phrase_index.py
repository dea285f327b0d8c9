"""Benchmark decontamination with a positional inverted index, in DataFrame functions.

1. The corpus frequency of every benchmark term is counted.
2. Each window (a run of `window` item words; a shorter item is one window) is anchored at its two rarest terms.
3. The index holds a posting (term, document, position) for every occurrence of an anchor term in the corpus; postings of
   a term that is the rarest of some window also keep the words around them.
4. Lists are adjusted by the term's place in the item (position - place) and intersected: a document and alignment
   survive for a window if both anchors are posted there.
5. The words around the rarest anchor confirm the phrase exactly, or for proximity() how far the other anchor is.

Only the benchmark's terms and windows are broadcast, and only up to common.BROADCAST_ROWS of them; beyond, the same joins run
by shuffle, of occurrences that pass a bitmap of the terms' hashes (FILTER bits).  Groups are one document's alignment with one item, so no term's list is ever gathered.

Rows are known by two hashes of id and text: repeated rows get equal results, null ids are allowed.  Null and empty
texts have no words, are never hit and, as items, have no windows; items without an id are left out; repeated items count once.
An empty table gives an empty result; an empty benchmark leaves every row clean; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

WINDOW = 10
#: Bits of the bitmap that holds back other words where the terms are too many to broadcast.
FILTER = 1 << 22


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    i = docs[id_col]
    return docs.select(i.alias("id"), F.xxhash64(F.lit(1), i, text).alias("k1"), F.xxhash64(text, F.lit(2), i).alias("k2"), words_of(text).alias("words"))


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words), one row for each distinct item."""
    text = items[text_col].cast("string")
    rows = items.select(items[id_col].alias("item_id"), text.alias("text")).where("item_id is not null").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)


def _maybe(terms: DataFrame, term: Column) -> Column:
    """Whether term may be among terms (term): false for most others, by one bit for each hash."""

    def at(t: Column) -> Column:
        return F.pmod(F.xxhash64(t), F.lit(FILTER))

    bits = terms.select(F.shiftright(at(F.col("term")), 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(F.col("term")), F.lit(64)).cast("int")).alias("b"))
    bits = bits.groupBy("i").agg(F.bit_or("b").alias("b"))
    every = terms.sparkSession.range(FILTER // 64).join(bits.hint("merge"), F.col("id") == F.col("i"), "left")
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))).alias("t")).select(F.transform("t", lambda x: x["b"]).alias("t"))
    return F.getbit(F.get(table.scalar(), F.shiftright(at(term), 6).cast("int")), F.pmod(at(term), F.lit(64)).cast("int")) == 1


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): how often each item term occurs in the corpus; docs: from _keyed, items: from item_words."""
    vocabulary = common.materialize(items.select(F.explode("words").alias("term")).distinct(), "terms")
    words = docs.select(F.explode_outer("words").alias("term"))  # explode() would cut every text twice, to drop those without words first
    if common.fits(vocabulary):
        return words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = words.where(_maybe(vocabulary, F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(vocabulary.hint("merge"), "term")


def windows(items: DataFrame, counts: DataFrame, window: int = WINDOW, least: int | None = None) -> DataFrame:
    """(item, item_id, start, phrase, a1, t1, a2, t2): windows of which all terms occur, or as many as least, with the two rarest that do and their places."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    w = items.select("item", "item_id", "words", F.explode(starts).alias("start"))
    w = w.select("item", "item_id", "start", F.slice("words", F.col("start") + 1, window).alias("phrase"))
    terms = w.select("item", "start", F.posexplode("phrase").alias("at", "term")).join(counts, "term")
    ranked = F.array_sort(F.collect_list(F.struct("n", "term", (F.col("start") + F.col("at")).alias("place"))))
    terms = terms.groupBy("item", "start").agg(ranked.alias("r"))
    both = w.join(terms, ["item", "start"]).where(F.size("r") >= (F.size("phrase") if least is None else least))
    second = F.when(F.size("r") > 1, F.element_at("r", 2)).otherwise(F.element_at("r", 1))
    r1 = F.element_at("r", 1)
    return both.select("item", "item_id", "start", "phrase", r1["place"].alias("a1"), r1["term"].alias("t1"), second["place"].alias("a2"), second["term"].alias("t2"))


def build_index(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The stored postings (term, k1, k2, pos, around); anchors: (term, first); around: up to reach words on either side, for first terms."""
    posted = docs.select("k1", "k2", "words", F.posexplode_outer("words").alias("pos", "term"))
    around = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + reach + 1)
    columns = ["term", "k1", "k2", "pos"]
    if common.fits(anchors):
        posted = posted.join(F.broadcast(anchors), "term").select(*columns, F.when(F.col("first"), around).alias("around"))
    else:  # what is shuffled has the words around, not the text's
        posted = posted.where(_maybe(anchors, F.col("term"))).select(*columns, around.alias("around"))
        posted = posted.join(anchors.hint("merge"), "term").select(*columns, F.when(F.col("first"), F.col("around")).alias("around"))
    return common.materialize(posted, "postings")


def _search(docs: DataFrame, items: DataFrame, window: int, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, postings) of the benchmark's items."""
    w = common.materialize(windows(items, term_counts(docs, items), window, least), "windows")
    anchors = w.select(F.col("t1").alias("term"), F.lit(True).alias("first")).union(w.select("t2", F.lit(False)))
    anchors = common.materialize(anchors.groupBy("term").agg(F.max("first").alias("first")), "anchors")
    return w, build_index(docs, anchors, window - 1)


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, start, stop, item_id) of every occurrence of a window in a document, positions in words."""
    w, postings = _search(docs, items, window)
    places = w.select(F.col("t1").alias("term"), "item", F.col("a1").alias("place")).union(w.select("t2", "item", "a2")).distinct()
    aligned = postings.join(common.small(places), "term")
    # intersection of the adjusted lists: one small group for each alignment of an item with a document
    lists = aligned.groupBy("k1", "k2", "item", (F.col("pos") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places"), F.collect_list(F.when(F.col("around").isNotNull(), F.struct("place", "around"))).alias("rare")
    )
    found = lists.select("k1", "k2", "item", "shift", "places", F.explode("rare").alias("x")).select("k1", "k2", "item", "shift", "places", F.col("x.place").alias("a1"), F.col("x.around").alias("around"))
    met = found.join(common.small(w), ["item", "a1"]).where(F.array_contains("places", F.col("a2")))
    start = F.col("shift") + F.col("start")
    base = F.greatest(F.col("shift") + F.col("a1") - (window - 1), F.lit(0))
    met = met.withColumn("begin", start).where("begin >= 0").where(F.slice("around", F.col("begin") - base + 1, F.size("phrase")) == F.col("phrase"))
    return met.select("k1", "k2", F.col("begin").alias("start"), (F.col("begin") + F.size("phrase")).alias("stop"), "item_id")


def proximity(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, item_id, start, apart): places where the two rarest terms that occur of a window stand within `window` words of each other, in any order.

    id is null for rows with a null id; apart: their distance in the document.
    """
    rows = _keyed(docs, doc_id, doc_text)
    w, postings = _search(rows, item_words(items, item_id, item_text), window, 2)
    pairs = w.select("item_id", "t1", "t2").distinct()
    near = postings.where("around is not null").join(common.small(pairs), F.col("term") == F.col("t1")).select("k1", "k2", "item_id", "pos", "t1", "t2", F.posexplode("around").alias("at", "other"))
    apart = F.col("at") - F.least(F.col("pos"), F.lit(window - 1))
    near = near.where((F.col("other") == F.col("t2")) & (apart != 0)).select("k1", "k2", "item_id", "pos", F.abs(apart).alias("apart")).groupBy("k1", "k2", "item_id", "pos").agg(F.min("apart").alias("apart"))
    return rows.select("id", "k1", "k2").join(near, ["k1", "k2"]).select("id", "item_id", F.col("pos").alias("start"), "apart")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, item_ids, spans, contaminated) of every row: words inside a window, sorted items, merged word spans."""
    rows = _keyed(docs, doc_id, doc_text)
    hits = phrase_hits(rows, item_words(items, item_id, item_text), window)
    by_doc = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("hits"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    merged = F.aggregate(
        "hits",
        none,
        lambda acc, h: F.when(F.get(acc, F.size(acc) - 1)["stop"] >= h["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(h["stop"], F.get(acc, F.size(acc) - 1)["stop"]).alias("stop"))))).otherwise(
            F.concat(acc, F.array(h))
        ),
    )
    by_doc = by_doc.select("k1", "k2", merged.alias("spans"), "item_ids")
    out = rows.select("id", "k1", "k2", F.size("words").cast("long").alias("n_words")).join(by_doc, ["k1", "k2"], "left")
    spans = F.coalesce("spans", none)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    out = out.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), spans.alias("spans"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that no window hits."""
    hits = phrase_hits(_keyed(docs, doc_id, doc_text), item_words(items, item_id, item_text), window)
    bad = common.materialize(hits.select("k1", "k2").distinct(), "contaminated")
    text = docs[doc_text].cast("string")
    here = [F.xxhash64(F.lit(1), docs[doc_id], text) == bad["k1"], F.xxhash64(text, F.lit(2), docs[doc_id]) == bad["k2"]]
    return docs.join(common.small(bad), here, "left_anti")
