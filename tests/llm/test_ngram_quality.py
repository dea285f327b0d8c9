import math
import re
from collections import Counter

from keyfold.llm import ngram_quality
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, sentence, table


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_and_ratio(spark):
    rows = awkward() + [(40, "a b c a b c a b c d e f " * 10), (41, "x y z\nx y z\n\nx y z \n# * $\n \n "), (42, "p q p q p q r"), (43, "a b c d a b c")]
    docs = table(spark, rows)
    trusted = spark.createDataFrame([(1,), (2,), (None,), (999,), (1,)], "id long")
    got = ngram_quality.quality(docs, trusted, buckets=64).collect()
    plain_words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    hashed = {}
    pairs = sorted({(w,) for ws in plain_words for w in ws} | {p for ws in plain_words for p in zip(ws, ws[1:])})
    frame = spark.createDataFrame([(p[0], p[1] if len(p) > 1 else None) for p in pairs], "a string, b string")
    for r in frame.select("a", "b", F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(32))).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(32)) + 32).alias("g")).collect():
        hashed[(r["a"],) if r["b"] is None else (r["a"], r["b"])] = r["g"]
    grams = [[hashed[(w,)] for w in ws] + [hashed[p] for p in zip(ws, ws[1:])] for ws in plain_words]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if i in (1, 2):
            target.update(g)
    weight = [math.log((target[b] + 10) / (raw[b] * sum(target.values()) / sum(raw.values()) + 10)) for b in range(64)]
    want = {}
    for (i, t), g in zip(rows, grams):
        llr = sum(weight[b] for b in g) / len(g) if g else None
        want.setdefault(str(i), []).append((*base(t), llr))
    assert len(got) == len(rows)
    for r in got:
        key = tuple(r[c] for c in COLUMNS)
        match = [w for w in want[str(r["doc_id"])] if w[:6] == key]
        assert match, (r, want[str(r["doc_id"])])
        assert any(w[6] is None and r["llr"] is None or w[6] is not None and abs(w[6] - r["llr"]) < 1e-9 for w in match)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= ngram_quality.THRESHOLD)


def test_junk_goes_and_clean_stays(spark):
    import random

    rng = random.Random(1)
    good = [(i, sentence(rng, 80)) for i in range(60)]
    bad = [(100 + i, " | ".join(f"%{rng.randrange(10**6)}" for _ in range(60))) for i in range(10)]
    docs = table(spark, good + bad)
    kept = {r["doc_id"] for r in ngram_quality.quality(docs, spark.range(30)).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_no_trusted_rows_and_no_rows(spark):
    none = spark.createDataFrame([], "id long")
    assert {r["llr"] for r in ngram_quality.quality(table(spark, [(1, "a b"), (2, None)]), none).collect()} == {0.0, None}
    assert ngram_quality.quality(table(spark, []), none).count() == 0
