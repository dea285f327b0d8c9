import math
import random
import re
from collections import Counter

import numpy as np
from keyfold.llm import maxent_lm as lm
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, table
from tests.llm.test_language_id import rows as languages

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), None]


def base(rows, train):
    counts = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def test_base_counts(spark, monkeypatch):
    rows = [r for r in awkward() if len(r[1] or "") < 150_000]
    train = [r for r in rows if r[0] is not None and r[0] % 2]
    for known in (lm.KNOWN, 5):  # nearly all words are joined by shuffle with the latter
        monkeypatch.setattr(lm, "KNOWN", known)
        got = lm.score(table(spark, rows), F.expr("doc_id % 2 = 1"), rounds=1).collect()
        have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
        assert have == sorted(((*x[:4], round(x[4], 6)) for x in base(rows, train)), key=str)
        assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one():
    words = [f"w{i}".encode() for i in range(3000)]
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 500, 3000))[::-1].astype(float)
    tails = np.zeros((lm.BUCKETS, 2))
    for w, c in zip(words[lm.HEAD - 1 :], counts[lm.HEAD - 1 :]):
        tails[lm.suffix_hash(w) % lm.BUCKETS] += c, 1
    model = lm.Model(lm.Counts(words, counts, 40, int(counts.sum()) + 40, 3001, tails))
    model.rows = rng.normal(size=model.rows.shape).astype(np.float32)
    head = np.arange(lm.HEAD)
    one, two = np.full(lm.HEAD, 17), np.full(lm.HEAD, 2500)
    total = (10 ** model.log10(head, one, two)).sum()
    for k in range(lm.BUCKETS):
        each = 10 ** model.log10(np.array([lm.HEAD + k]), one[:1], two[:1])[0]  # of a word with count 0
        total += each * (tails[k].sum() + 1)
    assert abs(total - 1) < 1e-4


def test_learner_follows_the_gradient():
    rng = np.random.default_rng(2)
    model = lm.Model(lm.Counts([b"a", b"b", b"c"], np.array([5.0, 4.0, 3.0]), 3, 15, 4, np.zeros((lm.BUCKETS, 2))))
    token = rng.integers(0, 4, 600)
    one, two = np.roll(token, 1), np.roll(token, 2)
    token = (one + 1) % 4  # the previous token decides
    before = model.log10(token, one, two).sum()
    learner = lm.Learner(model)
    for _ in range(5):
        learner.step(token, one, two)
    assert model.log10(token, one, two).sum() > before / 2 and np.count_nonzero(learner.change())


def test_beats_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t, _ in languages(5, 400)] + [(1000 + i, "the same line " * rng.randrange(2, 9)) for i in range(40)]
    got = lm.score(table(spark, rows), F.expr("doc_id % 4 <> 1")).toPandas()
    held = got[got.doc_id % 4 == 1]
    assert held.score.sum() > held.base_score.sum()


def test_no_training_rows(spark):
    got = lm.score(table(spark, [(1, "a b"), (2, None)]), F.lit(False), rounds=1).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score(table(spark, []), F.lit(True), rounds=1).count() == 0


def test_sums_of_groups():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(0, 400, 600), np.full(90, 7), np.arange(400, 500)])
    g = rng.normal(size=(len(rows), lm.WIDTH)).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    which, first, n = np.unique(rows[order], return_index=True, return_counts=True)
    want = np.zeros((500, lm.WIDTH))
    np.add.at(want, rows, g)
    assert np.allclose(lm._sums(g, order, first, n), want[which], atol=1e-4)
