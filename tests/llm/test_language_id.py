import random

import numpy as np
from keyfold.llm import language_id as li
from tests.llm.helpers import awkward, table

SOUNDS = {"aa": "ka lo mi nu ra te", "bb": "ßch ünd öst äb gre zwi", "cc": "ñar ció llo que ado iez"}


def text(rng, lang, n=40):
    s = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, text(rng, g), g) for i, g in enumerate(rng.choice(list(SOUNDS)) for _ in range(n))]


def test_gradients_are_the_differences():
    li.f32, keep = np.float64, li.f32
    try:
        rng = np.random.default_rng(1)
        net = li.Network(["a", "b", "c"], li.Settings(hidden=3, segment=6))
        for part in (net.ahead, net.back):
            for k in part.NAMES:
                setattr(part, k, getattr(part, k).astype(np.float64))
        net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
        x = rng.integers(1, 9, (6, 4))
        mask, y = np.ones((6, 4)), np.array([0, 1, 2, 1])
        mask[4:, 2] = 0
        for owner, name, grad in net.step(x, mask, y)[1]:
            p = getattr(owner, name)
            for at in [tuple(rng.integers(0, min(n, 9)) for n in p.shape) for _ in range(4)]:
                old = p[at]
                p[at] = old + 1e-5
                up = net.step(x, mask, y)[0]
                p[at] = old - 1e-5
                down = net.step(x, mask, y)[0]
                p[at] = old
                assert abs((up - down) / 2e-5 - grad[at]) < 1e-6, (name, at)
    finally:
        li.f32 = keep


def test_held_out_accuracy_and_awkward_rows(spark):
    docs = table(spark, rows(1, 120))
    net = li.learn(docs, settings=li.Settings(steps=80, batch=64, segment=64))
    test = rows(2, 60)
    got = {r["doc_id"]: r for r in li.label(table(spark, test), net).collect()}
    assert sum(got[i]["lang_pred"] == g for i, _, g in test) >= 57
    odd = [r for r in awkward() if len(r[1] or "") < 300_000]
    out = li.label(table(spark, odd), net).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "cc", "und") for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (20, 21, 22)} == {"und"} and all(r["score"] == 0 for r in out if r["lang_pred"] == "und")
    assert li.label(table(spark, []), net).count() == 0


def test_nothing_to_learn_from(spark):
    net = li.learn(table(spark, [(1, "abc", None), (2, None, "x"), (3, "123", "x")]))
    assert net.languages == [] and [r["lang_pred"] for r in li.label(table(spark, [(1, "abc")]), net).collect()] == ["und"]
    one = li.learn(table(spark, [(1, "abc", "x")]))
    assert [tuple(r) for r in li.label(table(spark, [(1, "abc")]), one).collect()] == [(1, "x", 1.0)]


def test_sample_is_reached_where_few_rows_are_labelled(spark, monkeypatch):
    docs = table(spark, [(i, f"some text {i}", "en" if i % 20 == 0 else None) for i in range(4000)])
    got = []
    monkeypatch.setattr(li, "train", lambda rows, settings: got.extend(rows))
    li.learn(docs, sample=50)
    assert len(got) == 50


def test_letters():
    assert not any(li.has_letter(t) for t in (None, "", "½", "²³", "Ⅷ ①", "12_3", "漢"[:0], "٣", "😀", "½" * 50_000))
    assert all(li.has_letter(t) for t in ("a", "½x", "é", "漢", "ª", "ß²"))


def test_pooling_is_the_mean_over_all_bytes(spark):
    """One text at a time, one segment at a time, against the operator's batches."""
    net = li.learn(table(spark, rows(1, 60)), settings=li.Settings(steps=30, batch=32, segment=16))
    texts = [text(random.Random(k), g, n) for k, (g, n) in enumerate([("aa", 1), ("bb", 7), ("cc", 90), ("aa", 400)])] + ["x" * 16, "\0ab", "é" * 31]
    names, scores = net.document(texts, rows=5)
    for t, name, score in zip(texts, names, scores, strict=True):
        raw = t.encode().replace(b"\0", b" ")
        p = []
        for a in range(0, len(raw), 16):
            part = np.frombuffer(raw[a : a + 16].ljust(16, b"\0"), np.uint8).astype(np.intp)
            p += list(net.positions(part[:, None])[: len(raw[a : a + 16]), 0].astype(float))
        mean = np.mean(p, axis=0)
        assert name == net.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-5


def test_query(spark, tmp_path):
    import zlib

    from keyfold.llm import queries

    docs = [*rows(1, 80), (500, None, "aa"), (501, "12 ½", None), (None, "ka lo", None)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and {r["doc_id"]: r["lang_pred"] for r in got}[501] == "und"
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
