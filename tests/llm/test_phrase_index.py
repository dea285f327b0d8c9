import random
import re

from keyfold.llm import common, phrase_index
from tests.llm.helpers import WORDS, awkward, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def plain(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        if i is None or not v:
            continue
        for s in range(max(1, len(v) - window + 1)):
            p = v[s : s + window]
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def cases():
    rng = random.Random(9)
    few = WORDS[:5]
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 25)))) for i in range(12)]
    items += [(20, "only three words"), (21, "Únique"), (22, None), (23, ""), (24, "--- !"), (None, items[0][1]), (3, items[3][1]), (25, items[4][1]), (26, "ba ba ba ba ba ba ba ba ba ba ba")]
    items += [(27, " ".join(rng.choice(few) for _ in range(14))), (3, "another text of the very same id that has more than ten words in it")]
    docs = awkward()
    for k in range(40):
        t = [rng.choice(WORDS) for _ in range(30)]
        v = words(rng.choice(items)[1] or "")
        if v:
            a = rng.randrange(len(v))
            t[10:10] = v[a : a + rng.randrange(8, 14)]
        docs.append((100 + k, rng.choice(["-", ", ", " "]).join(t).upper()))
    docs += [(200, "ba " * 40), (201, " ".join(rng.choice(few) for _ in range(300))), (202, "only three words"), (203, "only three"), (204, "únique ÚNIQUE Únique"), (205, items[0][1]), (205, items[0][1])]
    return docs, items


def test_matches_a_plain_scan(spark, monkeypatch):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, "q", 1) for i, t in items], "item_id long, text string, term string, place int")
    want = sorted(((i, *plain(t, items)) for i, t in docs if len(t or "") < 150_000), key=str)
    for rows in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        got = phrase_index.decontaminate(table(spark, [d for d in docs if len(d[1] or "") < 150_000]), frame).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) and sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_drop_contaminated(spark):
    docs, items = cases()
    docs = [d for d in docs if len(d[1] or "") < 150_000]
    left = phrase_index.drop_contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, t in docs if not plain(t, items)[1])
    assert left.columns == table(spark, []).columns


def test_proximity_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = table(spark, [(1, "kappa x y alpha beta gamma delta epsilon zeta eta theta iota"), (2, "alpha " + "z " * 30 + "beta")])
    near = phrase_index.proximity(docs, items).collect()
    assert {r["id"] for r in near} == {1} and all(0 < r["apart"] < 10 for r in near)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in phrase_index.decontaminate(docs, none).collect()] == [False, False]
    assert phrase_index.decontaminate(table(spark, []), items).count() == 0


def test_no_text_is_shuffled_where_terms_are_too_many_to_broadcast(spark, monkeypatch):
    import contextlib
    import io

    docs, items = cases()
    plans, keep = {}, common.materialize

    def kept(df, what):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        plans[what] = out.getvalue()
        return keep(df, what)

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "materialize", kept)
    rows = phrase_index._keyed(table(spark, docs[:20]), "doc_id", "text")
    phrase_index.phrase_hits(rows, phrase_index.item_words(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")).count()
    moved = [line for at, line in re.findall(r"\) (\w+)\nInput [^\n]*?: (\[[^\n]*\])", plans["postings"]) if at == "Exchange"]
    assert any("around#" in m for m in moved) and not any("words#" in m for m in moved)


def test_proximity_needs_not_all_words(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota absent"), (2, "lone absent words")], "item_id long, text string")
    docs = table(spark, [(1, "x beta q alpha y"), (2, "lone " + "z " * 30)])
    near = phrase_index.proximity(docs, items).collect()
    assert {(r["id"], r["item_id"], r["apart"]) for r in near} == {(1, 1, 2)}
