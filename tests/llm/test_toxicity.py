import random

from keyfold.llm import toxicity
from tests.llm.helpers import awkward, sentence, table


def found(text):
    return [text[a:b] for a, b, _ in toxicity.seed_model().features(text)[2]]


def test_folding():
    assert found("You 1d10t!") == ["1d10t"] and found("A$$hole") == ["A$$hole"]
    assert found("іdіоt Ídiot ｉｄｉｏｔ") == ["іdіоt", "Ídiot", "ｉｄｉｏｔ"]
    assert found("id​iot, mo̷ron") == ["id​iot", "mo̷ron"]
    assert found("idiotic scummy") == [] and found("mor0n-stupid") == ["mor0n", "stupid"]


def test_exceptions_and_length():
    assert found("the trash can. trash") == ["trash"] and found("trash cans") == ["trash"]
    m = toxicity.seed_model()
    short, long = (m.score(*m.features(t)[:2]) for t in ("you idiot", "you idiot " + "word " * 500))
    assert 0 <= m.score(0, 0) < long < short <= 1


def test_learn_finds_stems_and_spares_the_rest(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        t = sentence(rng, 60)
        if i % 6 == 0:
            for _ in range(2):
                t += f" grumblo{rng.choice(['ti', 'sta', 'ven', 'lo'])}"
        docs.append((i, t))
        labels.append((i, int(i % 6 == 0)))
    frame = spark.createDataFrame([*labels, (None, 1), (5000, None), (3, 0)], "id long, toxic int")
    train = frame.where("id is null or id % 2 = 0 or id % 3 = 1")
    model = toxicity.learn(table(spark, docs), train)
    assert any(e.startswith(" grumbl") for e in model.entries)
    got = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score(table(spark, docs), model).collect()}
    assert got == {i: bool(y) for i, y in labels}
    left = toxicity.drop(table(spark, docs), model, 0.7)
    assert left.count() == 500 and left.columns == table(spark, []).columns


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    none = spark.createDataFrame([], "id long, toxic int")
    model = toxicity.learn(docs, none)
    assert model == toxicity.seed_model()
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(awkward()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(table(spark, []), model).count() == 0


def plain(model, text):
    """(weight, words, matches): every entry at every place, one after the other, without an automaton."""
    kept = [i for i, c in enumerate(text) if not toxicity.INVISIBLE.match(c)]
    bare = "".join(text[i] for i in kept)
    hits, excused = [], []
    for accents in (True, False):
        folded = toxicity.fold(bare, accents)
        for at in range(len(folded)):
            for e, w in model.entries.items():
                if folded.startswith(e, at) and (accents or e[-1] == " "):
                    hits.append((at, at + len(e), w, folded[at + len(e) - 1] == " "))
            for e in model.exceptions:
                if folded.startswith(f" {e} ", at):
                    excused.append((at, at + len(e) + 2))
    out, until = [], -1
    for a, b, w, space in sorted(hits, key=lambda x: (x[0], -x[1])):
        if a >= until and not any(s <= a and b <= z for s, z in excused):
            until = b - space
            out.append((kept[a], kept[until - 2] + 1, w))
    return sum(w for *_, w in out), len(text.split()), out


def test_matches_and_scores_are_the_plain_ones():
    import math

    rng = random.Random(6)
    model = toxicity.Model({" idiot ": 4.0, " idi": 2.0, " scum ": 3.5, " trash ": 3.0, " trash": 1.5, " mor": 1.0}, coefficients=(-3.0, 1.5, 0.4))
    parts = ["idiot", "1d10t", "іdіоt", "Ídiot", "idiotic", "trash", "trash can", "pond scum", "scum", "mor0n", "mor​on", "x", "é", " ", " ", ", ", "\n", "­", "@", "5cum"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        weight, words, found = model.features(t)
        assert (weight, words, found) == plain(model, t), t
        z = -3.0 + 1.5 * math.log1p(weight) + 0.4 * math.log1p(1000 * weight / max(words, 1))
        assert abs(model.score(weight, words) - 1 / (1 + math.exp(-z))) < 1e-12


def test_labels_that_disagree_and_ids_that_repeat(spark):
    rng = random.Random(3)
    docs = [(i, sentence(rng, 30) + (" grumbloti" if i % 4 == 0 else "")) for i in range(200)] * 2
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    frame = spark.createDataFrame(labels, "id long, toxic int")
    both = spark.createDataFrame([*labels, *labels, *((i, 1 - y) for i, y in labels[:40])], "id long, toxic int")
    less = spark.createDataFrame(labels[40:], "id long, toxic int")
    assert toxicity.learn(table(spark, docs), both) == toxicity.learn(table(spark, docs[40:200]), less)
    assert toxicity.learn(table(spark, docs), frame) == toxicity.learn(table(spark, docs[:200]), frame)


def test_query(spark, tmp_path):
    import zlib

    from keyfold.llm import queries

    rng = random.Random(4)
    docs = [(i, sentence(rng, 40) + (" you idiot moron" if i % 5 == 0 else "")) for i in range(120)] + [(500, None), (501, ""), (None, "you idiot")]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        i = r["doc_id"]
        assert r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert i is None or r["predicted"] == (i < 500 and i % 5 == 0)
