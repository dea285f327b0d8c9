import random

import corpus_pipeline
from keyfold.llm import packing, pii, queries, simhash
from tests.llm.helpers import sentence
from tests.llm.test_phrase_index import plain as windows
from tests.llm.test_simhash import classes


def test_every_stage_against_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    bench = [(i, sentence(rng, 18)) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        t = "\n".join(sentence(rng, 20) for _ in range(4))
        if i % 8 == 0:
            t += " You are a worthless idiot and a moron."
        elif i % 8 == 1:
            t += "\n" + bench[i % 5][1] + "\n" + sentence(rng, 10)
        elif i % 8 == 2:
            t += f" write to mail.{i}@host.example.com now"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(200 + i, docs[3 + 8 * i][1], "en", "s", 1) for i in range(5)] + [(300, "", None, None, 0), (301, None, "en", "s", None)]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    model = queries.toxicity_model(spark, at)
    left = [d for d in docs if model.score(*model.features(d[1])[:2]) < queries.TOXIC]
    assert {d[0] for d in docs} - {d[0] for d in left} == {i for i in range(160) if i % 8 == 0}
    root = classes([simhash.fingerprint(d[1]) for d in left])
    left = [d for d, r, i in zip(left, root, range(len(left))) if r == i]
    left = [d for d in left if not windows(d[1], bench)[1]]

    frame = spark.read.parquet(f"{at}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, at)
        assert frame.columns == columns, name
        frame.write.parquet(f"{at}/{name}")
        frame = spark.read.parquet(f"{at}/{name}")
    got = {r["doc_id"]: r for r in frame.collect()}
    assert sorted(got) == sorted(d[0] for d in left)
    for d in left:
        if "@" in (d[1] or ""):
            assert "<email>" in got[d[0]]["text"] and "@" not in got[d[0]]["text"]
        elif not pii.nodes(d[1] or ""):
            assert got[d[0]]["text"] == d[1]
        assert d[1] is None or got[d[0]]["n_chars"] == len(got[d[0]]["text"])
    out = corpus_pipeline.run(spark, at).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(got) and all(r["offset"] + r["length"] <= packing.CAPACITY for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
