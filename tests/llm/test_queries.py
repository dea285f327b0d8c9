"""The registered queries: their columns and types as agreed, a row for each document, and values against plain versions."""

import random

import pytest
from keyfold.llm import common, packing, queries, simhash
from tests.llm import test_line_dedup, test_simhash
from tests.llm.helpers import awkward, sentence, table
from tokenizers import Tokenizer

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_ngram_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_maxent_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_passages bigint, passage_words bigint, removed string",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(21)
    passage = sentence(rng, 60)[:-1]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in awkward() if len(t or "") < 50_000]
    rows += [(100 + i, sentence(rng, rng.randrange(40, 200)) + rng.choice(["", f" {passage} ", "\nshort line", "\nshort line\n" + sentence(rng, 20)]), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(300 + i, rows[-1 - i][1], "en") for i in range(5)]
    at = str(tmp_path_factory.mktemp("data"))
    table(spark, rows).coalesce(1).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, i % 3 // 2) for i in range(100, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, [(i, t) for i, t, _ in rows]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    at, rows = data
    df = queries.QUERIES[name](spark, at)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    assert all(have[c] == t for c, t in (x.rsplit(" ", 1) for x in COLUMNS[name].split(", ")))
    got = df.collect()
    ids = sorted((str(r["doc_id"]) for r in got if name != "op4_packing" or r["piece"] == 0), key=str)
    assert ids == sorted(str(i) for i, _ in rows)
    assert not any(r[f.name] is None for r in got for f in df.schema if f.name not in ("doc_id", "llr", "component_id"))


def test_values(spark, data):
    at, rows = data
    library = Tokenizer.from_str(common.tokenizer_json())
    counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = queries.op9_token_counts(spark, at).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(counts, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)

    prints = [simhash.fingerprint(t) for _, t in rows]
    root = test_simhash.classes(prints)
    low = {r: min((i for (i, _), s in zip(rows, root, strict=True) if s == r and i is not None), default=None) for r in root}
    got = queries.op8_simhash(spark, at).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{p:016x}", low[r])) for (i, _), p, r in zip(rows, prints, root, strict=True))

    want = test_line_dedup.plain(rows)
    texts = {}
    for r in queries.op7_line_dedup(spark, at).collect():
        texts.setdefault(r["doc_id"], []).append(r)
    for (i, t), (by_line, by_window) in want.items():
        if i is None or len(texts[i]) > 1:
            continue
        r = texts[i][0]
        spans = [tuple(map(int, s.split(":")[:2])) for s in r["removed"].split(",") if s]
        assert test_line_dedup.gone_words(spans, t) == by_line | by_window
        assert (r["n_passages"] > 0) == bool(by_window) and (r["passage_words"] >= 50) == bool(by_window) and (r["n_lines"] > 0) == bool(by_line)

    pieces = queries.op4_packing(spark, at).collect()
    lengths = {}
    for r in pieces:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in lengths.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    assert sum(r["length"] for r in pieces) == sum(n + 1 for *_, n in counts)
