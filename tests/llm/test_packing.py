import random
import zlib

import numpy as np
from keyfold.llm import common, packing
from tests.llm.helpers import awkward, sentence, table
from tokenizers import Tokenizer


def test_fullest_is_the_fullest():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
        room = rng.randrange(0, 80)
        sums = {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(left, sorted(left, reverse=True), room)
        assert all(k <= left[n] for n, k in got) and sum(n * k for n, k in got) == max(sums)


def test_slots_hold_every_piece_once():
    rng = random.Random(3)
    counts = {rng.randrange(1, 45): rng.randrange(1, 500) for _ in range(60)} | {90: 3, 100: 2}
    slots, sequences = packing.minimum_slack(counts, 100)
    bins = [0] * sequences
    ranks = {n: [] for n in counts}
    for n, first, copies, seq, offset in slots.tolist():
        ranks[n] += range(first, first + copies)
        for k in range(copies):
            bins[seq + k] += n
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items()) and max(bins) <= 100
    assert sequences <= -(-sum(n * c for n, c in counts.items()) // 100) + 2


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_ids_are_the_librarys():
    model = common.tokenizer_json()
    ids, library = packing.encoder(model), Tokenizer.from_str(model)
    rng = random.Random(5)
    texts = [t for _, t in awkward() if t] + ["<|endoftext|> <|endoftext", "'s''t  \n\n x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(300)]
    assert [ids(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pack(spark):
    rng = random.Random(6)
    rows = awkward() + [(100 + i, sentence(rng, rng.randrange(1, 900))) for i in range(150)]
    got = packing.pack(table(spark, rows).repartition(3)).toPandas()
    library = Tokenizer.from_str(common.tokenizer_json())
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    cells = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object)
    have = [tuple(None if x != x or x is None else int(x) for x in r) for r in cells.itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert s.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(table(spark, [])).count() == 0


def test_a_file_of_another_kind_is_refused():
    import json

    import pytest

    packing.check(common.tokenizer_json())
    model = json.loads(common.tokenizer_json())
    for part, other in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "Lowercase"})):
        with pytest.raises(ValueError):
            packing.check(json.dumps(model | {part: other}))


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), (None, "z")], "doc_id string, text string")
    assert sorted(r["doc_id"] or "" for r in packing.pack(docs).collect()) == ["", "a", "b"]
