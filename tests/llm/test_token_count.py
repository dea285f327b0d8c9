import random

from keyfold.llm import common, token_count
from tests.llm.helpers import awkward, table
from tokenizers import Tokenizer

MODEL = common.tokenizer_json()
LIBRARY = Tokenizer.from_str(MODEL)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "'s", "'", "<|endoftext|>", "<|endof", "12", "word", "é", "漢", " ", "̀", "\U0001f600", "꟎", "\U00018e06"]
    texts = ["".join(rng.choice(parts + [chr(rng.randrange(1, 0x2FFF))]) for _ in range(rng.randrange(15))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "<|endoftext|>" * 3, ""]
    for remembered in (0, 10, 100_000):
        count = token_count.counter(MODEL, remembered)
        assert [count(t) for t in texts] == library(texts)


def test_awkward_rows(spark):
    rows = awkward()
    got = token_count.count_tokens(table(spark, rows), limit=100).collect()
    texts = [t or "" for _, t in rows]
    want = [(i, len(t.encode()), n, n > 100) for (i, _), t, n in zip(rows, texts, library(texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_count.count_tokens(table(spark, [])).count() == 0
