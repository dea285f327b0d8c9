"""A table with every awkward row, and columns whose names clash with the operators' own."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, k1 int, w string, kept string, gone long, h int"
WORDS = [a + b for a in "ba de ki lo mu ra sti vor zen ga".split() for b in "n r st lan do ma ti us ex io".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 7, "x", 1, "y", "z", 3, 4) for r in rows], SCHEMA)


def awkward(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [sentence(rng, 60) + "\n" + sentence(rng, 30) for _ in range(8)]
    rows: list[tuple] = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, None), (21, ""), (22, "  \n\t "), (23, "x"), (24, "É à ß 漢字 \U0001f600"), (25, texts[0]), (26, texts[0])]
    rows += [(None, texts[1]), (None, None), (27, sentence(rng, 30000)), (28, "a" * 200_000), (3, texts[3]), (3, texts[3])]
    rows += [(32, "." * 200_000), (33, "AKIA" * 50_000), (34, "-1" * 100_000 + " x" + "!?" * 100_000)]
    rows += [(30, "one\x0btwo\x0cthree\rfour five six"), (31, "\0nul \x1f bytes")]
    return rows
