"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding maps every character to one letter or a space: case, homoglyphs and digit substitutions (for whole words accents, too) fall
together, all else separates words; invisible characters vanish.  A lexicon entry is matched at the start of a word; one that ends
in a space is a whole word.  Overlapping matches count once, the longest first; matches inside an exception phrase do not
count.  The score is a logistic function of the matched weight and of its density per word.

learn() starts from a seed lexicon and adds words and word stems (of 3 to 12 letters) that a bounded sample of labelled ids (`sample` ids of each label, lowest hashes
first) shows to go with the label: significant by likelihood ratio, no longer than needed, no shorter than is as frequent.  An id with both
labels teaches nothing; of several texts of one id, that with the lowest hash is learnt from.

Null and empty texts match nothing and get the score of weight 0.  Without labelled rows of both kinds the seed and default
coefficients are used.  Ids may be null or repeat: every row is scored.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

SAMPLE = 4_000
LEAST_WEIGHT = 1.5
#: Insults that start the lexicon, and phrases that excuse a match inside them.
SEED = "idiot moron stupid trash worthless pathetic disgusting scum loser clown imbecile dumbass bastard bitch asshole fucker fucking shithead retard vermin".split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "stupid question")
#: Characters that stand for a Latin letter, letter for letter.
LOOKALIKES = dict(zip("авсԁеһіјкӏмнорԛѕтԝхугαβεικνορτυχωɑɡıℓ", "abcdehijklmhopqstwxyraβeiknoptuxwagil", strict=True))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas", strict=True))
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]")


class Folding(dict):
    """Code point -> letter or space, found out once for each character; accents of Latin letters stay or go."""

    def __init__(self, accents: bool):
        self.accents = accents

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()[0]
        c = SUBSTITUTES.get(c) or LOOKALIKES.get(c) or c
        if not (self.accents and 0xC0 <= ord(c) <= 0x24F):
            c = unicodedata.normalize("NFKD", c)[0].lower()[0]
        self[point] = out = LOOKALIKES.get(c, c) if c.isalpha() else " "
        return out


_folding, _bare = Folding(True), Folding(False)


def fold(text: str, accents: bool = True) -> str:
    """The folded text between two spaces; without invisible characters one place further than the original."""
    return f" {text.translate(_folding if accents else _bare)} "


@dataclass
class Model:
    """Entries are folded and begin with a space; coefficients: of 1, log1p(weight) and log1p(1000 * weight per word)."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-4.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._automaton.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._automaton.add_word(fold(e), (len(e) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, weight) in a text without invisible characters.

        Whole words also match with their accents off.
        """
        if not self.entries:
            return []
        folded = fold(text)
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton().iter(folded)]
        if not text.isascii():
            bare = fold(text, accents=False)
            found += [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton().iter(bare) if bare[end] == " "]
        excused = [(a, b) for a, b, w in found if w is None]
        kept, until = [], -1
        for a, b, w in sorted((x for x in found if x[2] is not None), key=lambda x: (x[0], -x[1])):
            if a >= until and not any(s <= a and b <= e for s, e in excused):
                until = b - (folded[b - 1] == " ")
                kept.append((a, until - 1, w))
        return kept

    def features(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Weight, words, matches with offsets in the original text."""
        text = text or ""
        words = len(text.split())
        if not text.isascii() and INVISIBLE.search(text):
            at = [i for i, c in enumerate(text) if not INVISIBLE.match(c)]
            found = [(at[a], at[b - 1] + 1, w) for a, b, w in self.matches("".join(text[i] for i in at))]
        else:
            found = self.matches(text)
        return sum(w for *_, w in found), words, found

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.coefficients
        z = a + b * math.log1p(weight) + c * math.log1p(1000 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def seed_model() -> Model:
    return Model({f" {w} ": 4.0 for w in SEED})


def stems(text: str) -> dict[str, float]:
    """What may become an entry, with its damped number of occurrences: the beginnings, 3 to 12 letters long, of the folded words, and the words."""
    out: Counter[str] = Counter()
    for w, n in Counter(fold(text).split()).items():
        for k in range(3, min(len(w), 12) + 1):
            out[" " + w[:k]] += n
        if len(w) >= 3:
            out[f" {w} "] += n
    return {k: 1 + math.log(n) for k, n in out.items()}


def least_gain(candidates: int) -> float:
    """What the likelihood ratio test must reach where so many stems are tried."""
    return 2 * math.log(max(candidates, 2)) + 6


def choose(rows: Iterable[tuple[str, int, int, float, float]], positive: int, negative: int, candidates: int) -> dict[str, float]:
    """Entries and weights from (stem, documents with label 1, with label 0, damped occurrences in the former, in the latter).

    A weight is the logarithm of the ratio of occurrences per document; whether a stem goes with the label is tested by documents.
    """
    seen = {s: x for s, *x in rows}
    least = least_gain(candidates)
    prior = positive / (positive + negative)

    def gain(p: int, n: int) -> float:
        def part(x: float, y: float) -> float:
            return x * math.log(x / y) if x else 0.0

        t = p + n
        return 2 * (part(p, t * prior) + part(n, t * (1 - prior)) + part(positive - p, (positive + negative - t) * prior) + part(negative - n, (positive + negative - t) * (1 - prior)))

    good = {s: math.log((po + 0.5) / positive) - math.log((no + 0.5) / negative) for s, (p, n, po, no) in seen.items() if p / positive > n / negative and gain(p, n) >= least}
    good = {s: w for s, w in good.items() if w >= LEAST_WEIGHT}
    longer: dict[str, float] = {}
    for s in good:  # the share of a stem's occurrences that its most frequent extension has
        shorter = s[:-1]
        if shorter in good:
            longer[shorter] = max(longer.get(shorter, 0), seen[s][2] / seen[shorter][2])
    out: dict[str, float] = {}
    for s in sorted(good, key=len):
        above = [s[:k] for k in range(4, len(s)) if s[:k] in out]
        if longer.get(s, 0) < 0.9 and not any(out[a] >= good[s] - 1.0 for a in above):
            out[s] = good[s]
    return out


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, with the label weighing `prior` of the whole."""
    a = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (a.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (share * p * (1 - p))[:, None]).T @ a / len(y) + ridge
        step = np.linalg.solve(h, a.T @ (share * (y - p)) / len(y) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from labels (id, toxic); the sample's ids, its best stems and its weights are what reaches the driver."""
    common.ship(docs.sparkSession)
    model = seed_model()
    known = labels.select(F.col("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = [common.lowest(known.where(F.col("toxic") == t), F.xxhash64("id"), sample, of.get(t, 0)) for t in (0, 1)]
    some = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(taken[0].union(taken[1])), "id")
    some = some.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("toxic").alias("toxic"))  # one row for each id, 2 * sample at most
    some = common.materialize(some, "toxic-sample")
    n = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return model
    prior = of[1] / (of[0] + of[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        times: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                s = stems(t.as_py() or "")
                found[y].update(s.keys())
                times[y].update(s)
        both = list(found[0].keys() | found[1].keys())
        cols = [(found[1], pa.int64()), (found[0], pa.int64()), (times[1], pa.float64()), (times[0], pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[s] for s in both], t) for c, t in cols)], ["stem", "p", "n", "po", "no"])

    counts = some.mapInArrow(count, "stem string, p long, n long, po double, no double").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("p", "n", "po", "no")))
    counts = common.materialize(counts, "stems")
    rate = (F.col("po") + 0.5) / n[1] >= math.exp(LEAST_WEIGHT) * (F.col("no") + 0.5) / n[0]
    prior_, total, candidates = n[1] / (n[0] + n[1]), n[0] + n[1], counts.count()

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)

    p, t = F.col("p"), F.col("p") + F.col("n")
    gain = 2 * (part(p, t * prior_) + part(F.col("n"), t * (1 - prior_)) + part(n[1] - p, (total - t) * prior_) + part(n[0] - F.col("n"), (total - t) * (1 - prior_)))
    best = counts.where(rate & (gain >= 0.99 * least_gain(candidates))).collect()  # significant ones alone: hundreds of the stems of 2 * sample texts
    for stem, w in choose(sorted(map(tuple, best)), n[1], n[0], candidates).items():
        model.entries[stem] = w

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.features(t.as_py())[:2] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.int64()), b.column(2)], ["w", "n", "y"])

    rows = some.mapInArrow(weigh, "w double, n long, y int").collect()
    w, words, y = (np.array(c, float) for c in zip(*sorted(map(tuple, rows)), strict=True))
    model.coefficients = fit(np.column_stack([np.log1p(w), np.log1p(1000 * w / np.maximum(words, 1))]), y, prior)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, weight, n_words, matches) of every row: a narrow map; matches: [(start, stop, weight)] in code points."""
    common.ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.features(t.as_py()) for t in b.column(1)]
            found = [[{"start": a, "stop": z, "weight": w} for a, z, w in x[2]] for x in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.score(x[0], x[1]) for x in f], pa.float64()), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.int64()), pa.array(found, pa.list_(span))],
                ["id", "score", "weight", "n_words", "matches"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, weight double, n_words long, matches array<struct<start:int,stop:int,weight:double>>").withColumnRenamed("id", id_col)


def drop(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score less than threshold: a narrow filter."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(*model.features(t.as_py())[:2]) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
