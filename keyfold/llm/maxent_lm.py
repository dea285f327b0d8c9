"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are the words of the text with A-Z lower-cased, then an end token.  Training tokens are counted over the whole corpus.  A class has 64
members: the `HEAD` most frequent tokens fill classes by rank, and the members of the 32 tail classes are buckets of all other words, by a hash of
their last three bytes.  The model is P(token) = P(class | context) * P(member | class, context) * P(token | member):

* P(class | context) is a softmax whose logits add a row for the previous token, one for the hashed pair of the two before, and one
  for the token before the previous one (a skip feature) to the class's log frequency.
* P(member | class, context) is a softmax of the member's log frequency plus a hashed row of (class, previous token).
* P(token | member) is 1 for a frequent token, and (count + 1) / (tokens + words + 1) within a bucket, so that every word, seen or not, has its share.

Training makes one pass over all training documents in `ROUNDS` rounds of distinct documents.  In a round each task starts from the
broadcast parameters and takes row-wise adaptive gradient steps over its documents; the tasks' changes are averaged per row,
weighted by how often each task used the row, in two shuffled levels (as many groups of tasks as there are tasks in one).  Parameters have a fixed
size; what is shuffled grows with the number of tasks, that is with the corpus.  How the corpus is dealt to tasks is part of the training: the same rows
dealt otherwise give a slightly different model.

Texts are read twice: to count words, and to write a coded table with two bytes a token, which training and scoring read.
The most frequent tokens, `KNOWN` at most, and their counts go to all tasks; occurrences of the rest, of which none is frequent, are joined
with the counts by shuffle.  The base score is the add-one unigram's.

Null and empty texts are one end token.  Rows with a null id are scored, but not learnt from where the caller's condition on the id is null.  Repeated rows
get equal scores.  Without training rows all counts are 0.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

WIDTH = 64
HEAD = 2048
TAILS = 32
BUCKETS = TAILS * WIDTH
KNOWN = 1 << 16
ROUNDS = 3
BATCH = 8192
RATE = 0.15
REMEMBERED = 300_000

_START = HEAD + BUCKETS  # the context before a text
_CLASSES = HEAD // WIDTH + TAILS
_BIGRAM, _PAIR, _SKIP, _WITHIN = 4608, 8192, 4608, 256
#: First rows of the four tables in the parameters.
_AT = (0, _BIGRAM, _BIGRAM + _PAIR, _BIGRAM + _PAIR + _SKIP)
ROWS = _AT[3] + _CLASSES * _WITHIN
BLOCK = 512


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8; none for null.  These methods of bytes know only ASCII."""
    return (text or "").encode().lower().split()


def suffix_hash(word: bytes) -> int:
    return zlib.crc32(word[-3:])


@dataclass
class Counts:
    """words, counts: the known tokens, most frequent first, without the end token; tails: (tokens, words) of each bucket."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    tails: np.ndarray


class Coder:
    """Text -> codes: the rank of a known word, KNOWN + suffix bucket of any other."""

    def __init__(self, counts: Counts):
        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                code = KNOWN + suffix_hash(word) % BUCKETS
                if len(self) < KNOWN + REMEMBERED:
                    self[word] = code
                return code

        self.codes = Codes(zip(counts.words, range(KNOWN), strict=False))
        place = np.array([suffix_hash(w) % BUCKETS for w in counts.words] + [0] * (KNOWN - len(counts.words)), np.int64)
        #: Code -> context: 1.. for words of the head, then buckets.
        self.context = np.concatenate([HEAD + place, HEAD + np.arange(BUCKETS)])
        head = min(HEAD - 1, len(counts.words))
        self.context[:head] = np.arange(1, head + 1)
        self.log_count = np.concatenate([np.log10(counts.counts + 1.0), np.zeros(KNOWN - len(counts.words) + BUCKETS)])

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, one before, two before, document) of all tokens of texts given as contexts; the end token is 0."""
    start, end = np.array([_START, _START], np.int64), np.array([0], np.int64)
    flat = np.concatenate([x for t in texts for x in (start, t, end)])
    size = np.array([len(t) + 3 for t in texts])
    first = np.cumsum(size) - size
    real = np.ones(len(flat), bool)
    real[first] = real[first + 1] = False
    at = np.flatnonzero(real)
    return flat[at], flat[at - 1], flat[at - 2], np.repeat(np.arange(len(texts)), size)[at]


def features(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the previous token, of the hashed pair, and of the token before the previous."""
    pair = ((one * 4099 + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
    return one + _AT[0], pair.astype(np.int64) + _AT[1], two + _AT[2]


def within(cls: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _AT[3] + cls * _WITHIN + (one * 0x9E3779B1 >> 7) % _WITHIN


class Model:
    """The trained rows; those of the previous token start from the classes' log frequencies, those within a class from its members'."""

    def __init__(self, counts: Counts):
        head = np.zeros(HEAD)
        head[0] = counts.ends
        n = min(HEAD - 1, len(counts.words))
        head[1 : n + 1] = counts.counts[:n]
        members = np.concatenate([head, counts.tails[:, 0]]).reshape(_CLASSES, WIDTH)
        by_class = members.sum(axis=1)
        self.tail_log10 = np.log10(counts.tails.sum(axis=1) + 1.0)
        self.rows = np.zeros((ROWS, WIDTH), np.float32)
        self.rows[_AT[0] : _AT[1]] = np.log((by_class + 1) / (by_class.sum() + _CLASSES))
        self.rows[_AT[3] :] = np.repeat(np.log((members + 0.5) / max(counts.tokens, 1)), _WITHIN, axis=0)

    def classes(self, f: tuple[np.ndarray, ...]) -> np.ndarray:
        """Logits of the classes."""
        z = _take(self.rows, f[0])
        z += _take(self.rows, f[1])
        z += _take(self.rows, f[2])
        return z

    def members(self, rows: np.ndarray) -> np.ndarray:
        """Logits of a class's members."""
        return _take(self.rows, rows)

    def log10(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of each token, for words in buckets less log10(count + 1)."""
        out = np.empty(len(token))
        for a in range(0, len(token), BATCH):
            t, o, w = token[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            cls = t // WIDTH
            p = _log_picked(self.classes(features(o, w)), cls)
            p += _log_picked(self.members(within(cls, o)), t % WIDTH)
            tail = np.where(t < HEAD, 0.0, self.tail_log10[np.maximum(t - HEAD, 0)])
            out[a : a + BATCH] = p / math.log(10) - tail
        return out


def _take(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.take(table, rows, axis=0, mode="clip")  # all rows are in range; clipping is the fast mode


def _less_softmax(z: np.ndarray) -> np.ndarray:
    """Minus the softmax, in place; logits beyond +-60 are taken as that."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z *= (-1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def _sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of g's rows over groups: n[i] rows from order[first[i]] on; short groups, which most are, are added row by row."""
    total = np.empty((len(n), g.shape[1]), g.dtype)
    few = np.flatnonzero(n <= 4)
    part = _take(g, order[first[few]])
    for k in range(1, 4):
        more = np.flatnonzero(n[few] > k)
        part[more] += _take(g, order[first[few[more]] + k])
    total[few] = part
    many = np.flatnonzero(n > 4)
    if len(many):
        rows = _take(g, order[np.repeat(n > 4, n)]).view(np.complex64)  # two columns at a time
        total[many] = np.add.reduceat(rows, np.cumsum(n[many]) - n[many], axis=0).view(g.dtype)
    return total


def _log_picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of z, clipped likewise, at one place of each row, without going through probabilities too small to hold; z is overwritten."""
    np.clip(z, -60, 60, out=z)
    picked = z[np.arange(len(z)), at].astype(float)
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype))


class Learner:
    """Row-wise adaptive gradient steps on a task's own copy of the rows; `used` counts the tokens behind each row's changes."""

    def __init__(self, model: Model):
        self.model, self.start = model, model.rows
        model.rows = model.rows.copy()
        self.square = np.zeros(ROWS, np.float32)
        self.used = np.zeros(ROWS, np.float32)

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        cls = token // WIDTH
        f = features(one, two)
        g = _less_softmax(m.classes(f))
        g[np.arange(len(token)), cls] += 1
        r = within(cls, one)
        gw = _less_softmax(m.members(r))
        gw[np.arange(len(token)), token % WIDTH] += 1
        for rows in f:
            self._apply(rows, g)
        self._apply(r, gw)

    def _apply(self, rows: np.ndarray, g: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # ROWS < 2^16: a radix sort
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        which = sorted_rows[first]
        n = np.diff(np.append(first, len(rows)))
        total = _sums(g, order, first, n)
        self.used[which] += n
        self.square[which] += np.einsum("ij,ij->i", total, total)
        total *= (RATE / np.sqrt(self.square[which] / 4 + 1.0))[:, None]
        self.model.rows[which] += total

    def change(self) -> np.ndarray:
        return self.model.rows - self.start


def count_tokens(train: DataFrame, text_col: str, held: int = 400_000) -> tuple[DataFrame, Counts]:
    """The table (word, c) and what of it, of bounded size, all tasks get; a task holds up to about `held` words before it passes them on."""
    spark = train.sparkSession
    common.ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                found.update(words_of(t.as_py()))
                if len(found) > held:
                    yield out()
                    found.clear()
        yield out()

    table = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    table = common.materialize(table, "words")
    bucket = F.floor(F.log2("c") * 16)
    least, n = 1 << 20, 0
    for r in table.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():  # 16 buckets for each power of two
        if n + r["n"] > KNOWN:
            break
        least, n = r["b"], n + r["n"]
    known = sorted(table.where(bucket >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))  # KNOWN words at most
    words = [bytes(r["word"]) for r in known]
    head = spark.createDataFrame(pa.table({"word": pa.array(words[: HEAD - 1], pa.binary())}))
    of = F.crc32(F.substring(F.col("word"), -3, 3)) % BUCKETS
    stats = table.join(F.broadcast(head), "word", "left_anti").groupBy(of.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tails = np.zeros((BUCKETS, 2))
    for r in stats:
        tails[r["k"]] = r["n"], r["v"]
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    return table, Counts(words, np.array([r["c"] for r in known], float), ends, total["n"] + ends, total["v"] + (ends > 0), tails)


def code(docs: DataFrame, counts: Counts, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """The coded table: id, row, learn, tokens, ids (two bytes a word), and over the known tokens their number and sums of log10(count + 1), and the other words."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(counts)
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(known.value)
        sure_end, log_end = int(known.value.ends > 0), math.log10(known.value.ends + 1)
        for b in (x.slice(a, 1000) for x in batches for a in range(0, x.num_rows, 1000)):
            n, ids, sure, log, tail, rare = [], [], [], [], [], []
            for t in b.column(3):
                words = words_of(t.as_py())
                codes = coder(words)
                context, logs = coder.context[codes], coder.log_count[codes]
                other = np.flatnonzero(codes >= KNOWN).tolist()
                n.append(len(words) + 1)
                ids.append(context.astype(np.uint16).tobytes())
                sure.append(len(words) - len(other) + sure_end)
                log.append(float(logs.sum()) + log_end)
                tail.append(float(logs[context >= HEAD].sum()))
                rare.append([words[i] for i in other])
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sure, pa.int64()), pa.array(log, pa.float64()), pa.array(tail, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["id", "row", "learn", "n", "ids", "sure", "log", "tail", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    return common.materialize(rows.mapInArrow(run, f"id {kind}, row long, learn boolean, n long, ids binary, sure long, log double, tail double, rare array<binary>"), "coded")


def _texts(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint16).astype(np.int64) for t in ids]


def fit(coded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """The model after all rounds over the rows to learn from."""
    spark = coded.sparkSession
    model = Model(counts)
    groups = max(16, math.isqrt(coded.rdd.getNumPartitions()))  # of tasks, whose changes are averaged before those of all are
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def local(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            learner = Learner(now.value)
            part = TaskContext.get().partitionId()
            held, n = [], 0
            for b in batches:
                for t in _texts(b.column(0)):
                    held.append(t)
                    n += len(t) + 1
                    if n >= 16 * BATCH:
                        _walk(held, learner)
                        held, n = [], 0
            if held:
                _walk(held, learner)
            change, used = learner.change().astype(np.float16), learner.used
            blocks = [a for a in range(0, ROWS, BLOCK) if used[a : a + BLOCK].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blocks), pa.int64()), pa.array(blocks, pa.int32()), pa.array([change[a : a + BLOCK].tobytes() for a in blocks], pa.binary()), pa.array([used[a : a + BLOCK].tobytes() for a in blocks], pa.binary())],
                ["part", "block", "change", "used"],
            )

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for block, change, used in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    n = np.frombuffer(used, np.float32)
                    t = total.setdefault(block, [np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK)])
                    t[0] += np.frombuffer(change, np.float16).reshape(BLOCK, WIDTH) * n[:, None]
                    t[1] += n
            out = [(block, (c / np.maximum(n, 1)[:, None]).astype(np.float16).tobytes(), n.astype(np.float32).tobytes()) for block, (c, n) in sorted(total.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["part", "block", "change", "used"]
            )

        kind = "part long, block int, change binary, used binary"
        docs = coded.where(F.col("learn") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)).select("ids")
        changes = docs.mapInArrow(local, kind).withColumn("part", F.col("part") % groups)
        merged = changes.repartition("part", "block").mapInArrow(merge, kind).repartition("block").mapInArrow(merge, kind)
        rows = model.rows.copy()
        for r in merged.collect():  # ROWS rows at most
            rows[r["block"] : r["block"] + BLOCK] += np.frombuffer(r["change"], np.float16).reshape(BLOCK, WIDTH)
        model.rows = rows
        now.unpersist()
    return model


def _walk(texts: list[np.ndarray], learner: Learner) -> None:
    token, one, two, _ = contexts(texts)
    for a in range(0, len(token), BATCH):
        learner.step(token[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH])


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; learn: which rows to learn from."""
    spark = docs.sparkSession
    table, counts = count_tokens(docs.where(learn), text_col)
    coded = code(docs, counts, id_col, text_col, learn)
    model = spark.sparkContext.broadcast(fit(coded, counts, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[np.ndarray] = []
            held: list[np.ndarray] = []

            def flush() -> None:
                token, one, two, own = contexts(held)  # noqa: B023
                parts.append(np.bincount(own, model.value.log10(token, one, two)))  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for t in _texts(b.column(5)):
                held.append(t)
                size += len(t)
                if size >= 16 * BATCH:
                    flush()
                    size = 0
            if held:
                flush()
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p, pa.float64())], ["id", "row", "n", "sure", "log", "p"])

    kind = coded.schema["id"].dataType.simpleString()
    found = coded.select("id", "row", "n", "sure", "log", "ids", "tail")
    found = found.select("id", "row", "n", "sure", (F.struct("log", "tail")).alias("log"), "ids").mapInArrow(run, f"id {kind}, row long, n long, sure long, log struct<log:double,tail:double>, p double")
    rare = coded.select("row", F.explode("rare").alias("word")).join(table, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("rest"))
    out = found.join(rare, "row", "left").na.fill(0, ["more", "rest"])
    base = F.col("log.log") + F.col("rest") - F.col("n") * math.log10(counts.tokens + counts.distinct + 1)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("sure") + F.col("more")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("p") + F.col("log.tail") + F.col("rest")).alias("score"))
