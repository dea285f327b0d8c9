"""Packing documents into sequences by minimum bin slack.

Every text is tokenised and ended with one id.  Documents longer than `capacity` are cut into full pieces behind a
first, shorter one.  What the packing depends on is only how many pieces there are of each length, at most `capacity` counts:

1. The pieces are written with their length, the task that made them and their rank among that task's pieces of that length.
2. The counts by length go to the driver.  Bin by bin, the longest length left is laid and a bitset subset-sum over the
   other lengths left finds the fullest feasible combination.  That combination is laid as many times as all its lengths
   allow, and so removed; each run of bins is a few slots (length, ranks, first sequence, offset).
3. Ranks within a task become ranks in the corpus by running sums over (task, length) counts, which a shuffled join brings to the pieces (some
   tens of bytes each), and the slots, searched by length and rank, give each piece its sequence and offset.

The slots' number depends on the lengths, not on the documents; pieces of a frequent length stay spread over the tasks.

Null and empty texts are a document of just the end id.  Ids may be null, repeat and be of any type; every row is packed.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import common, token_count

CAPACITY = 2048
END_ID = 0


def encoder(tokenizer: str):
    """Text -> array of ids, as the tokenizers library gives them for the same file (special strings included), several times as fast."""
    import tiktoken

    model = json.loads(tokenizer)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    byte = {c: b for b, c in token_count.byte_alphabet().items()}
    ranks = {bytes(map(byte.__getitem__, s)): i for s, i in model["model"]["vocab"].items() if s not in special}
    coder = tiktoken.Encoding("file", pat_str=token_count.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    every = set(special)
    return lambda text: coder.encode_to_numpy(text, allowed_special=every)


#: What both libraries must agree on before any text is encoded: contractions, numbers, accents, symbols, white space, special strings.
PROBE = "It's we'll 12345 3.14 naïve ÉCOLE Straße 漢字かな \U0001f600 ²½Ⅷ ٣ \u0301x \u200b<|endoftext|> <s></s> a  b\n\n c\t\r\n  \x0b\x1c\x85\u3000 <|im_start|>don't 'S _x_ --- ...!?"


def check(tokenizer: str) -> None:
    """An error if encoder() gives other ids than the tokenizers library for the same file: another pattern, normalizer or merge order."""
    from tokenizers import Tokenizer

    want = Tokenizer.from_str(tokenizer).encode(PROBE, add_special_tokens=False).ids
    if encoder(tokenizer)(PROBE).tolist() != want:
        raise ValueError("the tokenizer file asks for another encoding than byte-level pair merging with the usual pattern")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def fullest(left: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of what is left that fills room as far as any does.

    Bit s of the bitset: sum s can be reached with the lengths so far; copies are added by doubling.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    steps = []
    for length in order:
        copies = min(left[length], room // length)
        if copies <= 0:
            continue
        steps.append((length, copies, reach))
        take = 1
        while copies:
            reach |= reach << length * min(take, copies)
            copies -= min(take, copies)
            take *= 2
        reach &= full
        if reach >> room:
            break
    at = reach.bit_length() - 1
    out = []
    for length, copies, before in reversed(steps):
        n = next(n for n in range(copies + 1) if at >= n * length and before >> (at - n * length) & 1)
        if n:
            out.append((length, n))
            at -= n * length
    return out


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots as rows (length, first rank, copies, first sequence, offset), sorted by length and rank; and the number of sequences."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots, sequences = [], 0
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1
        bin_ = [(longest, 1), *fullest(left, order, capacity - longest)]
        left[longest] += 1
        need: dict[int, int] = {}
        for length, n in bin_:
            need[length] = need.get(length, 0) + n
        times = min(left[length] // n for length, n in need.items())
        offset = 0
        for length, n in need.items():
            for _ in range(n):
                slots.append((length, used[length], times, sequences, offset))
                used[length] += times
                offset += length
            left[length] -= times * n
        sequences += times
        order = [n for n in order if left[n]]
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str | None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): one row for each piece."""
    spark = docs.sparkSession
    common.ship(spark)
    file = common.tokenizer_json(tokenizer_path)
    check(file)
    model = spark.sparkContext.broadcast(file)  # the file's size, whatever the input
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        ids_of = encoder(model.value)
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(ids_of(t.as_py() or ""), END_ID).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    made = common.materialize(pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    counts = common.materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = minimum_slack(total, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(ranks.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    table = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        order = s[:, 0] << 44 | s[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(order, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[at, 3] + rank - s[at, 1]), pa.array(s[at, 4])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = made.schema["id"].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
