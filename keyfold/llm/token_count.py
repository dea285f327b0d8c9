"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are emitted.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give repeated rows, an empty table an empty result,
extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm import common

#: How the byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers the counts of; others are merged anew.
REMEMBERED = 400_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class PairMerger:
    """Counts the symbols that remain of a piece once no adjacent pair is in the merge table."""

    def __init__(self, tokenizer: str):
        model = json.loads(tokenizer)
        vocab = model["model"]["vocab"]
        alphabet = byte_alphabet()
        self.first = [vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)

    def count(self, piece: bytes) -> int:
        """Initial symbols less merges.

        An entry of the heap is rank * size + place, so the lowest rank, leftmost first, is on top; a popped pair
        counts only if it still stands there.  `after` and `before` link the symbols that are left.
        """
        n = len(piece)
        if n < 2:
            return n
        symbol = [*map(self.first.__getitem__, piece)]
        get, made = self.rank.get, self.made
        heap = [r * n + i for i, r in enumerate(map(get, zip(symbol, symbol[1:]))) if r is not None]
        if not heap:
            return n
        heapify(heap)
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        left = n
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or get((symbol[i], symbol[j])) != r:
                continue
            left -= 1
            symbol[j] = -1
            symbol[i] = new = made[r]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := get((new, symbol[k]))) is not None:
                    heappush(heap, q * n + i)
            if (h := before[i]) >= 0 and (q := get((symbol[h], new))) is not None:
                heappush(heap, q * n + h)
        return left


def unassigned() -> str:
    """A character class of the code points that Python's Unicode version has no category for."""
    import unicodedata

    ends = [i for i in range(0x110001) if (i < 0x110000 and unicodedata.category(chr(i)) == "Cn") != (0 < i and unicodedata.category(chr(i - 1)) == "Cn")]
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(ends[::2], ends[1::2], strict=True)) + "]"


def counter(tokenizer: str, remembered: int = REMEMBERED) -> Callable[[str], int]:
    """Text -> number of tokens, with the added tokens' strings taken as one token each.

    Libraries differ in their Unicode version.  Texts with a character that is new or unassigned are therefore cut
    by the tokenizers library's own pre-tokenizer; the merging is the same.
    """
    import re

    import regex
    from tokenizers import pre_tokenizers

    merger = PairMerger(tokenizer)
    cut = regex.compile(PATTERN).findall
    odd = re.compile(unassigned()).search
    slow = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    at_special = regex.compile("(" + "|".join(map(regex.escape, merger.special)) + ")") if merger.special else None

    class Counts(dict):
        def __missing__(self, word: str) -> int:
            if not word.isascii() and odd(word):
                raise KeyError(word)  # never remembered, so found in every text that has it
            n = merger.count(word.encode())
            if len(self) < remembered:
                self[word] = n
            return n

    counts = Counts()

    def plain(text: str) -> int:
        try:
            return sum(map(counts.__getitem__, cut(text)))
        except KeyError:
            return sum(merger.count(text[a:b].encode()) for _, (a, b) in slow(text))

    def tokens(text: str) -> int:
        if at_special is None or not any(s in text for s in merger.special):
            return plain(text)
        parts = at_special.split(text)
        return sum(map(plain, parts[::2])) + len(parts) // 2

    return tokens


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer_path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: a narrow map, no shuffle.  Ids may be null or repeat."""
    spark = docs.sparkSession
    common.ship(spark)
    model = spark.sparkContext.broadcast(common.tokenizer_json(tokenizer_path))  # the file's size, whatever the input
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [0 if t is None else len(t.encode()) for t in texts]
            n_tokens = [tokens(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
