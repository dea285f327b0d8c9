"""SimHash near-duplicates: a binary-trie self-join under a Hamming budget, then connected components.

A text's fingerprint has a bit where more than half of its shingles' XXH64 values have it.  Equal fingerprints are
one node, however many rows carry them.  Two fingerprints within `budget` bits agree on at least m of b blocks of
bits if b - m = budget, so the distinct ones meet in the buckets of every choice of m blocks.  In a bucket, the trie of
the other bits is joined with itself: node pairs are walked together, the differing bits of their paths are summed,
and a pair is left as soon as the sum exceeds the budget.  Pairs of nodes that lie in one component already are left
too, so a dense group costs no quadratic output; a bucket yields a spanning forest.

Null and empty texts have no shingle and fingerprint zero, which links like any other.  Rows with a null id link like all others and
take the class of their fingerprint; a class of such rows alone has no smallest id, and null for it.  Ids may be of any type with an order.  Repeated rows give repeated rows; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

SEED = 42
BUDGET = 4
#: A bucket is joined in one task up to so many fingerprints; larger ones are cut into chunks that meet pairwise.
BUCKET = 20_000
#: The number of blocks grows until a bucket of random fingerprints has fewer than so many.
AIM = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = n - shingle + 1
    cuts = map(slice, starts[:last].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def layout(distinct: int, budget: int = BUDGET) -> tuple[int, int]:
    """(b, m): blocks, and how many of them must agree, for so many distinct fingerprints."""
    m = 1
    while m < 6 and distinct >> (64 * m // (m + budget)) >= AIM:
        m += 1
    return m + budget, m


def blocks(b: int) -> list[tuple[int, int]]:
    """(shift, width) of b nearly equal blocks of 64 bits."""
    edges = [64 * i // b for i in range(b + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(b)]


def _pack(x: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for shift, width in parts:
        out = out << np.uint64(width) | x >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out


def roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs (u, v)."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label[u], label[v]):
            return label


def trie_join(bucket: np.ndarray, rest: np.ndarray, bits: int, budget: int = BUDGET, step: int = 1 << 18) -> np.ndarray:
    """Component (as smallest index) of each row; rows are sorted by (bucket, rest) and link within a bucket.

    A trie node is a range of rows and a depth.  A split at depth d is read off a running count of that bit.  The
    stack holds blocks of at most about `step` node pairs, so memory does not grow with the number of pairs.
    """
    n = len(rest)
    if n < 2:
        return np.arange(n)
    near = (bucket[1:] == bucket[:-1]) & (np.bitwise_count(rest[1:] ^ rest[:-1]) <= budget)
    label = roots(n, np.flatnonzero(near) + 1, np.flatnonzero(near))
    ones: dict[int, np.ndarray] = {}

    def cut(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum(rest >> np.uint64(bits - 1 - d) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[d][hi] - ones[d][lo])

    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    stack = [(0, starts[i : i + step], ends[i : i + step], starts[i : i + step], ends[i : i + step], np.zeros(len(starts[i : i + step]), np.int8)) for i in range(0, len(starts), step)]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        done = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        small = ~done & ((ah - al) * (bh - bl) <= 16) | ~done & (d == bits)
        if small.any():
            sa, sb = (ah - al)[small], (bh - bl)[small]
            size = sa * sb
            at = np.repeat(np.arange(len(size)), size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = al[small][at] + inner // sb[at], bl[small][at] + inner % sb[at]
            ok = (i != j) & (np.bitwise_count(rest[i] ^ rest[j]) <= budget)
            if ok.any():
                label = roots(n, i[ok], j[ok], label)
        go = ~(done | small)
        if not go.any():
            continue
        al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        ac, bc = cut(al, ah, d), cut(bl, bh, d)
        same = al == bl
        pairs = [(al, ac, bl, bc, err), (ac, ah, bc, bh, err), (al, ac, bc, bh, err + 1)]
        cross = ~same
        pairs.append((ac[cross], ah[cross], bl[cross], bc[cross], err[cross] + 1))
        nxt = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        nxt = [x[keep] for x in nxt]
        stack += [(d + 1, *(x[i : i + step] for x in nxt)) for i in range(0, len(nxt[0]), step)]
    return label


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    common.ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def links(nodes: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET) -> DataFrame:
    """Spanning links (u, v) between the representatives of fingerprints within the budget; nodes: (fp, rep), fp distinct."""
    b, m = layout(nodes.count(), budget)
    parts = blocks(b)
    chosen = list(combinations(range(b), m))

    def key(k: int):
        cols = [F.shiftrightunsigned(F.col("fp"), s).bitwiseAND((1 << w) - 1) for s, w in (parts[i] for i in chosen[k])]
        return F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *cols).alias("bucket"))

    keyed = nodes.select("fp", "rep", F.explode(F.array(*map(key, range(len(chosen)))).alias("x")).alias("x")).select("x.*", "fp", "rep")
    hot = keyed.groupBy("k", "bucket").count().where(F.col("count") > bucket_rows).select("k", "bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = keyed.join(hot, ["k", "bucket"], "left")
    meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda i: (F.least(own, i) * F.col("chunks") + F.greatest(own, i)).cast("long"))
    )
    dealt = dealt.select("k", F.explode(F.array_distinct(meets)).alias("c"), "bucket", "fp", "rep").withColumn("bucket", F.xxhash64("k", "bucket", "c"))
    dealt = dealt.select("k", "bucket", "fp", "rep").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(k, bucket, fp, rep):
            for c in np.unique(k):
                rows = k == c
                others = [parts[i] for i in range(b) if i not in chosen[c]]
                bits = sum(w for _, w in others)
                rest = _pack(fp[rows].view(np.uint64), others)
                order = np.lexsort((rest, bucket[rows]))
                label = trie_join(bucket[rows][order], rest[order], bits, budget)
                own = rep[rows][order]
                low = own.copy()
                np.minimum.at(low, label, own)
                top = low[label]
                far = top != own
                if far.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(top[far])], ["u", "v"])

        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < 100_000:
                continue
            whole = int(np.searchsorted(held[1], held[1][-1]))  # the last bucket may go on
            if whole:
                yield from joined(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield from joined(*held)

    return dealt.mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, class, first) of every distinct fingerprint: its component, as a fingerprint, and the smallest id of the component; prints: (id, fp)."""
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    found = common.components(links(nodes.select("fp", F.col("fp").alias("rep")), budget))
    of = common.materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("class")), "classes")
    first = of.groupBy("class").agg(F.min("low").alias("first"))
    return common.materialize(of.join(first, "class").select("fp", "class", "first"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = BUDGET) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id: the smallest id reachable over links."""
    prints = common.materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    out = prints.join(classes(prints, budget), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = BUDGET) -> DataFrame:
    """A row of docs, with all its columns, for each component of fingerprints: one with the smallest id.

    Fingerprints, not ids, are the nodes here, so that rows of one id with unrelated texts are decided each by its own text.
    Rows with a null id stay.  Text is shuffled only if the ids to drop are too many to broadcast, or an id repeats.
    """
    prints = common.materialize(fingerprints(docs, id_col, text_col, shingle).where("id is not null"), "simhash")
    of = classes(prints, budget)
    rows = common.materialize(prints.join(of, "fp").select("id", "first"), "classes")
    again = common.materialize(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("gone")), "repeated")
    drop = rows.where("id <> first").select(F.col("id").alias("gone")).distinct()
    some = not again.isEmpty()
    drop = common.materialize(drop.union(again).distinct() if some else drop, "drop")
    left = docs.join(common.small(drop), docs[id_col] == drop["gone"], "left_anti")
    if not some:
        return left
    again = common.small(again)
    once = docs.join(again, docs[id_col] == again["gone"], "left_semi").withColumn("__key", F.xxhash64(id_col, text_col))
    keys = common.materialize(fingerprints(once, "__key", text_col, shingle).distinct(), "keys").join(of, "fp").select(F.col("id").alias("__key"), F.col("class").alias("__class"), F.col("first").alias("__first"))
    once = once.join(keys, "__key").where(F.col(id_col) == F.col("__first")).dropDuplicates(["__class"]).select(*docs.columns)
    return left.unionByName(once)
