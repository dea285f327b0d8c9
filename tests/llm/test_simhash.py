import random

import numpy as np
import xxhash
from keyfold.llm import simhash
from tests.llm.helpers import awkward, table


def plain(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, budget=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_the_plain_one():
    for _, t in awkward():
        if len(t or "") < 50_000:
            assert simhash.fingerprint(t) == plain(t)


def near(rng, n, groups=5):
    base = [rng.getrandbits(64) for _ in range(groups)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_join_finds_every_class():
    rng = random.Random(3)
    for step in (8, 1 << 18):
        values = near(rng, 250)
        got = simhash.trie_join(np.zeros(250, np.int64), np.array(values, np.uint64), 64, step=step)
        assert got.tolist() == classes(values)


def test_layout_grows_with_the_rows():
    assert simhash.layout(1000) == (5, 1)
    b, m = simhash.layout(10**10)
    assert b - m == 4 and 10**10 >> (64 * m // b) < 2 * simhash.AIM
    assert sum(w for _, w in simhash.blocks(b)) == 64


def test_links_with_split_buckets(spark):
    rng = random.Random(4)
    values = near(rng, 150, groups=2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(signed, range(150))), "fp long, rep long")
    from keyfold.llm.common import components

    for rows in (10, 20_000):
        found = {r["node"]: r["component"] for r in components(simhash.links(nodes, bucket_rows=rows)).collect()}
        assert [found.get(i, i) for i in range(150)] == classes(values)


def test_components_of_paths_stars_and_rings(spark):
    from keyfold.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_awkward_rows(spark):
    rows = awkward()
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = classes(prints)
    want = []
    for (i, _), p, r in zip(rows, prints, root):
        want.append((i, f"{p:016x}", min(x for (x, _), s in zip(rows, root) if s == r and x is not None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "quite other words stand here now"), (None, "a b c d e f")]
    left = simhash.keep_one(table(spark, rows))
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 2, 9]
    assert left.columns == table(spark, []).columns


def test_keep_one_decides_each_row_of_an_id_that_repeats(spark):
    from tests.llm.helpers import sentence

    rng = random.Random(12)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    rows = [(0, a), (1, a), (1, b), (2, c), (2, d), (2, c), (3, d), (None, a), (None, a)]
    kept = simhash.keep_one(table(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, a), (1, b), (2, c), (2, d), (None, a), (None, a)], key=str)
    assert kept.columns == table(spark, []).columns


def test_rows_without_an_id_link_others(spark):
    prints = [(1, 0x00), (None, 0x0F), (2, 0xFF), (7, 1 << 40), (None, 0xFFFF << 48)]
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "id long, fp long")
    got = {r["fp"] % (1 << 64): r["first"] for r in simhash.classes(rows).collect()}
    root = classes([p for _, p in prints])
    assert got == {p: min((i for (i, _), s in zip(prints, root, strict=True) if s == r and i is not None), default=None) for (_, p), r in zip(prints, root, strict=True)}
    assert got[0] == got[0x0F] == got[0xFF] == 1 and got[0xFFFF << 48] is None


def test_ids_of_text(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f"), ("c", "quite other words stand here now"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"]) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert sorted(r["doc_id"] or "" for r in simhash.keep_one(docs).collect()) == ["", "a", "c"]
