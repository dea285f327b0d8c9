"""Repeated lines and passages: normalise the units, group their digests over the corpus, keep the first of each, remove the rest.

Every line is a unit, whatever its length: lower case, runs of white space to one space, digested to 128 bits.  Digests are grouped over the
whole corpus with map-side combine; the earliest occurrence, by (id, hash of the text, offset), stays, all others go, each with its offsets in the
original text.  `min_line` leaves lines of fewer words alone; by default there is no such bound.

A passage that stands within longer lines has no line of its own.  Its units are marks: among the hashes of all runs of ANCHOR words, those
that are the lowest of some window of PASSAGE words.  So every such window has a mark, which depends on its words alone, and equal passages
have equal marks.  Marks are grouped like lines.  Marks of a text that stand at the same distances as at their first places are
joined to a chain, the chain is extended word by word at both ends as far as the text around the first place agrees, and goes if it has PASSAGE
words or more.  Only texts with a chain, or with a first place, are read a second time, for the words at the chains' ends.

Windows at the ends that agree with an earlier place other than the first are found by their own digests.

So, barring equal hashes of unequal words, a word goes if its line stood earlier, or if any PASSAGE words in a row around it did.

Null and empty texts have no units.  Null ids rank last.  Rows that are equal in id and text are copies of each other: all but one go
whole.  An empty table gives an empty result; other columns of the input are ignored, and kept by clean(), whose own columns
replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

#: Whole lines of fewer words than this stay.
MIN_LINE = 1
#: So many equal words in a row are found wherever they stand.
PASSAGE = 50
ANCHOR = 26
#: Words on either side of a mark that a window with it can have.
REACH = PASSAGE - ANCHOR
#: Words that are hashed together.
BLOCK = 1 << 16
LINE, MARK, TEXT = range(3)


def lines(text: str | None, min_line: int = MIN_LINE) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of each line of at least min_line words, without the white space around it."""
    at = 0
    for line in (text or "").split("\n"):
        words = line.lower().split()
        if len(words) >= max(min_line, 1):
            yield at + len(line) - len(line.lstrip()), at + len(line.rstrip()), " ".join(words)
        at += len(line) + 1


@cache
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x3002)])


def word_edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of text.split() begin and end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.ones(len(points) + 2, bool)
    space[1:-1] = _spaces()[np.minimum(points, 0x3001)]
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of so many words, modulo 2^64; base is odd."""
    n = len(h)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
    return _mixed((total[size:] - total[:-size]) * down[: n - size + 1])


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over every run of so many values, by doubling."""
    m, span = x, 1
    while 2 * span <= width:
        m, span = of(m[:-span], m[span:]), 2 * span
    return of(m[: len(m) - (width - span)], m[width - span :])


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, index of their text, place in it) of texts with a window, about BLOCK words at a time; parts of a long text overlap so that no window is lost."""
    from xxhash import xxh3_64_intdigest as digest

    held, size = [], 0
    for d, text in enumerate(texts):
        words = (text or "").lower().split()
        for a in range(0, len(words) - PASSAGE + 1, BLOCK):
            h = np.fromiter(map(digest, words[a : a + BLOCK + PASSAGE - 1]), np.uint64)
            held.append((h, np.full(len(h), d), np.arange(a, a + len(h))))
            size += len(h)
            if size >= BLOCK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def marks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, place, mark) of every run of ANCHOR words whose hash is the lowest of a window of PASSAGE words; hashes that tie are all marks."""
    for h, text, place in _blocks(texts):
        g, width, last = _rolling(h, ANCHOR), REACH + 1, PASSAGE - 1
        inside = (text[:-last] == text[last:]) & (place[last:] - place[:-last] == last)
        low = np.where(inside, _sliding(g, width, np.minimum), 0)
        beside = np.zeros(REACH, np.uint64)
        # a run is the lowest of a window if it is not above the highest of the windows' minima around it
        at = np.flatnonzero((_sliding(np.concatenate((beside, low, beside)), width, np.maximum) == g) & (g > 0))
        yield text[at], place[at], g[at].view(np.int64)


_FIELDS = [("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64())]


def unit_table(rows: DataFrame, min_line: int) -> DataFrame:
    """(id, row, start, stop, kind, h1, h2); rows: (id, row, number, text).

    Kind LINE: offsets and digest of a line; MARK: its place as start, its hash as h1; TEXT: one for each row, with the bounds of its words, and its number as h1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def records(b: pa.RecordBatch, of: np.ndarray, *columns) -> pa.RecordBatch:
            own = [b.column(k).take(pa.array(of)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, (_, t) in zip(columns, _FIELDS, strict=True))], ["id", "row", *(n for n, _ in _FIELDS)])

        for b in (x.slice(a, 1000) for x in batches for a in range(0, x.num_rows, 1000)):
            texts = b.column(3).to_pylist()
            of, start, stop, digests, first, last = [], [], [], [], [], []
            for i, t in enumerate(texts):
                n = len(of)
                for a, z, norm in lines(t, min_line):
                    of.append(i)
                    start.append(a)
                    stop.append(z)
                    digests.append(xxh3_128_digest(norm))
                whole = len(of) > n and min_line <= 1
                first.append(start[n] if whole else len(t or "") - len((t or "").lstrip()))
                last.append(stop[-1] if whole else len((t or "").rstrip()))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
            yield records(b, np.array(of, np.int64), start, stop, np.full(len(of), LINE, np.int8), *h)
            none = np.zeros(len(texts), np.int64)
            yield records(b, np.arange(len(texts)), first, last, np.full(len(texts), TEXT, np.int8), b.column(2), none)
            for d, place, m in marks(texts):
                none = np.zeros(len(d), np.int64)
                yield records(b, d, place.astype(np.int32), none.astype(np.int32), np.full(len(d), MARK, np.int8), m, none)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row long, start int, stop int, kind byte, h1 long, h2 long")


def repeated(units: DataFrame, digest: list[str], *place: str) -> DataFrame:
    """units of a digest that occurs more than once, each with `first`: (none, id, row, *place) of the earliest."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", *place)
    first = units.groupBy(*digest).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = common.materialize(first, "first")  # a table of its own: the join's shuffle of units can then be split where a digest is hot
    return units.join(first.hint("merge"), digest)


def _meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left and right of equal id and row; a null id equals another."""
    right = right.withColumnsRenamed({"id": "__id", "row": "__r"})
    hinted = common.small(right) if how == "left_semi" else right.hint("merge")
    return left.join(hinted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__r")), how).drop("__id", "__r")


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))


def _chained(place: np.ndarray, text: np.ndarray, first: np.ndarray, first_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last marks of the chains; text and first number the texts, marks are in the order of their text and place."""
    step = np.diff(place)
    on = (text[1:] == text[:-1]) & (first[1:] == first[:-1]) & (step == np.diff(first_place)) & (step <= ANCHOR)
    return np.flatnonzero(np.concatenate(([True], ~on))[: len(place)]), np.flatnonzero(np.append(~on, True)[: len(place)])


def chain_table(later: DataFrame) -> DataFrame:
    """(id, row, place, after, first_id, first_row, first_place) of the chains of marks of each text; later: repeated marks that don't stand first."""
    x = F.struct(F.col("start").alias("place"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_place"))
    held = later.groupBy("id", "row").agg(F.array_sort(F.collect_set(x)).alias("marks"))  # of one text: no more than it has words
    kind = later.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten()
            if not len(x):
                continue
            text = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            place, row, first_place = (x.field(k).to_numpy(zero_copy_only=False) for k in ("place", "first_row", "first_place"))
            ids = x.field("first_id").dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.unique(np.stack([row, ids.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
            a, z = _chained(place, text, first, first_place)
            of, at = pa.array(text[a]), pa.array(a)
            out = [b.column(0).take(of), b.column(1).take(of), pa.array(place[a]), pa.array(place[z] + np.int32(ANCHOR)), *(x.field(k).take(at) for k in ("first_id", "first_row", "first_place"))]
            yield pa.RecordBatch.from_arrays(out, ["id", "row", "place", "after", "first_id", "first_row", "first_place"])

    return held.mapInArrow(run, f"id {kind}, row long, place int, after int, first_id {kind}, first_row long, first_place int")


def _texts(b: pa.RecordBatch, before: list) -> Iterator[tuple[int, str, list[str]]]:
    """(index, text, words) of the batch's rows; copies of a row follow each other, and only the first counts; before holds the last row's id and hash."""
    for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in ("id", "row")), strict=True)):
        if before != [key]:
            before[:] = [key]
            text = b.column("text")[i].as_py()
            yield i, text, text.lower().split()


def edge_table(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """(own, id, row, place, after, first_id, first_row, first_place, words, begins, ends): the words around every chain (own) and around its first place.

    words: four bytes for each of REACH words before and after; begins, ends: offsets at which the words from place - REACH to place begin, and those
    from after - 1 to after + REACH - 1 end.
    """
    there = F.struct(F.col("first_place").alias("place"), (F.col("first_place") + F.col("after") - F.col("place")).alias("after"))
    own = chains.select("id", "row", F.struct("place", "after", "first_id", "first_row", "first_place").alias("chain"))
    first = chains.select(F.col("first_id").alias("id"), F.col("first_row").alias("row"), there.alias("first"))
    asked = own.unionByName(first, allowMissingColumns=True).groupBy("id", "row").agg(F.collect_set("chain").alias("chains"), F.collect_set("first").alias("asked"))
    asked = common.materialize(asked, "asked")  # each list: places of one text
    found = _meet(_meet(rows, asked.select("id", "row"), "left_semi"), asked).select("id", "row", "text", "chains", "asked")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        def side(words: list[str], a: int, known: dict[int, bytes]) -> bytes:
            if a not in known:
                h = np.zeros(REACH, np.uint64)
                for k in range(max(a, 0), min(a + REACH, len(words))):
                    h[k - a] = digest(words[k]) | 1
                known[a] = h.astype(np.uint32).tobytes()
            return known[a]

        last: list = []
        for b in (x.slice(a, 500) for x in batches for a in range(0, x.num_rows, 500)):
            out: list[list] = [[] for _ in range(10)]
            chains, asked = (b.column(k).to_pylist() for k in ("chains", "asked"))
            for i, text, words in _texts(b, last):
                begins, ends = (np.pad(x, REACH, mode="edge").astype(np.int32) for x in word_edges(text))
                known: dict[int, bytes] = {}
                for x in [*chains[i], *asked[i]]:
                    place, after, mine = x["place"], x["after"], "first_id" in x
                    around = side(words, place - REACH, known) + side(words, after, known)
                    stop = ends[after - 1 + REACH : after + 2 * REACH].tobytes() if mine else None
                    values = (mine, i, place, after, x.get("first_id"), x.get("first_row"), x.get("first_place"), around, begins[place : place + REACH + 1].tobytes(), stop)
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            of = pa.array(out[1], pa.int64())
            types = [pa.int32(), pa.int32(), b.schema.field("id").type, pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(out[0], pa.bool_()), b.column(0).take(of), b.column(1).take(of), *(pa.array(c, t) for c, t in zip(out[2:], types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["own", "id", "row", "place", "after", "first_id", "first_row", "first_place", "words", "begins", "ends"])

    edges = found.mapInArrow(run, f"own boolean, id {kind}, row long, place int, after int, first_id {kind}, first_row long, first_place int, words binary, begins binary, ends binary")
    edges = common.materialize(edges, "edges")
    common.release(asked)
    return edges


def extended_table(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """(id, row, place, after, first_id, first_row, first_place, before, behind, left, right, start, stop, words, first_start) of every chain.

    before, behind: how many words beside it agree with those beside its first place; left, right: hashes of the words that follow them, 0 if REACH
    agree or the text ends; start, stop, words: of the chain with the words that agree.
    """
    edges = edge_table(rows, chains)
    kind = rows.schema["id"].dataType.simpleString()
    first = edges.where(~F.col("own")).select(F.col("id").alias("__id"), F.col("row").alias("__r"), F.struct("place", "after").alias("__at"), F.col("words").alias("v"), F.col("begins").alias("first_begins"))
    there = F.struct(F.col("first_place").alias("place"), (F.col("first_place") + F.col("after") - F.col("place")).alias("after"))
    both = edges.where("own").withColumn("at", there)
    both = both.join(first.hint("merge"), F.col("first_id").eqNullSafe(F.col("__id")) & (F.col("first_row") == F.col("__r")) & (F.col("at") == F.col("__at")))
    both = both.select("id", "row", "place", "after", "first_id", "first_row", "first_place", F.col("words").alias("w"), "begins", "ends", "v", "first_begins")

    def table(b: pa.RecordBatch, k: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(k).to_pylist()), kind).reshape(b.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w, v = table(b, "w", np.uint32), table(b, "v", np.uint32)
            differs = (w != v) | (w == 0)
            # the words that agree without a gap, up to all REACH
            before = np.where(differs[:, :REACH].any(axis=1), differs[:, REACH - 1 :: -1].argmax(axis=1), REACH)
            behind = np.where(differs[:, REACH:].any(axis=1), differs[:, REACH:].argmax(axis=1), REACH)
            words = b.column("after").to_numpy() - b.column("place").to_numpy() + before + behind
            at = np.arange(len(w))
            beside = np.pad(w.astype(np.int64), ((0, 0), (1, 1)))
            left, right = (np.where(n < REACH, beside[at, k], 0) for n, k in ((before, REACH - before), (behind, 1 + REACH + behind)))
            start, stop, first = (table(b, k, np.int32)[at, i] for k, i in (("begins", REACH - before), ("ends", behind), ("first_begins", REACH - before)))
            numbers = [pa.array(x, t) for x, t in ((before, pa.int32()), (behind, pa.int32()), (left, pa.int64()), (right, pa.int64()), (start, pa.int32()), (stop, pa.int32()), (words, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *numbers, pa.array(first, pa.int32())], names)

    names = ["id", "row", "place", "after", "first_id", "first_row", "first_place", "before", "behind", "left", "right", "start", "stop", "words", "first_start"]
    out = both.mapInArrow(run, f"id {kind}, row long, place int, after int, first_id {kind}, first_row long, first_place int, before int, behind int, left long, right long, start int, stop int, words int, first_start int")
    out = common.materialize(out, "extended")
    common.release(edges)
    return out


def window_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, row, place, start, stop, h1, h2) of the windows of PASSAGE words that begin in a wanted range of places; wanted: (id, row, low, high), both inclusive."""
    asked = common.materialize(wanted.groupBy("id", "row").agg(F.collect_set(F.struct("low", "high")).alias("asked")), "asked")  # places of one text
    found = _meet(_meet(rows, asked.select("id", "row"), "left_semi"), asked).select("id", "row", "text", "asked")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        last: list = []
        for b in (x.slice(a, 500) for x in batches for a in range(0, x.num_rows, 500)):
            of, places, starts, stops, digests = [], [], [], [], []
            asked = b.column("asked").to_pylist()
            for i, text, words in _texts(b, last):
                begins, ends = word_edges(text)
                for k in sorted({k for x in asked[i] for k in range(max(x["low"], 0), min(x["high"], len(words) - PASSAGE) + 1)}):
                    of.append(i)
                    places.append(k)
                    starts.append(begins[k])
                    stops.append(ends[k + PASSAGE - 1])
                    digests.append(xxh3_128_digest(" ".join(words[k : k + PASSAGE])))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
            own = [b.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int32()) for x in (places, starts, stops)), *map(pa.array, h)], ["id", "row", "place", "start", "stop", "h1", "h2"])

    out = common.materialize(found.mapInArrow(run, f"id {kind}, row long, place int, start int, stop int, h1 long, h2 long"), "windows")
    common.release(asked)
    return out


def passage_table(rows: DataFrame, again: DataFrame) -> DataFrame:
    """(id, row, start, stop, place, words, first_id, first_start) of chains and windows that go; again: repeated marks.

    A window that stood earlier, but not at the first place of its mark, goes past an end of the mark's chain, and so it does where it stood earlier:
    both chains agree with the same text up to the same word, and go on alike with another.  Windows past ends that have this in
    common are digested and grouped like lines.  A mark that stands less than PASSAGE words behind its first place in the same text
    is in no chain; all windows with it are digested, and those past the ends of all chains with this text.
    """
    beside = _same() & (F.col("start") < F.col("first.start") + PASSAGE)
    again = common.materialize(again, "again")
    chains = common.materialize(chain_table(again.where(~beside)), "chains")
    near = again.where(beside & (F.col("start") > F.col("first.start"))).select("id", "row", (F.col("start") - REACH).alias("low"), F.col("start").alias("high"))
    near = common.materialize(near, "near")
    common.release(again)
    found = extended_table(rows, chains)
    common.release(chains)
    columns = ["id", "row", "start", "stop", "place", "words", "first_id", "first_start"]

    def ends(side: int, word: str, until: Column, low: Column, high: Column) -> DataFrame:
        there = until + F.col("first_place") - F.col("place")
        end = F.xxhash64(F.lit(side), "first_id", "first_row", there, word)
        return found.where(F.col(word) != 0).select("id", "row", end.alias("end"), F.xxhash64("first_id", "first_row").alias("text"), low.alias("low"), high.alias("high"))

    start, stop = F.col("place") - F.col("before"), F.col("after") + F.col("behind")
    past = ends(0, "left", start, F.col("place") - REACH, start - 1).union(ends(1, "right", stop, stop + 1 - PASSAGE, F.col("after") - ANCHOR))
    twice = common.materialize(past.groupBy("end").count().where("count > 1").select("end"), "ends")
    loops = common.materialize(near.select(F.xxhash64("id", "row").alias("text")).distinct(), "loops")
    range_ = ["id", "row", "low", "high"]
    wanted = past.join(common.small(twice), "end").select(*range_).union(past.join(common.small(loops), "text").select(*range_)).union(near.select(*range_))
    w = window_table(rows, wanted)
    gone = repeated(w, ["h1", "h2"], "place", "start").where(~_same() | (F.col("place") >= F.col("first.place") + PASSAGE))
    gone = gone.withColumns({"words": F.lit(PASSAGE), "first_id": F.col("first.id"), "first_start": F.col("first.start")})
    found = found.where(F.col("words") >= PASSAGE).withColumn("place", F.col("place") - F.col("before"))
    return found.select(*columns).union(gone.select(*columns))


def _number() -> Column:
    return F.monotonically_increasing_id()


def _runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of intervals that overlap begins, and up to where it goes; intervals in the order of row and start."""
    begin, until = row.astype(np.int64) << 32 | start, np.maximum.accumulate(row.astype(np.int64) << 32 | stop)
    at = np.flatnonzero(np.concatenate(([True], begin[1:] >= until[:-1]))[: len(begin)])
    last = np.append(at[1:], len(begin))[: len(at)] - 1
    return at, until[last] & 0xFFFFFFFF


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE, number: Column | None = None) -> DataFrame:
    """(id, number, n_lines, n_passages, passage_words, spans) of every row.

    n_lines, n_passages: units of either kind that go, passages that overlap as one; passage_words: the words of the longest of them; spans: what they cover, in order and
    disjoint, as (start, stop, first_id, first_start) in code points, end exclusive, with where the earliest unit of each stood first.
    number tells the rows apart; given, docs is a table that can be read again.
    """
    common.ship(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("row"), (_number() if number is None else number).alias("number"), text.alias("text"))
    u = common.materialize(unit_table(rows, min_line), "units")
    line = repeated(u.where(F.col("kind") == LINE), ["h1", "h2"], "start").where(~_same() | (F.col("start") != F.col("first.start")))
    line = line.select("id", "row", "start", "stop", F.lit(0).alias("place"), F.lit(0).alias("words"), F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    mark = repeated(u.where(F.col("kind") == MARK).select("id", "row", "start", "h1"), ["h1"], "start")
    gone = line.union(passage_table(rows.drop("number"), mark))
    x = F.struct("start", "stop", "place", "words", "first_id", "first_start")
    gone = gone.groupBy("id", "row").agg(F.sort_array(F.collect_set(x)).alias("units"))  # copies of a row have the same
    copies = u.where(F.col("kind") == TEXT).select("id", "row", F.col("h1").alias("number"), "start", "stop")
    one = copies.groupBy("id", "row").agg(F.min("number").alias("one"))
    held = _meet(_meet(copies, one), gone, "left").select("id", "number", "start", "stop", (F.col("number") != F.col("one")).alias("copy"), "units")
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first_id", rows.limit(0).toArrow().schema.field("id").type), ("first_start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, units = b.num_rows, b.column("units").flatten()
            row = np.repeat(np.arange(size), b.column("units").value_lengths().fill_null(0).to_numpy())
            start, stop, place, words, first = (units.field(k).to_numpy() for k in ("start", "stop", "place", "words", "first_start"))
            long = np.flatnonzero(words)
            passage, until = _runs(row[long], place[long], place[long] + words[long])
            most = np.zeros(size, np.int64)
            np.maximum.at(most, row[long][passage], until - place[long][passage])
            copy = np.flatnonzero(b.column("copy").to_numpy(zero_copy_only=False) & (b.column("start").to_numpy() < b.column("stop").to_numpy()))  # goes whole
            mine = np.flatnonzero(~np.isin(row, copy))
            at, end = _runs(row[mine], start[mine], stop[mine])
            of = np.concatenate((row[mine][at], copy))
            order = np.argsort(of, kind="stable")
            begin = np.concatenate((start[mine][at], b.column("start").to_numpy()[copy]))
            there = [pa.concat_arrays([units.field("first_id").take(pa.array(mine[at])), b.column("id").take(pa.array(copy))]), pa.array(np.concatenate((first[mine][at], begin[len(at) :])), pa.int32())]
            values = [pa.array(begin, pa.int32()), pa.array(np.concatenate((end, b.column("stop").to_numpy()[copy])), pa.int32()), *there]
            flat = pa.StructArray.from_arrays([v.take(pa.array(order)) for v in values], fields=list(span))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(size + 1)), pa.int32()), flat)
            counts = [np.bincount(row[words == 0], minlength=size), np.bincount(row[long][passage], minlength=size), most]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), spans], ["id", "number", "n_lines", "n_passages", "passage_words", "spans"])

    spans = f"array<struct<start:int,stop:int,first_id:{kind},first_start:int>>"
    return held.mapInArrow(run, f"id {kind}, number long, n_lines long, n_passages long, passage_words long, spans {spans}")


def removed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE) -> DataFrame:
    """(id, start, stop, first_id, first_start) of every span that goes."""
    return removals(docs, id_col, text_col, min_line).select("id", F.explode("spans").alias("x")).select("id", "x.*")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE) -> DataFrame:
    """docs with text less its repeated units, and `kept`: the (start, stop) offsets of what is left in the original."""
    held = common.materialize(docs.drop("kept").withColumn("__row", _number()), "docs")
    spans = removals(held, id_col, text_col, min_line, held["__row"]).select(F.col("number").alias("__row"), F.col("spans").alias("__gone"))
    n = F.coalesce(F.length(text_col), F.lit(0))
    gone = F.transform("__gone", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), gone, F.array(F.struct(n.alias("start"), n.alias("stop"))))
    between = F.transform(F.sequence(F.lit(1), F.size("__edges") - 1), lambda i: F.struct(F.get("__edges", i - 1)["stop"].alias("start"), F.get("__edges", i)["start"].alias("stop")))
    out = held.join(spans, "__row").withColumn("__edges", edges).withColumn("kept", F.filter(between, lambda s: s["start"] < s["stop"]))
    text = F.array_join(F.transform("kept", lambda s: F.substring(F.col(text_col), s["start"] + 1, s["stop"] - s["start"])), "")
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text)).select(*docs.drop("kept").columns, "kept")
