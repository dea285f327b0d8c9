import random
import re

from keyfold.llm import line_dedup
from tests.llm.helpers import WORDS, awkward, table

LONG = "one two three four five six seven eight nine."
OTHER = "this other line has also got more than eight words in it"


def ordered(rows):
    """Rows in the order of their occurrences, without copies of a row; rows of one id are in an order of the operator's."""
    return sorted(dict.fromkeys(rows), key=lambda x: (x[0] is None, x[0] or 0))


def plain(rows, passage=50):
    """For each distinct row, the places of the words that go by whole lines, and by windows that stood earlier, from all windows of all texts."""
    lines, windows, out = set(), {}, {}
    for k, (i, t) in enumerate(ordered(rows)):
        words = [(m.start(), m.group().lower()) for m in re.finditer(r"\S+", t or "")]
        by_line, at = set(), 0
        for line in re.split("\n", t or ""):
            n = len(line.split())
            norm = tuple(line.lower().split())
            if n:
                if norm in lines:
                    by_line |= set(range(at, at + n))
                lines.add(norm)
            at += n
        by_window = set()
        for a in range(len(words) - passage + 1):
            w = tuple(x for _, x in words[a : a + passage])
            d, p = windows.setdefault(w, (k, a))
            if d != k or a >= p + passage:
                by_window |= set(range(a, a + passage))
        out[(i, t)] = by_line, by_window
    return out


def gone_words(spans, text):
    """The places of the words that the spans take."""
    return {i for i, m in enumerate(re.finditer(r"\S+", text or "")) if any(a <= m.start() and m.end() <= b for a, b in spans)}


def removed(spark, rows, **kw):
    """(id, text) -> places of the words that go, of one of equal rows."""
    held = table(spark, rows).coalesce(1)
    out = {}
    for (i, t), r in zip(rows, sorted(line_dedup.removals(held, **kw).collect(), key=lambda r: r["number"]), strict=True):
        assert r["id"] == i
        spans = [(s["start"], s["stop"]) for s in r["spans"]]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        if (i, t) in out:  # a copy of a row goes whole
            assert gone_words(spans, t) == set(range(len((t or "").split())))
        else:
            out[(i, t)] = gone_words(spans, t)
    return out


def test_lines_and_words():
    text = f"Short. {LONG} No\n  {OTHER}\r\n\n \x1f\n a　b c. "
    got = list(line_dedup.lines(text))
    assert [text[a:b] for a, b, _ in got] == [f"Short. {LONG} No", OTHER, "a　b c."]
    assert got[2][2] == "a b c." and list(line_dedup.lines(None)) == list(line_dedup.lines("")) == []
    assert [text[a:b] for a, b, _ in line_dedup.lines(text, 4)] == [f"Short. {LONG} No", OTHER]
    for t in (text, "", " ", "x", "É à ß 漢字 \U0001f600 \x1c\x85end"):
        assert [t[a:b] for a, b in zip(*line_dedup.word_edges(t), strict=True)] == t.split()


def test_marks_are_the_lowest_of_the_windows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (49, 50, 51, 400, 0, 75)] + [None, "x " * 300]
    got = {}
    for d, place, m in line_dedup.marks(texts):
        for x in zip(d.tolist(), place.tolist(), m.tolist(), strict=True):
            got.setdefault(x[0], {})[x[1]] = x[2]
    assert set(got) == {1, 2, 3, 5, 7}
    for d, places in got.items():
        runs = len(texts[d].split()) - line_dedup.ANCHOR + 1
        h = line_dedup._rolling(line_dedup._blocks([texts[d]]).__next__()[0], line_dedup.ANCHOR).tolist()
        want = set()
        for a in range(runs - line_dedup.REACH):
            w = h[a : a + line_dedup.REACH + 1]
            want |= {a + k for k, x in enumerate(w) if x == min(w)}
        assert set(places) == want


def test_matches_a_plain_scan(spark):
    rows = awkward() + [(50, f"{LONG}\n{OTHER}"), (51, f"mid words before it {OTHER.upper()}\n{LONG.upper()}  \n{LONG}"), (None, LONG)]
    got = removed(spark, rows)
    assert got == {k: a | b for k, (a, b) in plain(rows).items()}
    assert line_dedup.removals(table(spark, [])).count() == line_dedup.removed_units(table(spark, [])).count() == 0


def test_spans_name_the_first_occurrence(spark):
    rows = [(7, f"a\n{LONG}"), (3, f"b\n  {LONG} "), (5, f"c\n{LONG}\nd"), (9, "b")]
    got = {(r["id"], r["start"], r["stop"], r["first_id"], r["first_start"]) for r in line_dedup.removed_units(table(spark, rows)).collect()}
    assert got == {(5, 2, 2 + len(LONG), 3, 4), (7, 2, 2 + len(LONG), 3, 4), (9, 0, 1, 3, 0)}


def test_a_passage_without_any_punctuation_is_found_within_lines(spark):
    rng = random.Random(7)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(20 + i)) + " " + passage + " " + " ".join(rng.choice(WORDS) for _ in range(25))) for i in range(12)]
    rows += [(100 + i, " ".join(rng.choice(WORDS) for _ in range(90))) for i in range(30)]
    text = dict(rows)
    gone = line_dedup.removed_units(table(spark, rows)).collect()
    assert {r["id"] for r in gone} == set(range(1, 12))
    assert all(passage in text[r["id"]][r["start"] : r["stop"]] and r["first_id"] == 0 for r in gone)


def test_clean_keeps_offsets(spark):
    rows = [(1, f"Intro words.\n{LONG}\nEnd"), (2, f"{LONG}\nNew é text"), (3, None), (4, ""), (1, f"Intro words.\n{LONG}\nEnd")]
    got = line_dedup.clean(table(spark, rows)).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] == 1) == ["", rows[0][1]]
    got = {r["doc_id"]: r for r in got if r["text"] or r["doc_id"] != 1}
    assert got[2]["text"] == "\nNew é text" and got[3]["text"] is None and got[4]["text"] == ""
    assert all("".join(t[s["start"] : s["stop"]] for s in got[i]["kept"]) == got[i]["text"] for i, t in rows if t is not None)
    assert got[2]["row"] == "x" and line_dedup.clean(table(spark, [])).count() == 0


def test_every_passage_of_fifty_words_is_found_whole(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for k in range(150):
        n = 49 if k % 10 == 0 else rng.choice([50, 51, 55, 60, 100])
        passage = [rng.choice(words) for _ in range(n)]
        for copy in range(2):
            head = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
            tail = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
            rows.append((2 * k + copy, " ".join([*head, *passage, *tail])))
            want[2 * k + copy] = set(range(len(head), len(head) + n)) if copy and n >= 50 else set()
    short = "Some few words. Four more words here.\nAnd then three. " * 10
    short = " ".join(f"{w}{i}." if w.endswith(".") else w for i, w in enumerate(short.split(" ")))
    rows += [(1000, f"begins so {short}ends so"), (1001, f"other words and {short}other end")]
    rows += [(1002, " ".join(["ba"] * 1000))]
    docs = table(spark, rows)
    got = {}
    for r in line_dedup.removed_units(docs).collect():
        got.setdefault(r["id"], []).append((r["start"], r["stop"]))
    for i, t in rows[:300]:
        assert gone_words(got.get(i, []), t) == want[i], i
    assert 1000 not in got and gone_words(got[1001], rows[301][1]) >= set(range(3, 3 + len(short.split())))
    assert gone_words(got[1002], rows[302][1]) == set(range(50, 1000))
    kept = {r["doc_id"]: r for r in line_dedup.clean(docs).collect()}
    for i, t in rows:
        n = len(t.split()) - len(gone_words(got.get(i, []), t))
        assert len(kept[i]["text"].split()) == n and "".join(t[s["start"] : s["stop"]] for s in kept[i]["kept"]) == kept[i]["text"]


def test_shared_and_edited_passages_go_as_windows_that_stood_earlier(spark):
    """Texts made of a few passages, cut, edited, joined and repeated: what goes is just what a line or a window says."""
    rng = random.Random(5)
    pool = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(30, 400))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(1, len(p))]
            words += [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edited"
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words)), "\n")
        rows.append((i, " ".join(words)))
    assert removed(spark, rows) == {k: a | b for k, (a, b) in plain(rows).items()}


def test_a_repeated_line_goes_whole(spark):
    line = f"Short one. {LONG} And an end"
    rows = [(1, f"{line}\nfirst"), (2, f"second\n  {line} \nmore"), (3, f"{LONG.upper()} {OTHER}"), (4, f"It is so that a line begins otherwise. {OTHER} too")]
    got = line_dedup.removed_units(table(spark, rows)).collect()
    text = dict(rows)
    assert [(r["id"], text[r["id"]][r["start"] : r["stop"]], r["first_id"]) for r in got] == [(2, line, 1)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean(table(spark, rows)).collect()}
    assert kept == text | {2: "second\n   \nmore"}


def test_short_lines_that_repeat_go(spark):
    licence = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"one\n{licence}\nEnd"), (2, f"{licence}\ntwo {licence}"), (3, f"three\n  {licence.upper()}\r\nend\n\n \n"), (4, "\n\n \n")]
    text = dict(rows)
    got = line_dedup.removed_units(table(spark, rows)).collect()
    assert sorted((r["id"], text[r["id"]][r["start"] : r["stop"]], r["first_id"]) for r in got) == [(2, licence, 1), (3, licence.upper(), 1), (3, "end", 1)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean(table(spark, rows)).collect()}
    assert kept == {1: text[1], 2: f"\ntwo {licence}", 3: "three\n  \r\n\n\n \n", 4: text[4]}
    assert removed(spark, rows, min_line=2)[rows[2]] == {1, 2, 3, 4, 5, 6, 7}
