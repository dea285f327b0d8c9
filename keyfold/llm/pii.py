"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what agrees with them.

The patterns for email, ip, card and phone give the base spans, which always stay.  The field is a chain over all tokens (runs without white space)
of a document.  Tokens without a digit, an at sign or a key prefix are outside by construction, unless they are the value after a cue for
secrets, a repeat of such a value, or long with a capital after a small letter.  A token whose label is fixed like that takes part in the chain
by what it says to its neighbours, so only the others are kept as nodes.  A node's potential sums hashed features of its shape, of the two
tokens before it and of whether a cue stands right before it.  Chain edges join neighbours; skip edges join distant nodes
that repeat (same letters and digits), all to the first of them, or are similar (same shape and length), each to the next one, so their
number is linear and what one repeat shows reaches all others over two edges.
Loopy message passing over all edges, until the messages stand still, gives every node's label probabilities; a node labelled otherwise than
outside, and not within a base span, becomes a further span.  Labels: email, ip, card, phone, and secret (keys, tokens, passwords).

The field is trained on a bounded sample of documents (`sample`, lowest hashes first, of each a stretch of `stretch` characters) whose tokens are
labelled by the patterns and by cues for secrets, and on made-up lines (`examples()`) with what such documents lack: dates, times, versions,
amounts and other numbers that are outside, and secrets that come again without their cue.  Cues are hidden at random in training, so that repeats must carry them over.

Null and empty texts have no spans.  Ids may be null or repeat; an empty table gives an empty result; other columns are ignored by
find() and kept by redact().
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents that the field is trained on, at most.
SAMPLE = 6_000
FEATURES = 1 << 12
#: Characters of a sampled document that are trained on: a stretch at a place that its hash chooses.
STRETCH = 8_000
#: Features of their own: whether the token is the value after a cue for secrets.
CUED, NOT_CUED = FEATURES - 1, FEATURES - 2
#: Message passing ends when no message changes by more than this, and after so many rounds where loops keep it from that.
STILL, ROUNDS = 1e-3, 200
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|AKIA")
_SPACE = re.compile(r"\s")
#: What labels a token as a secret for training.
_SECRETS = re.compile(r"""AKIA[0-9A-Z]{16}|(?:token|passw(?:or)?d|secret|api[_-]?key)\s*[=:]\s*["']?([^\s"'#]{8,})""", re.I)
#: What the case-folded text has if _SECRETS matches.
_CUES = ("token", "passw", "secret", "api", "akia")
_MIXED = re.compile(r"[a-z][A-Z]")
_MIXED_LENGTH = 16
_TOKEN = re.compile(r"\S+")
_PART = re.compile(r"""[^\s"'#:=,;&?()\[\]{}<>]{8,}""")
_EDGE = re.compile(r"[^\w+(]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, from each at sign outwards: linear, whatever stands before it."""
    out, until = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > until and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            until = m.end()
            out.append((start, until))
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Matches of the ip pattern; a match always begins where a run of digits does."""
    out, at = [], 0
    while m := _DOTTED.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in "0123456789":
            start -= 1
        m = _IP.match(text, start)
        if not m:
            at = text.index(".", start) + 1
            continue
        at = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(m.span())
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by kind, then start."""
    if not text:
        return []
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    out += [(1, *s) for s in ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def plain_key(core: str) -> str:
    return "".join(c for c in core.lower() if c.isalnum())


def secrets(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the values after cues for secrets."""
    folded = text.casefold()
    if not any(k in folded for k in _CUES):
        return []
    return [m.span(1 if m.group(1) else 0) for m in _SECRETS.finditer(text)]


def nodes(text: str, cued: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """(start, stop) of the tokens that may be personal data, in order; cued: secrets(text), if known."""
    out = _marked(text)
    more = secrets(text) if cued is None else list(cued)
    first = len(more)  # so many are the values themselves
    if more:
        values = {plain_key(text[slice(*value(text, *s))]) for s in more}
        for m in _TOKEN.finditer(text):
            if plain_key(text[slice(*value(text, *m.span()))]) in values:
                more.append(m.span())
            else:
                more += [x.span() for x in _PART.finditer(text, *m.span()) if plain_key(x.group()) in values]
    at = 0
    while m := _MIXED.search(text, at):
        start, at = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while at < len(text) and not text[at].isspace():
            at += 1
        if at - start >= _MIXED_LENGTH:
            more.append((start, at))
    if not more:
        return out
    # marked tokens go before, values after cues before what else overlaps them
    ends = sorted([(a, b, 0) for a, b in out] + [(a, b, 1 + (k >= first)) for k, (a, b) in enumerate(more)])
    kept: list[tuple[int, int, int]] = []
    for x in ends:
        while kept and x[0] < kept[-1][1] and x[2] < kept[-1][2]:
            kept.pop()
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return [x[:2] for x in kept]


def _marked(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the tokens with a digit, an at sign or a key prefix."""
    out, at = [], 0
    for m in _TRIGGER.finditer(text):
        start, stop = m.span()
        if start < at:
            continue
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _SPACE.search(text, stop)
        at = end.start() if end else len(text)
        out.append((start, at))
    return out


def value(text: str, start: int, stop: int) -> tuple[int, int]:
    """The token without quotes and punctuation around it, and without `name=`."""
    eq = text.find("=", start, stop)
    if start < eq < stop - 1:
        start = eq + 1
    m = _EDGE.match(text, start, stop)
    if m and m.end() < stop:
        start = m.end()
    end = stop
    while end > start and not (text[end - 1].isalnum() or text[end - 1] in "_)"):
        end -= 1
    return start, end if end > start else stop


def shape(token: str) -> str:
    """Letters as a, capitals as A, digits as 9, runs of one kind once."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", token)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", s))


def describe(text: str, start: int, stop: int, before: list[str], cued: bool = False) -> tuple[list[int], str, str]:
    """Hashed features (of the token, then three of its cues), its repeat key and its similarity key; before: the two tokens before it."""
    token = text[start:stop]
    a, b = value(text, start, stop)
    core = text[a:b]
    digits = sum(c.isdigit() for c in core)
    if a > start and "=" in text[start:a]:
        before = [*before, text[start:a].rstrip("=\"'")][-2:]
    plain = plain_key(core)
    hexa = len(plain) >= 8 and all(c in "0123456789abcdef" for c in plain)
    form = shape(core)
    parts = [p.lstrip("0") for p in core.split(".")]
    quads = len(parts) == 4 and all(p.isdecimal() or not p for p in parts) and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    bulk = min(len(core), 48) // 4
    number = _NOT_DIGIT.sub("", core)
    own = [f"s{form}" if len(form) <= 12 else "long", f"n{bulk}", f"d{min(digits, 20)}", f"@{core.count('@')}", f"q{quads}", f"x{hexa}{bulk}"]
    own += [f"l{16 <= len(number) <= 19 and luhn(number)}", f"c{token[:1]}" if not token[:1].isalnum() else "c", f"m{len(form) * 2 > len(core)}{bulk}", "bias"]
    before = [""] * (2 - len(before)) + [w.lower() for w in before]
    # cues: the word before, and both
    cues = [f"b{before[1]}", f"b{before[0]}b{before[1]}"]
    ids = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (FEATURES - 2) for x in own + cues] + [CUED if cued else NOT_CUED]
    return ids, plain, f"{form}|{len(core)}"


@dataclass
class Graph:
    """Nodes of many documents: features, edges (i, j, 0 chain, 1 repeated or 2 similar), where each node stands, whether a token that is outside by construction is its neighbour before and behind."""

    x: np.ndarray
    edges: np.ndarray
    place: list[tuple[int, int, int]]
    beside: np.ndarray | None = None


def graph(texts: list[str | None]) -> Graph:
    x: list[list[int]] = []
    edges: list[tuple[int, int, int]] = []
    place: list[tuple[int, int, int]] = []
    beside: list[tuple[bool, bool]] = []
    sames: list[str] = []
    for d, text in enumerate(texts):
        if not text:
            continue
        cued = secrets(text)
        here = nodes(text, cued)
        if not here:
            continue
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        starts = [a for a, _ in tokens]
        last: dict[str, int] = {}
        gaps = [bool(text[a:b].strip()) for a, b in zip([0, *(b for _, b in here)], [*(a for a, _ in here), len(text)], strict=True)]
        for n, (start, stop) in enumerate(here):
            i = len(x)
            k = bisect_left(cued, (stop, stop)) - 1
            t = bisect_right(starts, start) - 1
            before = [text[a:b] for a, b in tokens[max(0, t - 2) : t]]
            ids, same, similar = describe(text, start, stop, before, k >= 0 and cued[k][1] > start)
            x.append(ids)
            place.append((d, start, stop))
            beside.append((gaps[n], gaps[n + 1]))
            linked = set()
            if n and not gaps[n] and (not same or last.get(f"={same}", -1) != i - 1):
                edges.append((i - 1, i, 0))
                linked.add(i - 1)
            sames.append(same)
            for kind, key in ((1, f"={same}"), (2, f"~{similar}")):
                j = last.get(key, -1) if same else -1
                if j >= 0 and j not in linked and (kind == 1 or sames[j] != same):
                    edges.append((j, i, kind))
                    linked.add(j)
                if kind == 2 or key not in last:
                    last[key] = i
    return Graph(np.array(x, np.int64).reshape(len(x), 13), np.array(edges, np.int64).reshape(-1, 3), place, np.array(beside, bool).reshape(-1, 2))


#: What training starts from: chain edges say nothing, and skip edges favour equal labels.
PRIOR = np.stack([c * np.eye(len(KINDS) + 1) for c in (0.0, 2.0, 0.5)])


@dataclass
class Model:
    """Label 0 is outside, label k + 1 is KINDS[k]; pair: potentials of chain, repeat and similarity edges."""

    w: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(KINDS) + 1)))
    pair: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def potentials(self, x: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
        p = self.w[x].sum(axis=1)
        p[:, 0] += 1.0
        if beside is not None:  # chain edges from and to tokens whose label is outside
            p += beside[:, :1] * self.pair[0][0] + beside[:, 1:] * self.pair[0][:, 0]
        return p

    def propagate(self, g: Graph, x: np.ndarray, rounds: int | None = None, held: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Node and edge marginals after damped flooding of messages along chain and skip edges.

        rounds: that many, or until the messages stand still; held: where to take up messages from, and to leave them.
        """
        node = self.potentials(x, g.beside)
        if not len(g.edges):
            return _normal(node), np.zeros((0, *self.pair.shape[1:]))
        i, j, kind = g.edges.T
        t = self.pair[kind]
        right, left = held if held else np.zeros((2, len(i), node.shape[1]))
        for _ in range(rounds or ROUNDS):
            belief = node.copy()
            np.add.at(belief, j, right)
            np.add.at(belief, i, left)
            new_right = _log_sum((belief[i] - left)[:, :, None] + t, 1)
            new_left = _log_sum((belief[j] - right)[:, None, :] + t, 2)
            new_right = 0.5 * right + 0.5 * (new_right - new_right.max(axis=1, keepdims=True))
            new_left = 0.5 * left + 0.5 * (new_left - new_left.max(axis=1, keepdims=True))
            moved = max(np.abs(new_right - right).max(), np.abs(new_left - left).max())
            right, left = new_right, new_left
            if rounds is None and moved < STILL:
                break
        if held is not None:
            held[:] = right, left
        belief = node.copy()
        np.add.at(belief, j, right)
        np.add.at(belief, i, left)
        edge = (belief[i] - left)[:, :, None] + t + (belief[j] - right)[:, None, :]
        return _normal(belief), _normal(edge.reshape(len(i), -1)).reshape(edge.shape)

    def label(self, g: Graph) -> np.ndarray:
        return self.propagate(g, g.x)[0].argmax(axis=1) if len(g.x) else np.zeros(0, int)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _normal(a: np.ndarray) -> np.ndarray:
    p = np.exp(a - a.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of n made-up texts: personal data, secrets that come again without their cue, and numbers and names that are neither."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def some(letters: str, low: int, high: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def num(low: int, high: int) -> int:
        return rng.randint(low, high)

    def word() -> str:
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(num(1, 4)))
        return rng.choice([w, w, w, w.capitalize(), f"{w},", f"{w}."])

    def camel() -> str:
        return "".join(some(lower, 3, 8).capitalize() for _ in range(num(3, 5)))

    def card(valid: bool) -> str:
        d = some(digits, 15, 15)
        d = next(d + c for c in rng.sample(digits, 10) if luhn(d + c) == valid)
        return rng.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))])

    outside = [
        lambda: f"{num(1950, 2030)}-{num(1, 12):02}-{num(1, 28):02}",
        lambda: f"{num(1, 28)}{(c := rng.choice('/.-'))}{num(1, 12)}{c}{num(1950, 2030)}",
        lambda: f"{num(0, 23):02}:{num(0, 59):02}" + rng.choice(["", f":{num(0, 59):02}", "am"]),
        lambda: rng.choice(["", "v"]) + f"{num(0, 12)}.{num(0, 30)}.{num(0, 30)}" + rng.choice(["", "-rc1", ".", ","]),
        lambda: rng.choice(["version ", "Version ", "v", ""]) + f"{num(0, 30)}.{num(0, 30)}" + rng.choice(["", ".", ","]),
        lambda: str(num(0, 10 ** num(1, 9))) + rng.choice(["", ".", ",", "%", " kg"]),
        lambda: rng.choice("$€£") + f"{num(0, 999)}.{num(0, 99):02}",
        lambda: rng.choice(["1st", "2nd", "3rd", f"{num(4, 20)}th", f"{num(1, 20)}-{num(21, 90)}", f"#{num(1, 9999)}", f"x{num(1, 9)}"]),
        lambda: some(upper, 2, 2) + some(digits, 2, 4) + rng.choice(["", some(upper, 2, 2) + some(digits, 2, 2)]),
        lambda: rng.choice(["", some(lower, 3, 8)]) + camel(),
        lambda: f"978-{num(0, 9)}-{some(digits, 2, 2)}-{some(digits, 6, 6)}-{num(0, 9)}",
        lambda: card(False),
        lambda: f"{num(256, 999)}.{num(0, 255)}.{num(0, 999)}.{num(256, 999)}",
        lambda: f"@{some(lower, 3, 9)}",
    ]
    inside = [
        (0, lambda: f"{some(lower + digits, 2, 9)}{rng.choice(['', '.x', '+a'])}@{some(lower, 3, 9)}.{rng.choice(['com', 'org', 'co.uk', 'io'])}"),
        (1, lambda: ".".join(str(num(0, 255)) for _ in range(4))),
        (2, lambda: card(True)),
        (3, lambda: f"+{num(1, 99)} ({num(100, 999)}) {num(100, 999)}-{num(1000, 9999)}"),
        (3, lambda: f"+{num(1, 99)}{rng.choice([' ', '-'])}{num(100, 999)}{(c := rng.choice(' -'))}{num(100, 999)}{c}{num(1000, 9999)}"),
    ]
    values = [
        lambda: some("0123456789abcdef", 32, 40),
        lambda: some(lower + upper + digits, 12, 32),
        lambda: some(lower, 9, 22),
        lambda: some(lower + digits, 8, 14),
        lambda: camel(),
    ]
    cues = ["token = \"{}\"", "token={}", "token: {}", "password: {}", "password={}", "passwd={}", "Password: '{}'", "secret={}", "secret: {}", "api_key={}", "api-key: {}", "apikey = {}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        kept: list[tuple[int, str]] = []  # what may come again: its kind, or -1
        for _ in range(num(4, 24)):
            text += " ".join(word() for _ in range(num(0, 5))) + rng.choice([" ", "\n", " "])
            what = rng.random()
            kind, item, mask = -1, "", "{}"
            if kept and what < 0.3:
                kind, item = rng.choice(kept)
            elif what < 0.65:
                item = rng.choice(outside)()
            elif what < 0.8:
                kind, item = (f := rng.choice(inside))[0], f[1]()
            else:
                kind, item = 4, rng.choice(values)()
                mask = rng.choice(cues)
                if rng.random() < 0.1:
                    item, mask = "AKIA" + some(upper + digits, 16, 16), "{}"
            if kind in (-1, 4):
                kept.append((kind, item))
            mask = rng.choice(["{}", "{}", "({})", "{},", "\"{}\""]) if mask == "{}" else mask
            at = len(text) + mask.index("{}")
            text += mask.format(item) + " "
            if kind >= 0:
                spans.append((kind, at, at + len(item)))
        out.append((text, spans))
    return out


def train(texts: list[str], steps: int = 120, rate: float = 0.3, hide: float = 0.3, seed: int = 5, made_up: int = 400) -> Model:
    """Adaptive gradient ascent on the approximate likelihood of the pattern labels; hidden cues point at a row that stays 0."""
    model = Model()
    if not texts:
        return model
    spans = {d: base_spans(t) + [(4, *s) for s in secrets(t)] for d, t in enumerate(texts)}
    more = examples(made_up, seed)
    spans |= {len(texts) + d: s for d, (_, s) in enumerate(more)}
    g = graph([*texts, *(t for t, _ in more)])
    if not len(g.x):
        return model
    y = np.zeros(len(g.x), np.int64)
    for i, (d, start, stop) in enumerate(g.place):
        y[i] = next((k + 1 for k, a, b in spans[d] if a < stop and start < b), 0)
    for i, j, kind in g.edges.tolist() + g.edges.tolist()[::-1]:  # what repeats a labelled token is labelled
        if kind == 1:
            y[i] = y[j] = y[i] or y[j]
    rng = np.random.default_rng(seed)
    w2, p2 = np.full_like(model.w, 1e-2), np.full_like(model.pair, 1e-2)
    truth = np.eye(len(KINDS) + 1)[y]
    model.w = np.vstack([model.w, np.zeros((1, model.w.shape[1]))])
    w2 = np.vstack([w2, np.ones((1, w2.shape[1]))])
    held: list[np.ndarray] = []
    for _ in range(steps):
        x = g.x.copy()
        x[:, -3:][rng.random((len(x), 1)).repeat(3, 1) < hide] = FEATURES
        b, e = model.propagate(g, x, 6, held)  # messages go on from those of the step before
        gw = np.zeros_like(model.w)
        np.add.at(gw, x.ravel(), np.repeat(truth - b, x.shape[1], axis=0))
        gw = gw / len(y) - 1e-5 * model.w
        gw[FEATURES] = 0
        gp = np.zeros_like(model.pair)
        if len(g.edges):
            i, j, kind = g.edges.T
            np.add.at(gp, kind, truth[i][:, :, None] * truth[j][:, None, :] - e)
        gp[0][0] += (truth - b)[g.beside[:, 0]].sum(axis=0)
        gp[0][:, 0] += (truth - b)[g.beside[:, 1]].sum(axis=0)
        gp = gp / len(y)
        gp[1:] = (gp[1:] + gp[1:].transpose(0, 2, 1)) / 2
        gp -= 1e-5 * model.pair
        w2 += (gw * 1e2) ** 2
        p2 += (gp * 1e2) ** 2
        model.w += rate * gw * 1e2 / np.sqrt(w2)
        model.pair += rate * gp * 1e2 / np.sqrt(p2)
    model.w = model.w[:FEATURES]
    return model


def spans_of(texts: list[str | None], model: Model, block: int = 20_000) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; texts are taken together until they have about `block` nodes."""
    base = [base_spans(t) for t in texts]
    out = [(b, list(b)) for b in base]
    for a, group in _groups(texts, block):
        g = graph(group)
        for (d, start, stop), k in zip(g.place, model.label(g), strict=True):
            if not k:
                continue
            text = group[d]
            s, e = value(text, start, stop)
            mine = out[a + d][1]
            if any(p < e and s < q for _, p, q in base[a + d]):
                continue
            if mine and mine[-1][0] == k - 1 and k in (3, 4) and len(mine) > len(base[a + d]) and text[mine[-1][2] : s].isspace():
                mine[-1] = (k - 1, mine[-1][1], e)
            else:
                mine.append((int(k) - 1, s, e))
    return [(b, sorted(x)) for b, x in out]


def _groups(texts: list[str | None], block: int) -> Iterator[tuple[int, list[str | None]]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 50 + 1
        if size >= block:
            yield a, texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, stretch: int = STRETCH) -> Model:
    """A field from a bounded sample of the texts with a digit, an at sign or a cue for secrets; `sample` stretches of text reach the driver."""
    text = F.col(text_col).cast("string")
    marked = F.col("text").rlike(r"[0-9@]|(?i:token|passw(?:or)?d|secret|api[_-]?key)\s*[=:]")
    return train(sorted(r["text"] for r in common.sample(docs.select(text.alias("text")), sample, "text", stretch, marked)))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
_SPAN_SQL = "array<struct<kind:string,start:int,stop:int>>"


def _dicts(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans]


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row, both by kind, then start, in code points: a narrow map."""
    spark = docs.sparkSession
    common.ship(spark)
    field_ = spark.sparkContext.broadcast(model)  # FEATURES rows
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = spans_of(b.column(1).to_pylist(), field_.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([_dicts(x[k]) for x in found], _SPAN) for k in (0, 1))], ["id", "base", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, base {_SPAN_SQL}, spans {_SPAN_SQL}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; all other columns as they are."""
    spark = docs.sparkSession
    common.ship(spark)
    field_ = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, until = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if b > until:
                out += [text[until:a] if a > until else "", f"<{KINDS[k]}>" if a >= until else ""]
                until = b
        return "".join(out) + text[until:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if t is None else clean(t, s) for t, (_, s) in zip(texts, spans_of(texts, field_.value), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
