"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments; in each, one gated recurrent layer reads forwards and one backwards, and the two states
at a byte give that byte's language probabilities.  A document's probabilities are the mean over all its bytes.  Training is
backpropagation through time with Adam in numpy, on segments drawn evenly from the languages of a bounded sample (`sample`
distinct texts, lowest hashes first, of each a stretch of `stretch` characters) of the labelled rows; every row is labelled, whole.

Texts that are null or have no letter are `und` with score 0; so is everything if no labelled row has a letter.  Ids may be null or
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common

SAMPLE = 3_000
#: Characters of a sampled text that are trained on, from a place that its hash chooses.
STRETCH = 8_000
UNKNOWN = "und"
#: What may be a letter: also fractions, superscripts and Roman numerals, which isalpha() tells apart.
LETTER = re.compile(r"[^\W\d_]")
f32 = np.float32


@dataclass
class Settings:
    hidden: int = 8
    segment: int = 128
    batch: int = 256
    steps: int = 260
    rate: float = 0.02
    seed: int = 7


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


class Direction:
    """One gated recurrent layer: z, r = sigmoid(...), n = tanh(x + r * (U h + c)), h = (1 - z) n + z h."""

    NAMES = ("wg", "wn", "ug", "un", "cn")

    def __init__(self, hidden: int, rng: np.random.Generator):
        s = 1 / np.sqrt(hidden)
        self.wg = (rng.standard_normal((256, 2 * hidden)) * 0.3).astype(f32)
        self.wn = (rng.standard_normal((256, hidden)) * 0.5).astype(f32)
        self.ug = (rng.standard_normal((hidden, 2 * hidden)) * s).astype(f32)
        self.un = (rng.standard_normal((hidden, hidden)) * s).astype(f32)
        self.cn = np.zeros(hidden, f32)
        self.wg[:, :hidden] += 1  # begin with long memory

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, B, H) for bytes (T, B).  Gates use sigmoid(a) = (1 + tanh(a / 2)) / 2 with the halves folded into the weights."""
        t_all, b = x.shape
        hidden = self.un.shape[0]
        wg, ug = self.wg * f32(0.5), self.ug * f32(0.5)
        states = np.empty((t_all, b, hidden), f32)
        h = np.zeros((b, hidden), f32)
        g, a, n, m = (np.empty((b, k), f32) for k in (2 * hidden, 2 * hidden, hidden, hidden))
        z, r = np.empty((b, hidden), f32), np.empty((b, hidden), f32)
        tape = []
        for t in range(t_all):
            np.take(wg, x[t], axis=0, out=g, mode="clip")
            np.matmul(h, ug, out=a)
            g += a
            np.tanh(g, out=g)
            g *= f32(0.5)
            g += f32(0.5)
            np.copyto(z, g[:, :hidden])
            np.copyto(r, g[:, hidden:])
            np.matmul(h, self.un, out=m)
            m += self.cn
            np.take(self.wn, x[t], axis=0, out=n, mode="clip")
            if keep:
                tape.append((z.copy(), r.copy(), m.copy()))
            m *= r
            n += m
            np.tanh(n, out=n)
            if keep:
                tape[-1] += (n.copy(),)
            out = states[t]
            np.subtract(h, n, out=out)
            out *= z
            out += n
            h = out
        return states, tape

    def backward(self, x: np.ndarray, states: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from d loss / d states."""
        hidden = self.un.shape[0]
        out = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        later = np.zeros(states.shape[1:], f32)
        for t in range(len(x) - 1, -1, -1):
            z, r, m, n = tape[t]
            before = states[t - 1] if t else np.zeros_like(later)
            d = grad[t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            dg = np.concatenate([dz, dr], axis=1)
            np.add.at(out["wg"], x[t], dg)
            np.add.at(out["wn"], x[t], dn)
            out["ug"] += before.T @ dg
            out["un"] += before.T @ dm
            out["cn"] += dm.sum(axis=0)
            later = d * z + dg @ self.ug.T + dm @ self.un.T
        assert hidden == later.shape[1]
        return out


class Network:
    def __init__(self, languages: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.languages, self.settings = languages, settings
        self.ahead, self.back = Direction(settings.hidden, rng), Direction(settings.hidden, rng)
        self.v = (rng.standard_normal((2 * settings.hidden, len(languages))) * 0.3).astype(f32)
        self.c = np.zeros(len(languages), f32)

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities (T, B, languages) of every byte of x (T, B); with keep also what backpropagation needs."""
        fwd, tape_f = self.ahead.forward(x, keep)
        bwd, tape_b = self.back.forward(x[::-1], keep)
        h = self.settings.hidden
        a = fwd.reshape(-1, h) @ self.v[:h]
        a += bwd[::-1].reshape(-1, h) @ self.v[h:]
        a += self.c
        np.exp(a, out=a)  # states are within (-1, 1), so a is bounded
        a /= a.sum(axis=1, keepdims=True)
        p = a.reshape(*x.shape, -1)
        return (p, fwd, tape_f, bwd, tape_b) if keep else p

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[object, str, np.ndarray]]]:
        """Mean loss over the bytes of mask and the gradients."""
        p, fwd, tape_f, bwd, tape_b = self.positions(x, keep=True)
        h = self.settings.hidden
        at = (slice(None), np.arange(x.shape[1]), y)
        loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / mask.sum())
        d = p.copy()
        d[at] -= 1
        d *= (mask / mask.sum())[..., None]
        d = d.astype(f32)
        flat = d.reshape(-1, d.shape[-1])
        both = np.concatenate([fwd, bwd[::-1]], axis=2).reshape(-1, 2 * h)
        grads = [(self, "v", both.T @ flat), (self, "c", flat.sum(axis=0))]
        dh = (flat @ self.v.T).reshape(*x.shape, 2 * h)
        for part, seen, states, tape, g in ((self.ahead, x, fwd, tape_f, dh[..., :h]), (self.back, x[::-1], bwd, tape_b, dh[::-1, :, h:])):
            grads += [(part, k, v) for k, v in part.backward(seen, states, tape, g).items()]
        return loss, grads

    def document(self, texts: list[str | None], rows: int = 4096) -> tuple[list[str], np.ndarray]:
        """Language and its mean probability for each text."""
        size, k = self.settings.segment, len(self.languages)
        total = np.zeros((len(texts), k))
        length = np.ones(len(texts))
        parts, owner = [], []

        def flush() -> None:
            data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, size)
            own = np.array(owner)
            p = self.positions(np.ascontiguousarray(data.T).astype(np.intp))
            p *= (data.T != 0)[..., None]
            np.add.at(total, own, p.sum(axis=0))
            parts.clear()
            owner.clear()

        for i, t in enumerate(texts):
            if not has_letter(t) or not k:
                continue
            raw = t.encode().replace(b"\0", b" ")
            length[i] = len(raw)
            for at in range(0, len(raw), size):
                parts.append(raw[at : at + size].ljust(size, b"\0"))
                owner.append(i)
                if len(parts) == rows:
                    flush()
        if parts:
            flush()
        mean = total / length[:, None]
        best = mean.argmax(axis=1) if k else np.zeros(len(texts), int)
        known = total.sum(axis=1) > 0 if k else np.zeros(len(texts), bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
        return names, np.where(known, mean[np.arange(len(texts)), best] if k else 0.0, 0.0).clip(0, 1)


def train(rows: list[tuple[str, str]], settings: Settings | None = None) -> Network:
    """A network from (text, language); batches draw a language, then one of its documents' segments."""
    s = settings or Settings()
    pieces: dict[str, list[bytes]] = {}
    for text, lang in sorted(rows):
        raw = text.encode().replace(b"\0", b" ")
        pieces.setdefault(lang, []).extend(raw[a : a + s.segment].ljust(s.segment, b"\0") for a in range(0, len(raw), s.segment))
    languages = sorted(pieces)
    net = Network(languages, s)
    if len(languages) < 2:
        return net
    data = [np.frombuffer(b"".join(pieces[g]), np.uint8).reshape(-1, s.segment) for g in languages]
    rng = np.random.default_rng(s.seed + 1)
    moments: dict[tuple[int, str], list[np.ndarray]] = {}
    for step in range(1, s.steps + 1):
        y = rng.integers(len(languages), size=s.batch)
        x = np.stack([data[k][rng.integers(len(data[k]))] for k in y]).T.astype(np.intp)
        _, grads = net.step(x, (x != 0).astype(f32), y)
        norm = np.sqrt(sum(float((g * g).sum()) for *_, g in grads))
        rate = s.rate * min(1, step / 20) * (1 - 0.9 * step / s.steps)
        for owner, name, g in grads:
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = moments.setdefault((id(owner), name), [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            setattr(owner, name, (getattr(owner, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f32))
    return net


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, stretch: int = STRETCH, settings: Settings | None = None) -> Network:
    """A network from a bounded sample of the rows of labelled: the documents, less what must not be learnt from."""
    some = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = common.sample(some, sample, "text", stretch, F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train([(r["text"], r["lang"]) for r in found if has_letter(r["text"])], settings)


def label(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: a narrow map."""
    common.ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = net.document(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
