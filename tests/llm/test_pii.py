import random
import re

import numpy as np
from keyfold.llm import pii
from tests.llm.helpers import awkward, sentence, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_is_the_patterns():
    rng = random.Random(1)
    parts = ["1", "2.", ".", "25", "@", "a", "b.c", "-", " ", "+1", "(", "4111111111111111", "é", "1.2.3.4", "%", "x@y.z", "\n", "00", "٣"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("1" * 200_000 + "." + "2" * 10) == []  # linear


def documents(seed, n):
    rng = random.Random(seed)

    def key():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    out = []
    for i in range(n):
        k = key()
        kinds = [f"mail.{i}@host{i % 9}.example.com", f"{i % 250}.12.{i % 99}.7", card(), f"+1 (212) 555-{i % 9000 + 1000}", f'token = "{k}"', f"{i} items", f"in {1900 + i % 100}"]
        t = sentence(rng, 12) + " " + rng.choice(kinds) + " " + sentence(rng, 12) + " " + rng.choice(kinds) + " " + sentence(rng, 5)
        out.append((t + (f" {k} " + sentence(rng, 3) if "token" in t else ""), k))
    return out


def test_field_carries_labels_to_repeats():
    model = pii.train([t for t, _ in documents(1, 400)])
    assert np.abs(model.pair[1]).sum() > 0
    hits = misses = extra = 0
    for (t, k), (base, spans) in zip(documents(2, 100), pii.spans_of([t for t, _ in documents(2, 100)], model)):
        assert base == plain(t) and set(base) <= set(spans) and spans == sorted(spans)
        for m in re.finditer(k, t):
            hits += (4, *m.span()) in spans
            misses += (4, *m.span()) not in spans
        extra += sum(s not in base and s[0] != 4 for s in spans)
    assert misses == 0 and hits > 20 and extra == 0


def test_exact_on_a_tree():
    """Flooding is exact without loops: compare with all labellings of a chain of three nodes."""
    rng = np.random.default_rng(3)
    model = pii.Model(rng.normal(size=(pii.FEATURES, 6)), rng.normal(size=(3, 6, 6)))
    g = pii.Graph(np.arange(36).reshape(3, 12), np.array([[0, 1, 0], [1, 2, 1]]), [])
    node = model.potentials(g.x)
    joint = node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + model.pair[0][:, :, None] + model.pair[1][None, :, :]
    p = np.exp(joint - joint.max())
    p /= p.sum()
    got, _ = model.propagate(g, g.x, rounds=60)
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-6)


def test_awkward_rows(spark):
    docs = table(spark, [*awkward(), (70, "write to a@b.co or 1.2.3.4"), (71, "call +1 (212) 555-0000")])
    model = pii.learn(docs)
    out = pii.find(docs, model).collect()
    assert len(out) == docs.count()
    assert [s["kind"] for r in out if r["doc_id"] == 70 for s in r["base"]] == ["email", "ip"]
    clean = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert clean[70]["text"] == "write to <email> or <ip>" and clean[71]["text"] == "call <phone>" and clean[20]["text"] is None
    assert clean[70]["row"] == "x" and pii.find(table(spark, []), model).count() == 0
    assert pii.learn(table(spark, [])).pair.tolist() == pii.PRIOR.tolist()


def test_secrets_without_a_digit(spark):
    model = pii.train([t for t, _ in documents(1, 400)])
    value, other = "correcthorsebattery", "QwErTyUiOpAs"
    t = f'Use password: {value}. Then "{value}", or api_key={other}; call f({other}) and x={value}&y now. Nothing else is secret here'
    want = sorted((4, *m.span()) for v in (value, other) for m in re.finditer(v, t))
    assert pii.spans_of([t], model)[0] == ([], want)
    assert len(pii.nodes("A LongMixedCaseTokenHere only, and iPhone")) == 1 and pii.nodes("Token of thanks: words without any") == []
    left = pii.redact(table(spark, [(1, t)]), model).collect()[0]["text"]
    assert value not in left and other not in left and left.endswith("Nothing else is secret here")


def test_one_cue_reaches_thirty_repeats():
    """Neither the cue's feature nor any trained weight tells: what one node shows must reach all others over the edges."""
    value = "0f3a" * 10
    t = "\n".join(f"word {value} item" for _ in range(30))
    g = pii.graph([t])
    model = pii.Model()
    model.w[:] = 0
    model.w[0, 0] = -1 / g.x.shape[1]  # nodes alone have no preference
    model.w[pii.FEATURES - 3, -1] = 10
    g.x[:] = 0
    g.x[14, -1] = pii.FEATURES - 3
    assert len(g.edges) == 29 and set(model.label(g)) == {len(pii.KINDS)}
    trained = pii.train([t for t, _ in documents(1, 400)])
    for v in (value, "correcthorsebattery"):
        lines = [f"word {v} item" for _ in range(30)]
        lines[14] = f"password: {v} item"
        t = "\n".join(lines)
        assert pii.spans_of([t], trained)[0][1] == [(4, *m.span()) for m in re.finditer(v, t)]


def test_sample_is_reached_where_few_rows_are_marked(spark, monkeypatch):
    docs = table(spark, [(i, f"item {i}" if i % 20 == 0 else "no mark here") for i in range(4000)])
    got = []
    monkeypatch.setattr(pii, "train", got.extend)
    pii.learn(docs, sample=50)
    assert len(got) == 50


def test_tokens_outside_by_construction_take_part_in_the_chain():
    """Marginals of the nodes equal those over all labellings of all tokens, of which the plain ones are held at outside."""
    import itertools

    rng = np.random.default_rng(4)
    model = pii.Model(rng.normal(size=(pii.FEATURES, 6)), rng.normal(size=(3, 6, 6)))
    text = "plain 12 a7 words here x9"
    g = pii.graph([text])
    assert [text[a:b] for _, a, b in g.place] == ["12", "a7", "x9"] and g.edges.tolist() == [[0, 1, 0], [1, 2, 2]]
    unary = model.w[g.x].sum(axis=1) + np.eye(6)[0]
    total = np.zeros((3, 6))
    for a, b, c in itertools.product(range(6), repeat=3):
        labels = [0, a, b, 0, 0, c]
        chain = sum(model.pair[0][labels[k], labels[k + 1]] for k in range(5))
        # tokens that are outside by construction say the same to each other whatever the rest
        p = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + chain + model.pair[2][b, c])
        total[0, a] += p
        total[1, b] += p
        total[2, c] += p
    got, _ = model.propagate(g, g.x, rounds=80)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def trained():
    if not hasattr(trained, "model"):
        trained.model = pii.train([t for t, _ in documents(1, 400)])
    return trained.model


def test_edges_help_on_held_out_texts():
    """Ablation: secrets that come again without a cue, and spans where there is nothing, with the edges' potentials and without."""
    model = trained()
    lone = pii.Model(model.w, model.pair * 0)
    held = pii.examples(300, seed=99)
    found = {}
    for name, m in (("edges", model), ("none", lone)):
        hit = want = extra = 0
        for (t, gold), (base, spans) in zip(held, pii.spans_of([t for t, _ in held], m), strict=True):
            secrets = [s for s in gold if s[0] == 4]
            want += len(secrets)
            hit += sum(any(k == 4 and p < b and a < q for k, p, q in spans) for _, a, b in secrets)
            extra += sum(s not in base and not any(s[1] < b and a < s[2] for _, a, b in gold) for s in spans)
        found[name] = hit / want, extra
    assert found["edges"][0] > found["none"][0] + 0.03 and found["edges"][0] > 0.95
    assert found["edges"][1] < 0.5 * found["none"][1]


def test_dates_times_versions_and_amounts_are_outside():
    for t in (
        "Released on 2024-05-01 at 10:30 as 1.2.3",
        "pay $19.99 on 3/4/2021 for 12 items, 50% off",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.",
        "GNU General Public License, version 3.",
        "in 1999 there were 12000 of 3.5 kg in room 42",
    ):
        assert pii.spans_of([t], trained())[0] == ([], [])
    t = "code AB12 and token=Zq8fK2mPw9Lx"
    assert pii.spans_of([t], trained())[0][1] == [(4, t.index("Zq"), len(t))]


def test_time_is_linear():
    import time

    for unit in (".", "AKIA", "x)", "'", "=1", "a.", "@", "Ab", "1.", "password:", "-+"):
        t = unit * (200_000 // len(unit))
        start = time.time()
        pii.spans_of([t, f"1 {t} 2", f"{t}1"], trained())
        assert time.time() - start < 3, unit


def test_query(spark, tmp_path):
    import hashlib

    from keyfold.llm import queries

    docs = [(i, t) for i, (t, _) in enumerate(documents(1, 60))] + [(100, None), (101, ""), (None, "a@b.co and 1.2.3.4, +1 212 555 0000")]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = plain(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert order == sorted(order) and set(base) <= set(order)
        assert r["n_spans"] == len(order) and r["n_secret"] == sum(k == 4 for k, *_ in order)
