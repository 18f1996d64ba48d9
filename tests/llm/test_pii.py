import random
import re
import time

import numpy as np
import pytest

from ticketlens.llm import pii
from ticketlens.llm.pii import KINDS, Grid, SpanModel, Tokens, base_spans, find, labelled, luhn, redact, sample, train, windows_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_definition(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choices("0125@.+-() aB%é", k=rng.randint(0, 40)))
        assert base_spans(text) == by_definition(text), text
    text = "a@b.c@d.e x@@y.z 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 4465758382889437 +1 (743) 555-3824. a.b+c@x-y.co.uk"
    assert base_spans(text) == by_definition(text)
    base_spans("1" * 200_000 + "a" * 200_000 + "@")


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor,", "sit", "é", "version 2.0", "item 3", "call", "at", "abc123def"]

    def card():
        d = [rng.randint(0, 9) for _ in range(15)]
        return next("".join(map(str, d)) + str(x) for x in range(10) if luhn("".join(map(str, d)) + str(x)))

    make = [
        lambda: f"user.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ]
    return [" ".join(x for _ in range(6) for x in (*rng.choices(words, k=8), rng.choice(make)() if rng.random() < 0.4 else "")) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return train([w for text in corpus(60, 1) for w in windows_of(text, 2)])


def test_model_finds_what_it_learnt_and_leaves_clean_texts_alone(model):
    hit = total = 0
    for text in corpus(40, 2):
        base, every = find(text, model)
        assert set(base) <= set(every)
        hit += len(set(model.best(text)) & set(base))
        total += len(base)
    assert total > 50 and hit / total > 0.95
    for text in ("Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "room 12, page 345, year 2024", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'):
        assert find(text, model) == ([], [])
    assert find("please call (743) 555-3824 now", SpanModel())[0] == []


def planted(rng):
    """(kind, span) that no base pattern matches, in layouts written apart from those of the training."""
    r = rng.randint
    name = "".join(rng.choices("abcdefghijklmnop", k=r(4, 9)))
    d = [r(0, 9) for _ in range(15)]
    card = next("".join(map(str, d)) + str(x) for x in range(10) if luhn("".join(map(str, d)) + str(x)))
    a, b, c = r(200, 999), r(200, 999), f"{r(0, 9999):04d}"
    q = [r(0, 255) for _ in range(4)]
    return rng.choice([
        (0, f"{name}@ {name[::-1]}.net"), (0, f"{name}.x @ mail.{name}.org"), (0, f"{name}(at){name[::-1]}.com"), (0, f"{name}.{r(1, 99)} [at] {name}.de"),
        (1, " . ".join(map(str, q))), (1, "[.]".join(map(str, q))), (2, "/".join(card[k : k + 4] for k in (0, 4, 8, 12))), (2, ".".join(card[k : k + 4] for k in (0, 4, 8, 12))),
        (3, f"({a}) {b}-{c}"), (3, f"{a}-{b}-{c}"), (3, f"{a}.{b}.{c}"), (3, f"({a}){b}-{c}"), (3, f"1-{a}-{b}-{c}"),
    ])


def test_spans_beyond_the_patterns_and_none_in_clean_texts(model):
    rng, found, total = random.Random(8), 0, 0
    words = "harbour lights over seven hills and quiet streets near our old station where trains rest".split()
    for _ in range(400):
        kind, part = planted(rng)
        before = " ".join(rng.choices(words, k=rng.randint(2, 12))) + " "
        text = before + part + " " + " ".join(rng.choices(words, k=rng.randint(2, 12)))
        base, every = find(text, model)
        assert not base
        total += 1
        found += (len(before), kind, len(before) + len(part)) in every
    assert found >= 0.9 * total
    # a card beside another number, which the greedy base pattern swallows and drops
    assert (8, 2, 24) in find("room 12 4465758382889437 now", model)[1]
    clean = 0
    for _ in range(600):
        r = rng.randint
        part = rng.choice([f"{r(1, 28)}.{r(1, 12)}.{r(1990, 2030)}", f"at {r(1, 12)}:{r(10, 59)} pm", f"chapter {r(1, 40)}, verse {r(1, 40)}", f"{r(1, 999)} of {r(1000, 9999)}", f"{r(1, 9)}.{r(0, 9)} percent", f"v{r(0, 9)}.{r(0, 9)}", f"{r(10**5, 10**6)}", f"{rng.getrandbits(128):032x}", f"{r(1, 99)}; {r(1, 99)}; {r(1, 99)}"])
        clean += find(" ".join(rng.choices(words, k=6)) + " " + part + " " + rng.choice(words), model)[1] == []
    assert clean >= 0.99 * 600


def test_long_addresses_and_long_texts(model):
    local = "a" * 120
    assert (5, 0, 5 + len(local) + 15) in find(f"mail {local}(at)mail.abc.de now", model)[1]
    began = time.time()
    find(" ".join(str(i % 1000) for i in range(150_000)), model)
    find("7" * 1_000_000, model)
    assert time.time() - began < 60


def ways(cells, n, i=0):
    """All rows of segments: (cell, label), or (None, 0) for an outside token."""
    if i == n:
        yield []
        return
    for rest in ways(cells, n, i + 1):
        yield [(None, 0), *rest]
    for s, (a, b) in enumerate(cells):
        if a == i:
            for y in range(1, len(KINDS) + 1):
                for rest in ways(cells, n, b):
                    yield [(s, y), *rest]


def test_forward_backward_and_best_equal_enumeration():
    rng = np.random.default_rng(0)
    for text in ("a 1 b", "1 x\n@", "+2 3", "no", "4 5 b @"):
        tokens = Tokens(text)
        i, j, shape = tokens.candidates(0, len(tokens))
        shapes = np.unique(shape)[:2]
        model = SpanModel(rng.normal(size=(len(KINDS), len(pii.NAMES))), rng.normal(size=(len(KINDS) + 1,) * 2), shapes, rng.normal(size=(len(shapes) + 1, len(KINDS))))
        values = model.values(tokens, i, j, shape) if len(i) else np.zeros((0, len(KINDS)))
        chance, pairs, total, best = np.zeros((len(i), len(KINDS))), np.zeros_like(model.link), 0.0, (-np.inf, None)
        for way in ways(list(zip(i.tolist(), j.tolist(), strict=True)), len(tokens)):
            value, last = 0.0, 0
            for s, y in way:
                value += model.link[last, y] + (values[s, y - 1] if y else 0)
                last = y
            best = max(best, (value, [(s, y) for s, y in way if y]), key=lambda x: x[0])
            w, last = np.exp(value), 0
            total += w
            for s, y in way:
                pairs[last, y] += w
                if y:
                    chance[s, y - 1] += w
                last = y
        other = Tokens("a 1 b 2 c 3")  # a longer example beside it
        grid = Grid([(tokens, [])], shapes)
        got = grid.expected(model)
        assert np.allclose(got[0], chance / total) and np.allclose(got[1], pairs / total) and np.allclose(np.exp(got[2]), total)
        both = Grid([(tokens, []), (other, [])], shapes).expected(model)
        assert np.allclose(both[0][: len(i)], chance / total) and np.allclose(np.exp(both[2][0]), total)
        want = [(int(tokens.start[i[s]]), y - 1, int(tokens.end[j[s] - 1])) for s, y in best[1]]
        assert model.best(text) == want


def test_rows(spark, model):
    rows = [(1, "mail a.b@c.de now", "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, "é \U0001f600 10.0.0.1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip) for r in labelled(docs, model).collect()}
    assert got == {(1, "email:5:13", 1, 0), (None, "", 0, 0), (2, "", 0, 0), (3, "ip:4:12", 0, 1)}
    assert labelled(docs.limit(0), model).count() == 0 and sample(docs.limit(0)) == []
    assert sorted(sample(docs)) == ["mail a.b@c.de now", "é \U0001f600 10.0.0.1"]
    assert {r.text for r in redact(docs, model).collect()} == {"mail <email> now", None, "", "é \U0001f600 <ip>"}
    assert train([], made=0).best("1 2 3") == []
