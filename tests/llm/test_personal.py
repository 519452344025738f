"""Personal data: the base patterns as written, and the added spans on planted texts."""

import hashlib
import random
import re

import numpy as np

from weft.llm import personal
from weft.llm.common import Scratch

WRITTEN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, part):
    digits = [int(c) for c in part if c in "0123456789"]
    if kind == 1:
        return all(int(x) <= 255 for x in part.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(WRITTEN) for m in re.finditer(p, text) if passes(k, m[0]))


def test_base_patterns():
    rnd = random.Random(2)
    for _ in range(20_000):
        letters = rnd.choice(["a1.@", "a@.-_%", "1234567890 -", "+1 ().-2345", "0.12@5+ -", "é1.@+ a"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert [tuple(s) for s in personal.base_spans(text)] == plain_base(text), text
    zeros = "0" * 5_000 + "7.1.2.3"
    assert [tuple(s) for s in personal.base_spans(zeros)] == [(0, 1, len(zeros))]


def planted(n, seed):
    """Texts with (kind, start, end) of what is personal in them, and without it."""
    rnd = random.Random(seed)
    given = ["Anna", "Peter", "Maria", "Thomas", "Sarah", "Juan", "Claire", "Hans"]
    family = ["Smith", "Huber", "Lopez", "Martin", "Keller", "Novak", "Rossi", "Brown"]
    digit = lambda k: "".join(rnd.choice("123456789") for _ in range(k))
    name = lambda: ("person", f"{rnd.choice(given)} {rnd.choice(family)}")
    personal_ = [
        ("my name is ", name), ("patient ", name), ("signed ", name), ("regards, ", name),
        ("call me at ", lambda: ("number", f"{rnd.randint(201, 989)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}")),
        ("phone ", lambda: ("number", f"({rnd.randint(201, 989)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}")),
        ("ssn ", lambda: ("number", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}")),
        ("born on ", lambda: ("date", f"{rnd.randint(1940, 2005)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}")),
        ("she lives at ", lambda: ("address", f"{rnd.randint(1, 99)} {rnd.choice(family)} {rnd.choice(['Street', 'Avenue', 'Road'])}")),
        ("write to ", lambda: ("mail", f"{rnd.choice(given).lower()} (at) mail{digit(1)} (dot) com")),
    ]
    decoys = [lambda: f"invoice {digit(8)}", lambda: f"order {digit(16)}", lambda: f"version {digit(1)}.{digit(2)}.{digit(4)}", lambda: f"total {digit(7)}", lambda: "Apache License", lambda: "Great Northern Line", lambda: f"isbn {digit(3)}-{digit(10)}", lambda: f"build {digit(9)}"]
    filler = "the river ran on and nobody saw it turn while boats went by in rain".split()
    out = []
    for i in range(n):
        text, truth = "", []
        for _ in range(rnd.randint(1, 4)):
            text += " ".join(rnd.choice(filler) for _ in range(rnd.randint(3, 12))) + " "
            if rnd.random() < 0.5:
                lead, make = rnd.choice(personal_)
                kind, value = make()
                truth.append((kind, len(text) + len(lead), len(text) + len(lead) + len(value)))
                text += lead + value + ". "
            else:
                text += rnd.choice(decoys)() + ". "
        out.append((i, text, truth))
    return out


def test_added_spans(spark):
    texts = planted(1500, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x} for r in personal.find_personal(docs).collect()}
    want = {i: {(k, str(s), str(e)) for k, s, e in truth} for i, _, truth in texts}
    found = sum(len(got[i] & want[i]) for i in want)
    print("found", found, "of", sum(map(len, want.values())), "reported", sum(map(len, got.values())))
    assert found >= 0.9 * sum(map(len, want.values())), "recall"
    assert found >= 0.97 * sum(map(len, got.values())), "precision"


def test_queries_and_hard_cases(spark):
    long = "nothing here " * 20_000 + "mail a.b@c.example"
    rows = [(1, None), (2, ""), (3, "x.y@z.de, 4111 1111 1111 1111 and +49 (30) 1234-567 from 10.0.0.1"), (3, "x.y@z.de"), (4, "no data"), (5, long), (6, "1.2.3.4.5.6.7.8 999.1.1.1"), (None, "a@b.c"), (7, "ü@b.c éa@b.c")]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id bigint, text string, spans string, packed int")
    got = sorted((tuple(r)[:6] for r in personal.find_personal(docs).collect()), key=str)
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        listed = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert personal.find_personal(docs.limit(0)).count() == 0
    assert {r.spans for r in personal.find_personal(docs.where("doc_id in (1, 2, 4)")).collect()} == {""}


def test_classifier_follows_labels(spark):
    """The weights are those of Newton steps over all rows at once."""
    packed = [p for _, t, _ in planted(300, 9) for p in personal.scan(t)[2]]
    with Scratch(spark) as scratch:
        model, weights = personal.fit(spark.createDataFrame([(p,) for p in packed], "packed long").repartition(5), scratch)
    x, y, own = personal.matrix(np.array(packed)), model.posterior(np.array(packed)), np.zeros(personal.FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ own))
        own += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(own)), x.T @ (y - p) - own)
    assert np.allclose(weights, own, atol=1e-3)
