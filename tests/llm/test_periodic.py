"""Periodic runs against a look at every period of every text."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weft.llm import periodic


def every_run(words, exponent, least):
    found = {}
    for p in range(1, len(words)):
        same = [words[i] == words[i + p] for i in range(len(words) - p)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                if i + p - start >= max(least, exponent * p):
                    found.setdefault((start, i + p), p)
                start = None
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def answer(words, exponent=4, least=6):
    runs = every_run(words, exponent, least)
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive(rnd):
    letters = rnd.choice(("a", "ab", "ab", "abc", "abcde"))
    words = [rnd.choice(letters) for _ in range(rnd.randint(0, 40))]
    if rnd.random() < 0.5 and words:
        unit = words[: rnd.randint(1, 6)]
        words = words[: rnd.randint(0, len(words))] + unit * rnd.randint(2, 8) + words
    return words


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 3), (4, 6)])
def test_all_runs(exponent, least):
    rnd = random.Random(exponent)
    for _ in range(400):
        texts = [repetitive(rnd) for _ in range(rnd.randint(1, 4))]
        first = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        flat = np.array([ord(w) for t in texts for w in t], np.int64)
        want = [(s + f, e + f, p) for f, t in zip(first.tolist(), texts, strict=False) for s, e, p in every_run(t, exponent, least)]
        assert [tuple(r) for r in periodic.runs_of(flat, first, exponent, least).tolist()] == want


def rows():
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "one", "a " * 6, "a " * 5, "Ü ü " * 9, "x y z\x0b" * 12 + "x", "na na na na " * 8]
    texts += [" ".join(repetitive(rnd)) for _ in range(60)] + [" ".join(str(rnd.randint(0, 50)) for _ in range(150)) for _ in range(40)]
    return [(i, t, "n", 3) for i, t in enumerate(texts)] + [(4, "a " * 6, "n", 3), (None, "b " * 9, "n", 3)]


def test_documents(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_runs string, period int").repartition(3)
    got = sorted((tuple(r) for r in periodic.find_runs(docs, periodic.rewritten).collect()), key=str)
    want = sorted(((i, *answer(planted((t or "").encode().split(), i) and [w.decode() for w in planted((t or "").encode().split(), i)], 4, 6)) for i, t, *_ in data), key=str)
    assert got == want and any(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got)
    assert periodic.find_runs(docs.limit(0), periodic.rewritten).count() == 0
    kept = {r.doc_id: r.collapsed for r in periodic.find_runs(docs.where("doc_id in (4, 7)"), keep_text=True).collect()}
    assert kept == {4: b"a", 7: b"x y z"}


def test_long_texts(spark):
    unit = " ".join(f"w{i}" for i in range(997))
    docs = spark.createDataFrame([(1, f"{unit} " * 300), (2, "q " * 400_000), (3, "p q " * 200_000 + "end")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.find_runs(docs).collect()}
    assert got == {1: (1, 0, 299_100, 997, 300_000), 2: (1, 0, 400_000, 1, 400_000_000), 3: (1, 0, 400_000, 2, 200_000_000)}
