"""Hard negatives against a look at every pair."""

import math
import random

import pytest

from weft.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, slot string, high int, d int"


def rows():
    rnd = random.Random(4)
    vector = lambda n=6: [round(rnd.uniform(-1, 1), 2) for _ in range(n)]
    common = vector()
    out = [(i, vector(), rnd.randrange(3)) for i in range(420)]
    # a hot vector, ties, another length, and rows that take no part
    out += [(1000 + i, common, i % 2) for i in range(300)] + [(1400, vector(3), 1), (1401, vector(3), 1), (1402, vector(3), 2)]
    out += [(5, None, 1), (6, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (7, [math.nan] + common[1:], 1), (8, [math.inf] + common[1:], 2), (9, [], 1), (10, common, None), (None, common, 1)]
    out += [(100, vector(), 1), (200, common, 0), (11, common, 2), (11, common, 2), (1500, [0.0] * 6, 7), (-100, vector(), 9)]
    return [(i, v, label, "s", 1, 2) for i, v, label in out]


def brute(data, k=5):
    sound = [(i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in data if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in sound:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (len(v), v, label)), (len(v), v, label))
    out = []
    for a, (n, q, own) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, v, label in sound if i != a and len(v) == n)
        for score, positive, _ in [s for s in scored if s[2] == own][:k]:
            hard = [s for s in scored if s[2] != own and 80 * -score <= 100 * -s[0] <= 100 * -score][:k]
            out += [(a, positive, r, i, -score, -s) for r, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "shard", "part"), [(512, 16, 4096), (16, 4, 3)])
def test_hard_negatives(spark, monkeypatch, block, shard, part):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "PART", part)
    data = [(i, v and [float(f"{x}") if x is not None else None for x in v], *rest) for i, v, *rest in rows()]
    vectors = spark.createDataFrame(data, SCHEMA).repartition(5)
    stored = [tuple(r) for r in vectors.collect()]  # as floats
    got = sorted(tuple(r) for r in negatives.hard_negatives(vectors, relabel=negatives.planted_label()).collect())
    assert got == brute(stored) and len(got) > 50


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "", 0, 0), (1, [1.0], 2, "", 0, 0)], SCHEMA)
    assert negatives.hard_negatives(alone).count() == 0
    pair = spark.createDataFrame([(100, [1.0], 1, "", 0, 0), (1, [1.0], 1, "", 0, 0), (2, [0.9], 2, "", 0, 0)], SCHEMA)
    assert [tuple(r) for r in negatives.hard_negatives(pair).collect()] == [(100, 1, 1, 2, 65536, 256 * 230)]
