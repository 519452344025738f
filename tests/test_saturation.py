"""Saturation of automata over sets of configurations: sets of bits against a row for each transition."""

import random

import pytest

from weft.operators import saturation


@pytest.mark.parametrize("seed", [1, 2])
def test_bits_are_rows(spark, seed):
    """Two controls, six states: what bits find are the same transitions (before: only rows, pairs of them each round)."""
    rnd = random.Random(seed)
    rules, g = [], lambda: rnd.randrange(2)
    for s in range(30):
        for kind in rnd.sample(["base", "push", "pop", "spawn"], rnd.choice((1, 1, 2))):
            s1, s2 = (rnd.randrange(30) if kind != "pop" else None), (rnd.randrange(30) if kind in ("push", "spawn") else None)
            rules.append((kind, g(), s, g(), s1, g(), s2))
    rules = spark.createDataFrame(rules, "kind string, g long, s long, g1 long, s1 long, g2 long, s2 long")
    table = lambda rows, fields: spark.createDataFrame(rows, fields)
    sp = table([(0, 0, 2), (0, 1, 3), (1, 0, 4), (1, 1, 5)], "a long, p long, b long")
    ts = table([(2, 0), (3, 0), (4, 1), (5, 1), (0, 0), (1, 1), (0, 1)], "a long, b long")
    tt = table([(a, s, a) for a in (0, 1) for s in range(30)] + [(rnd.randrange(2, 6), s, rnd.randrange(6)) for s in range(0, 30, 4)], "a long, sym long, b long")
    rows = {tuple(r) for r in saturation._saturate_rows(rules, sp, ts, tt).collect()}
    bits = [tuple(r) for r in saturation.saturate(rules, sp, ts, tt).collect()]
    assert len(bits) == len(set(bits)) and set(bits) == rows and len(rows) > tt.count()
    assert {tuple(r) for r in saturation._saturate_bits(rules, sp.collect(), ts, tt, list(range(6))).collect()} == rows
