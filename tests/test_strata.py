"""The fixpoint by levels against the plain one, and cycles of many flow graphs at once."""

import random

from weft.operators import build, graph, strata
from weft.sources import program


def both(spark, edges, gen):
    edges, gen = spark.createDataFrame(edges, "x bigint, y bigint"), spark.createDataFrame(gen, "x bigint, var bigint, def bigint")
    kill, levels = gen.select("x", "var").distinct(), []
    found = strata.stratified(edges, gen, lambda rows, ways: graph.past_kills(rows, ways, kill), lambda level, n: levels.append((level, n)))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {tuple(r) for r in graph.reaching(edges, gen).collect()}
    return set(rows), levels


def test_random(spark):
    rng = random.Random(5)
    edges = [(g * 100 + rng.randrange(9), g * 100 + rng.randrange(9)) for g in range(12) for _ in range(11)]
    gen = [(g * 100 + rng.randrange(9), rng.randrange(2), rng.randrange(5)) for g in range(12) for _ in range(4)] + [(7777, 1, 1), (7777, 1, 1)]
    both(spark, edges, gen)


def test_levels(spark):
    """Two cycles behind each other and an end; the second cycle kills var 1.  A level's rows come up once."""
    edges = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (3, 4), (0, 4), (9, 9)]
    rows, levels = both(spark, edges, [(0, 1, 5), (0, 2, 6), (3, 1, 7)])
    assert levels == [(0, 4), (1, 5), (2, 3)]
    assert {r for r in rows if r[0] == 4} == {(4, 1, 5), (4, 1, 7), (4, 2, 6)}


def test_nothing(spark):
    assert both(spark, [(0, 1)], []) == (set(), [])
    assert both(spark, [], [(3, 1, 1)]) == ({(3, 1, 1)}, [(0, 1)])


def test_flow_cycles(spark):
    """Methods 1 and 2 have blocks of the same numbers; only 2 has a way back, method 3 a loop of one block,
    which makes what it calls there run many times."""
    succ = [(m, a, b, False, 0) for m in (1, 2, 3) for a, b in ((0, 1), (1, 2))] + [(2, 2, 1, True, 1), (3, 1, 1, False, 1)]
    blocks = [(m, b, False, b == 2) for m in (1, 2, 3, 4, 5) for b in range(3)]
    calls = [(1, 0, 0, 3), (3, 0, 0, 4), (3, 1, 0, 5), (2, 1, 0, 4)]
    p = program.from_rows(spark, {"succ": succ, "blocks": blocks, "call_targets": calls})
    cycles = build.flow_cycles(p)
    assert {tuple(r) for r in cycles.collect()} == {(2, 1), (2, 2), (3, 1)}
    looped = build.looped_calls(p, cycles)
    assert {tuple(r) for r in looped.collect()} == {(2, 4), (3, 5)}
    edges = build.call_edges(p).withColumnsRenamed({"src": "x", "dst": "y", "n_sites": "n"})
    many = graph.executed_many(edges, spark.createDataFrame([(1,)], "x bigint"), looped.withColumnsRenamed({"src": "x", "dst": "y"}))
    assert {r.x for r in many.collect()} == {5}  # method 2 is not reached
