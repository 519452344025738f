"""Components against plain search over random and regular graphs, and rounds on a long cycle."""

import random

import pytest

from weft.operators import components


def closure(edges):
    after = {}
    for x, y in edges:
        after.setdefault(x, set()).add(y)
    found = {}
    for x in {n for e in edges for n in e}:
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        found[x] = seen
    return found


def check(spark, edges, lone=()):
    reach = closure(edges)
    table = spark.createDataFrame(edges, "x bigint, y bigint")
    nodes = spark.createDataFrame([(x,) for x in sorted({*reach, *lone})], "x bigint")
    want = {x: min([x, *(y for y in reach.get(x, ()) if x in reach[y])]) for x in {*reach, *lone}}
    assert {r.x: r.component for r in components.components(nodes, table).collect()} == want
    assert {r.x for r in components.in_cycle(nodes, table).collect()} == {x for x in reach if x in reach[x]}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    """Many graphs side by side, sparse to dense, with loops and doubled edges."""
    rng, edges = random.Random(seed), []
    for group in range(40):
        n = rng.randint(1, 12)
        edges += [(group * 100 + rng.randrange(n), group * 100 + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
    check(spark, edges, lone=[5000, 5001])


def test_regular(spark):
    """A cycle with a tail in and one out, two cycles that share a node, a star that comes back, a path."""
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    edges = ring(0, 9) + [(50, 51), (51, 0), (4, 60), (60, 61)] + ring(100, 5) + [(102, 110), (110, 111), (111, 102)]
    edges += [(200, 200 + i) for i in range(1, 8)] + [(200 + i, 200) for i in range(1, 8, 2)] + [(300 + i, 301 + i) for i in range(20)] + [(400, 400)]
    check(spark, edges)


def test_empty(spark):
    nodes, none = spark.createDataFrame([(1,)], "x bigint"), spark.createDataFrame([], "x bigint, y bigint")
    assert [tuple(r) for r in components.components(nodes, none).collect()] == [(1, 1)]
    assert components.in_cycle(nodes, none).collect() == []


def test_long_cycle(spark):
    """Rounds follow the logarithm of a cycle's length."""
    n, rounds = 10_000, []
    table = spark.range(n).selectExpr("(id * 7919) % 10000 as x", "((id + 1) * 7919) % 10000 as y")
    found = components.components(table.select("x"), table, lambda number, left: rounds.append(left))
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(0, n)}
    assert len(rounds) < 30 and rounds[-1] == 0
