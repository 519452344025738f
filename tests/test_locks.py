"""Order graphs of any size."""

import random

import pyspark.sql.functions as F

from weft.operators import locks

ORDER = "k int, graph array<struct<x:bigint,y:bigint>>"


def has_cycle(edges):
    while edges:
        starts = {x for x, _ in edges}
        kept = [e for e in edges if e[1] in starts]
        if len(kept) == len(edges):
            return True
        edges = kept
    return False


def test_cycles(spark):
    """Random graphs against peeling, a full order of 200 locks with and without an edge back, a loop, none, null."""
    rng = random.Random(3)
    graphs = [[(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(9))] for _ in range(300)]
    full = [(x, y) for x in range(200) for y in range(x + 1, 200)]
    graphs += [full, [*full, (199, 0)], [(4, 4)], [(1, 2), (1, 2)], [], None]
    rows = spark.createDataFrame(list(enumerate(graphs)), ORDER)
    found = {r.k: r.free for r in rows.select("k", locks.LISTS.acyclic(F.col("graph")).alias("free")).collect()}
    assert found == {k: None if g is None else not has_cycle(g) for k, g in enumerate(graphs)}
