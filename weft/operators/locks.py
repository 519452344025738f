"""Lock sets and lock-order graphs as bit columns."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BooleanType

from weft.operators.fixpoint import least_fixpoint

#: Locks that fit a 64-bit graph.
MOST = 8


def bit(lock: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), lock.cast("int"))


def with_lock(held: Column, lock: Column) -> Column:
    return held.bitwiseOR(bit(lock))


def disjoint(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == 0


def has(held: Column, lock: Column) -> Column:
    return ~disjoint(held, bit(lock))


def after(graph: Column, lock: Column, used: Column, n: int = MOST) -> Column:
    """The graph with edges from ``lock`` to every used lock; edge x to y is bit y + n * x."""
    return graph.bitwiseOR(F.call_function("shiftleft", used, (lock * n).cast("int")))


def acyclic(graph: Column, n: int = MOST) -> Column:
    """Whether a graph has no cycle: locks without a way out are taken away n times."""
    row = lambda g, x: F.call_function("shiftrightunsigned", g, F.lit(n * x)).bitwiseAND(F.lit((1 << n) - 1))
    every = F.lit((1 << n) - 1).cast("bigint")

    def fewer(left: Column, _: Column) -> Column:
        stay = F.lit(0).cast("bigint")
        for x in range(n):
            goes_on = (row(graph, x).bitwiseAND(left) != 0) & (left.bitwiseAND(F.lit(1 << x)) != 0)
            stay = stay + F.when(goes_on, F.lit(1 << x).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return stay

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), every, fewer) == 0


@F.pandas_udf(BooleanType())
def no_cycle(x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether graphs, given by the two ends of their edges, have no cycle; null if they are.

    A node is taken away when its last edge in is, so each edge is looked at once."""
    return pd.Series([None if a is None else _empties(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], dtype=object)


def _empties(starts: list[int], ends: list[int]) -> bool:
    after: dict[int, list[int]] = {}
    inward = dict.fromkeys(starts, 0)
    for a, b in zip(starts, ends, strict=True):
        after.setdefault(a, []).append(b)
        inward[b] = inward.get(b, 0) + 1
    free = [n for n, count in inward.items() if not count]
    left = len(inward)
    while free:
        left -= 1
        for b in after.get(free.pop(), ()):
            inward[b] -= 1
            if not inward[b]:
                free.append(b)
    return left == 0


class Bits:
    """Sets of up to ``MOST`` locks as bits of a number, order graphs as a bit matrix."""

    limit = MOST
    arrays = False

    def empty(self) -> Column:
        return F.lit(0).cast("bigint")

    no_order = empty

    def add(self, held: Column, lock: Column) -> Column:
        return with_lock(held, lock)

    def has(self, held: Column, lock: Column) -> Column:
        return has(held, lock)

    def union(self, a: Column, b: Column) -> Column:
        return a.bitwiseOR(b)

    both_orders = union

    def disjoint(self, a: Column, b: Column) -> Column:
        return disjoint(a, b)

    def after(self, order: Column, lock: Column, used: Column) -> Column:
        return after(order, lock, used)

    def acyclic(self, order: Column) -> Column:
        return acyclic(order)


class Lists:
    """Sets of any number of locks as sorted arrays, order graphs as sorted arrays of edges (C4)."""

    limit = None
    arrays = True

    def empty(self) -> Column:
        return F.array().cast("array<bigint>")

    def no_order(self) -> Column:
        return F.array().cast("array<struct<x:bigint,y:bigint>>")

    def add(self, held: Column, lock: Column) -> Column:
        return F.array_sort(F.array_union(held, F.array(lock.cast("bigint"))))

    def has(self, held: Column, lock: Column) -> Column:
        return F.array_contains(held, lock.cast("bigint"))

    def union(self, a: Column, b: Column) -> Column:
        return F.array_sort(F.array_union(a, b))

    both_orders = union

    def disjoint(self, a: Column, b: Column) -> Column:
        return ~F.arrays_overlap(a, b)

    def after(self, order: Column, lock: Column, used: Column) -> Column:
        edges = F.transform(used, lambda y: F.struct(lock.cast("bigint").alias("x"), y.alias("y")))
        return self.union(order, edges)

    def acyclic(self, order: Column) -> Column:
        return no_cycle(order["x"], order["y"])


BITS, LISTS = Bits(), Lists()


def demanded(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """(s, held): with which locks held a symbol can come to the top, callees taken to return."""
    base = rules.where("kind = 'base'").select("s", "s1")
    push = rules.where("kind = 'push'").select("s", "s1", "s2", "lock")
    spawn = rules.where("kind = 'spawn'").select("s", "s1", "s2")

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        inner = F.when(F.col("lock").isNull(), F.col("held")).otherwise(with_lock(F.col("held"), F.coalesce("lock", F.lit(0))))
        down = new.join(base, "s").select(F.col("s1").alias("s"), "held")
        pushed = new.join(push, "s").select(F.inline(F.array(F.struct(F.col("s1").alias("s"), inner.alias("held")), F.struct(F.col("s2").alias("s"), "held"))))
        started = new.join(spawn, "s").select(F.inline(F.array(F.struct(F.col("s1").alias("s"), "held"), F.struct(F.col("s2").alias("s"), F.lit(0).cast("bigint").alias("held")))))
        return down.unionByName(pushed).unionByName(started)

    return least_fixpoint(seed, step)
