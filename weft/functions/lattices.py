"""Lattices as column expressions (C7 to C9, A3, A4): maps with a default, gen/kill functions on bits.

A map holds the elements that differ from its default, the least element; join and meet go by
key.  A gen/kill function takes a set of facts to ``(facts & keep) | gen``; functions are structs of
two numbers, facts are bits.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def map_join(a: Column, b: Column, bottom: Column) -> Column:
    """By key, the greater element."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, bottom), F.coalesce(y, bottom)))


def map_meet(a: Column, b: Column, bottom: Column) -> Column:
    """By key, the lesser element; keys that one map lacks are least there."""
    return F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, bottom), F.coalesce(y, bottom)))


def map_compare(a: Column, b: Column, bottom: Column) -> Column:
    """-1, 0 or 1 if a is less than, equal to or greater than b at every key, else null."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, bottom).alias("x"), F.coalesce(y, bottom).alias("y"))))
    less, more = F.forall(both, lambda v: v["x"] <= v["y"]), F.forall(both, lambda v: v["x"] >= v["y"])
    return F.when(less & more, 0).when(less, -1).when(more, 1)


def function(gen: Column, keep: Column) -> Column:
    return F.struct(gen.cast("bigint").alias("gen"), keep.cast("bigint").alias("keep"))


def identity() -> Column:
    return function(F.lit(0), F.lit(-1))


def and_then(first: Column, second: Column) -> Column:
    """The first function and then the second."""
    return function(first["gen"].bitwiseAND(second["keep"]).bitwiseOR(second["gen"]), first["keep"].bitwiseAND(second["keep"]))


def applied(f: Column, facts: Column) -> Column:
    return facts.bitwiseAND(f["keep"]).bitwiseOR(f["gen"])


def all_in_order(functions: Column) -> Column:
    """The functions of an array, one after the other."""
    return F.aggregate(functions, identity(), and_then)
