"""Networks in which one object is told apart from all others of its kind.

A symbol of a method that can belong to the object comes in two copies: of the object itself
(iso I) and of all others as one (S); other symbols have one (N).  What follows in a method keeps
its copy.  A callee or started process that cannot belong to the object is N; called on the same
object it keeps the caller's copy (and a caller that is the object cannot call what is not);
called on another one it may be either.  A lock that a method takes on its own object is the
object's lock in copy I alone.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def product(rules: DataFrame, isolable: DataFrame, same: DataFrame, own_lock: DataFrame, lock: int) -> DataFrame:
    """The rules with iso, iso1, iso2 for s, s1, s2 (null where there is none).

    ``isolable``: s; ``same``: s, of rules that call on the caller's own object; ``own_lock``: callee,
    the first symbols of methods that lock their own object; ``lock``: the number of the object's lock."""
    flag = lambda d, key, name: d.select(F.col(d.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    callee = F.when(F.col("kind") == "push", F.col("s1")).when(F.col("kind") == "spawn", F.col("s2"))
    rows = rules.withColumn("callee", callee)
    rows = rows.join(flag(isolable, "s", "can"), "s", "left").join(flag(same, "s", "on_self"), "s", "left")
    rows = rows.join(flag(isolable, "callee", "can_callee"), "callee", "left").join(flag(own_lock, "callee", "locks_self"), "callee", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    both, none = F.array(F.lit("I"), F.lit("S")), F.lit(None).cast("string")
    rows = rows.withColumn("iso", F.explode(F.when(yes("can"), both).otherwise(F.array(F.lit("N")))))
    stays = yes("can") & yes("on_self")
    inner = F.when(F.col("callee").isNull(), F.array(none)).when(~yes("can_callee"), F.array(F.lit("N"))).when(stays, F.array(F.col("iso"))).otherwise(both)
    rows = rows.where(~(stays & F.col("callee").isNotNull() & ~yes("can_callee") & (F.col("iso") == "I"))).withColumn("inner", F.explode(inner))
    push, spawn = F.col("kind") == "push", F.col("kind") == "spawn"
    iso1 = F.when(push, F.col("inner")).when(F.col("s1").isNotNull(), F.col("iso"))
    iso2 = F.when(spawn, F.col("inner")).when(F.col("s2").isNotNull(), F.col("iso"))
    taken = F.when(push & (F.col("inner") == "I") & yes("locks_self"), F.lit(lock).cast("bigint")).otherwise(F.col("lock"))
    return rows.select(*(taken.alias("lock") if c == "lock" else F.col(c) for c in rules.columns), "iso", iso1.alias("iso1"), iso2.alias("iso2")).distinct()


def write_annotation(kind, iso, on_self, certain):
    """A write overwrites for sure in copy I on the object itself, or in any copy but I on an
    object that is certain (a column of the one object it can be)."""
    hit = F.when(iso == "I", on_self).otherwise(~on_self & certain)
    return F.when((kind == "put") & hit, "write").otherwise("none")
