"""Steps of a running network (Q15).

``processes``: pid, g, s (the top of the stack); ``held``: pid, lock.  A configuration is the table
pid (string), g, stack (array of struct s, lock, the top first), started (processes begun so far).
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

CONFIGURATION = "pid string, g string, stack array<struct<s:string,lock:bigint>>, started int"


def enabled(rules: DataFrame, processes: DataFrame, held: DataFrame) -> DataFrame:
    """The rules each process can take next.

    A push under a lock needs that no other process holds it; a process may take a lock again
    that it holds.
    """
    ready = processes.select("pid", "g", "s").join(rules, ["g", "s"])
    other = held.select(F.col("pid").alias("owner"), F.col("lock").alias("taken"))
    return ready.join(other, (F.col("lock") == F.col("taken")) & (F.col("pid") != F.col("owner")), "left_anti")


def begin(spark: SparkSession, g: str, s: str) -> DataFrame:
    """One process at a symbol."""
    return spark.createDataFrame([("0", g, [(s, None)], 0)], CONFIGURATION)


def tops(configuration: DataFrame) -> DataFrame:
    """pid, g, s of processes that have not ended."""
    return configuration.where(F.size("stack") > 0).select("pid", "g", F.col("stack")[0]["s"].alias("s"))


def locks_held(configuration: DataFrame) -> DataFrame:
    """pid, lock: the locks on a process's stack."""
    return configuration.select("pid", F.explode("stack").alias("f")).select("pid", F.col("f.lock").alias("lock")).where("lock is not null").distinct()


def step(configuration: DataFrame, chosen: DataFrame) -> DataFrame:
    """The configuration after one rule of each process that has one in ``chosen`` (pid, kind, g1, s1,
    g2, s2, lock).  A process that a spawn starts is named by its parent's name and a number."""
    rule = chosen.select("pid", "kind", "g1", "s1", "g2", "s2", F.col("lock").alias("_lock"))
    both = configuration.join(rule, "pid", "left")
    frame = lambda s, lock: F.array(F.struct(F.col(s).cast("string").alias("s"), lock.cast("bigint").alias("lock")))
    top, rest = F.col("stack")[0]["lock"], F.slice("stack", 2, 1 << 30)
    kind = F.col("kind")
    stack = F.when(kind.isNull(), F.col("stack")).when(kind == "pop", rest)
    stack = stack.when(kind == "push", F.concat(frame("s1", F.col("_lock")), frame("s2", top), rest)).otherwise(F.concat(frame("s1", top), rest))
    spawn = kind == "spawn"
    own = F.struct("pid", F.coalesce(F.col("g1").cast("string"), "g").alias("g"), stack.alias("stack"), (F.col("started") + F.coalesce(spawn.cast("int"), F.lit(0))).alias("started"))
    new = F.struct(F.concat("pid", F.lit("."), "started").alias("pid"), F.col("g2").cast("string").alias("g"), frame("s2", F.lit(None)).alias("stack"), F.lit(0).alias("started"))
    return both.select(F.inline(F.when(spawn, F.array(own, new)).otherwise(F.array(own))))
