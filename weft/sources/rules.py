"""Rule tables: a pushdown network as one DataFrame, and the one derived from the star schema.

Columns: kind (base, push, pop, spawn), s (stack symbol), s1 (successor; callee of a push;
continuation of a spawn), s2 (return symbol of a push; spawned symbol), lock (of a push, or null).
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.sources.scratch import Tables

INITIAL = 0


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network over ``part``: one control state, initial symbol 0."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("s"), F.col("p_size").cast("bigint").alias("z"))
    n = part.agg(F.count("*").alias("n"))
    rows = part.join(F.broadcast(n))  # one row
    k = F.col("z") % 10
    a, b, d = ((F.col("s") * m + c) % F.col("n") for m, c in ((2, 2), (3, 1), (2, 1)))
    none = F.lit(None).cast("bigint")

    def rule(kind: str, s1, s2=none, lock=none):
        return F.struct(F.lit(kind).alias("kind"), F.col("s"), s1.alias("s1"), s2.alias("s2"), lock.alias("lock"))

    rules = (
        F.when(k <= 3, F.array(rule("base", a), rule("base", d)))
        .when(k == 4, F.array(rule("base", a)))
        .when(k <= 6, F.array(rule("push", a, b)))
        .when(k == 7, F.array(rule("push", a, b, (F.col("z") / 10).cast("bigint"))))
        .when((k == 8) & (F.col("s") % 10 == 0), F.array(rule("pop", none)))
        .when(k == 9, F.array(rule("spawn", b, a)))
    )
    # written once: every round of a fixpoint reads it
    tables = Tables(spark)
    found = rows.select(F.inline(rules))
    return tables.read(found.schema, tables.write(found))


#: The same table for DuckDB, as a common table expression named ``rules``.
DERIVED_SQL = """
    p AS (SELECT p_partkey::BIGINT AS s, p_size::BIGINT AS z, (SELECT count(*) FROM part) AS n FROM part),
    q AS (SELECT s, z, z % 10 AS k, (2*s+2) % n AS a, (3*s+1) % n AS b, (2*s+1) % n AS d FROM p),
    rules AS (
        SELECT 'base' AS kind, s, a AS s1, NULL::BIGINT AS s2, NULL::BIGINT AS lock FROM q WHERE k <= 4
        UNION ALL SELECT 'base', s, d, NULL, NULL FROM q WHERE k <= 3
        UNION ALL SELECT 'push', s, a, b, CASE WHEN k = 7 THEN z // 10 END FROM q WHERE k IN (5, 6, 7)
        UNION ALL SELECT 'pop', s, NULL, NULL, NULL FROM q WHERE k = 8 AND s % 10 = 0
        UNION ALL SELECT 'spawn', s, b, a, NULL FROM q WHERE k = 9)"""


def edges(rules: DataFrame) -> DataFrame:
    """x, y: y may run after x or be started by it (whether a callee returns is left open)."""
    return rules.select(F.col("s").alias("x"), F.explode(F.array("s1", "s2")).alias("y")).where("y is not null").distinct()


EDGES_SQL = "edges AS (SELECT DISTINCT s AS x, y FROM (SELECT s, s1 AS y FROM rules UNION ALL SELECT s, s2 FROM rules) WHERE y IS NOT NULL)"
