"""Queries on trees of results and on running networks, over the star schema."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.operators import explore, results
from weft.plans.registry import query
from weft.sources import rules as source
from weft.sources.rules import DERIVED_SQL

#: A tree for each customer: any of its order priorities, each of which is all of its orders.
_TREE_SQL = """
    b AS (SELECT o_custkey, o_orderpriority AS p, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'O' THEN 'Negative' ELSE 'Undecided' END AS status FROM orders),
    m AS (SELECT o_custkey, p, CASE WHEN bool_or(status = 'Negative') THEN 'Negative' WHEN bool_or(status = 'Undecided') THEN 'Undecided' ELSE 'Positive' END AS status,
          count(*) AS total, count(*) FILTER (status = 'Positive') AS positive, count(*) FILTER (status = 'Negative') AS negative FROM b GROUP BY ALL),
    r AS (SELECT o_custkey, CASE WHEN bool_or(status = 'Positive') THEN 'Positive' WHEN bool_or(status = 'Undecided') THEN 'Undecided' ELSE 'Negative' END AS status,
          sum(total)::BIGINT AS total, sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative FROM m GROUP BY ALL)"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code, tree, none = F.col("o_orderstatus"), F.col("o_custkey").cast("string").alias("tree"), F.lit(None).cast("string")
    value = F.when(code == "F", "Positive").when(code == "O", "Negative").otherwise("Undecided")
    row = lambda kind, status, *path: orders.select(tree, F.array(*path).cast("array<string>").alias("path"), F.lit(kind).alias("kind"), status.alias("status"), none.alias("detail"))
    priority = F.col("o_orderpriority")
    inner = row("all", none, priority).unionByName(row("any", none)).distinct()
    return inner.unionByName(row("base", value, priority, F.col("o_orderkey").cast("string")))


@query(
    f"""WITH {_TREE_SQL} SELECT o_custkey::VARCHAR AS tree, '' AS place, status, total, positive, negative FROM r
    UNION ALL SELECT o_custkey::VARCHAR, p, status, total, positive, negative FROM m
    UNION ALL SELECT o_custkey::VARCHAR, p || '/' || o_orderkey, status, 1, (status = 'Positive')::INT, (status = 'Negative')::INT FROM b"""
)
def result_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and counts of all rows of the trees."""
    return results.statuses(_trees(spark, sf_dir)).select("tree", F.array_join("path", "/").alias("place"), "status", "total", "positive", "negative")


@query(
    f"""WITH {_TREE_SQL}, lines AS (SELECT o_custkey, '' AS p, '' AS o, ': ' || status AS line FROM r UNION ALL SELECT o_custkey, p, '', '  ' || p || ': ' || status FROM m
        UNION ALL SELECT o_custkey, p, o_orderkey::VARCHAR, '    ' || o_orderkey || ': ' || status FROM b)
    SELECT o_custkey::VARCHAR AS tree, string_agg(line, chr(10) ORDER BY p, o) AS text FROM lines GROUP BY o_custkey"""
)
def result_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.printed(results.statuses(_trees(spark, sf_dir)))


_RUNNING_SQL = """c AS (SELECT s_suppkey::BIGINT AS pid, (s_suppkey % (SELECT count(*) FROM part))::BIGINT AS s FROM supplier),
    h AS (SELECT s_suppkey::BIGINT AS pid, (s_suppkey % 3)::BIGINT AS lock FROM supplier WHERE s_suppkey % 5 = 0)"""


def _running(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, and a process for each supplier: every fifth holds a lock under its top symbol."""
    rules = source.derived(spark, sf_dir)
    symbols = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"))
    key = F.col("s_suppkey").cast("bigint")
    lock = F.when(key % 5 == 0, key % 3)
    frame = F.array(F.struct((key % F.col("n")).cast("string").alias("s"), lock.alias("lock")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(symbols))  # one row
    config = rows.select(key.cast("string").alias("pid"), F.lit("0").alias("g"), frame.alias("stack"), F.lit(0).alias("started"))
    text = rules.select("kind", F.lit("0").alias("g"), F.col("s").cast("string").alias("s"), F.lit("0").alias("g1"), *(F.col(x).cast("string").alias(x) for x in ("s1", "s2")), F.lit("0").alias("g2"), "lock")
    return text, config, explore.enabled(text, explore.tops(config), explore.locks_held(config))


_ENABLED_SQL = """e AS (SELECT c.pid, r.kind, r.s1, r.s2, r.lock FROM c JOIN rules r USING (s)
        WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lock = r.lock AND h.pid <> c.pid))"""


@query(f"WITH {DERIVED_SQL}, {_RUNNING_SQL}, {_ENABLED_SQL} SELECT pid::VARCHAR AS pid, kind, coalesce(s1, -1)::VARCHAR AS s1 FROM e")
def enabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each process can take."""
    return _running(spark, sf_dir)[2].select("pid", "kind", F.coalesce("s1", F.lit("-1")).alias("s1"))


@query(
    f"""WITH {DERIVED_SQL}, {_RUNNING_SQL}, {_ENABLED_SQL},
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY kind, coalesce(s1::VARCHAR, '')) AS i FROM e) WHERE i = 1),
    f AS (SELECT c.pid, c.s, coalesce('@' || h.lock, '') AS own, t.kind, t.s1, t.s2, coalesce('@' || t.lock, '') AS took FROM c LEFT JOIN h USING (pid) LEFT JOIN t USING (pid))
    SELECT pid::VARCHAR AS pid, CASE kind WHEN 'pop' THEN '' WHEN 'push' THEN s1 || took || ' ' || s2 || own WHEN 'base' THEN s1 || own WHEN 'spawn' THEN s1 || own ELSE s || own END AS stack FROM f
    UNION ALL SELECT pid || '.0', s2::VARCHAR FROM f WHERE kind = 'spawn'"""
)
def network_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration after each process has taken its first rule, if it can take one."""
    _, config, ready = _running(spark, sf_dir)
    columns = ("kind", "g1", "s1", "s2", "g2", "lock")
    order = F.struct("kind", F.coalesce("s1", F.lit("")))
    chosen = ready.groupBy("pid").agg(F.min_by(F.struct(*columns), order).alias("r")).select("pid", "r.*")
    stack = F.transform("stack", lambda f: F.concat(f["s"], F.coalesce(F.concat(F.lit("@"), f["lock"].cast("string")), F.lit(""))))
    return explore.step(config, chosen).select("pid", F.array_join(stack, " ").alias("stack"))
