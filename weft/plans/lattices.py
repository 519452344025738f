"""Queries on lattices over the star schema."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.functions import lattices
from weft.plans.registry import query

_MAPS = """c AS (SELECT o_custkey AS k, o_orderstatus AS key, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY ALL)"""


@query(
    f"""WITH {_MAPS} SELECT k AS o_custkey, sum(greatest(a, b))::BIGINT AS joined, sum(least(a, b))::BIGINT AS met,
        CASE WHEN bool_and(a = b) THEN 0 WHEN bool_and(a <= b) THEN -1 WHEN bool_and(a >= b) THEN 1 END AS compared FROM c GROUP BY k"""
)
def map_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer two maps of orders by status, of even and odd orders: join, meet, comparison."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(
        F.count_if(F.col("o_orderkey") % 2 == 0).alias("a"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("b")
    )

    def held(x: str):
        entries = F.collect_list(F.when(F.col(x) > 0, F.struct("o_orderstatus", x)))
        return F.map_from_entries(entries).alias(x)

    maps = orders.groupBy("o_custkey").agg(held("a"), held("b"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, v: s + v)
    a, b, zero = F.col("a"), F.col("b"), F.lit(0).cast("bigint")
    return maps.select("o_custkey", total(lattices.map_join(a, b, zero)).alias("joined"), total(lattices.map_meet(a, b, zero)).alias("met"), lattices.map_compare(a, b, zero).alias("compared"))


@query(
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 8 AS g, l_partkey % 8 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i FROM lineitem),
    held AS (SELECT DISTINCT o, g FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.o = a.o AND b.i > a.i AND b.k = a.g AND b.g <> a.g))
    SELECT x.o AS l_orderkey, coalesce(sum(1::BIGINT << h.g::INTEGER), 0)::BIGINT AS gen FROM (SELECT DISTINCT o FROM l) x LEFT JOIN held h USING (o) GROUP BY x.o"""
)
def genkill_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as functions, one after the other: each kills one fact, then makes one."""
    one = F.lit(1).cast("bigint")
    bit = lambda c: F.call_function("shiftleft", one, (F.col(c) % 8).cast("int"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", lattices.function(bit("l_suppkey"), F.bitwise_not(bit("l_partkey"))).alias("f"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "f")))
    whole = lines.groupBy("l_orderkey").agg(lattices.all_in_order(F.transform(rows, lambda r: r["f"])).alias("f"))
    return whole.select("l_orderkey", F.col("f.gen").alias("gen"))
