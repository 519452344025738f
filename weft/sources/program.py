"""Fact tables of a program (S6), and the ones derived from the star schema with their SQL.

    nodes          node, class, loader, is_static, is_sync, is_thread_start, has_body
    blocks         node, bb, is_catch, is_exit
    succ           node, bb, bb2, exceptional, ord
    instr          node, bb, idx, kind (phi catch invoke menter mexit get put new other), ref, field, throws
    call_targets   node, bb, idx, target        points_to  node, var, obj
    class_obj      class, obj                   waits      node, obj

A call graph and a points-to relation from any front end can be given in this form; ``Program``
bundles the tables.  Nodes, objects and variables are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

SCHEMAS = {
    "nodes": "node bigint, class bigint, loader string, is_static boolean, is_sync boolean, is_thread_start boolean, has_body boolean",
    "blocks": "node bigint, bb int, is_catch boolean, is_exit boolean",
    "succ": "node bigint, bb int, bb2 int, exceptional boolean, ord int",
    "instr": "node bigint, bb int, idx int, kind string, ref bigint, field bigint, throws boolean",
    "call_targets": "node bigint, bb int, idx int, target bigint",
    "points_to": "node bigint, var bigint, obj bigint",
    "class_obj": "class bigint, obj bigint",
    "waits": "node bigint, obj bigint",
}


#: Lines of the derived program that one task sorts.
LINES = 500_000


@dataclass
class Program:
    nodes: DataFrame
    blocks: DataFrame
    succ: DataFrame
    instr: DataFrame
    call_targets: DataFrame
    points_to: DataFrame
    class_obj: DataFrame
    waits: DataFrame

    def only(self, nodes: DataFrame) -> Program:
        """The part of the program in some nodes (column node): a slice (B11).  Calls of others stay
        known as instructions and targets."""
        kept = {f.name: getattr(self, f.name) for f in fields(self)}
        for name in ("blocks", "succ", "instr", "waits"):
            kept[name] = kept[name].join(nodes.select("node").distinct(), "node", "left_semi")
        return Program(**kept)


def from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Program:
    """A program given by rows; a table that is left out is empty."""
    return Program(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def derived(spark: SparkSession, sf_dir: str) -> Program:
    """A program over ``part`` (its nodes) and ``lineitem`` (their instructions)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("node"), F.col("p_size").cast("bigint").alias("z"))
    number = F.col("node") % 7
    nodes = part.select(
        "node", number.alias("class"), F.when(F.col("z") % 3 == 0, "Primordial").otherwise("Application").alias("loader"), (F.col("z") % 2 == 0).alias("is_static"),
        (F.col("z") % 5 == 0).alias("is_sync"), (F.col("z") % 11 == 0).alias("is_thread_start"), (F.col("z") % 13 != 0).alias("has_body"),
    )
    block = lambda bb, catch: F.struct(F.lit(bb).alias("bb"), catch.alias("is_catch"), F.lit(bb == 2).alias("is_exit"))
    no = F.lit(False)
    blocks = part.select("node", F.inline(F.array(block(0, no), block(1, F.col("z") % 4 == 0), block(2, no))))
    edge = lambda a, b, x, n: F.struct(F.lit(a).alias("bb"), F.lit(b).alias("bb2"), F.lit(x).alias("exceptional"), F.lit(n).alias("ord"))
    plain = [edge(0, 1, False, 0), edge(1, 2, False, 0), edge(0, 2, True, 1), edge(1, 2, True, 1)]
    succ = part.select("node", F.inline(F.when(F.col("z") % 4 == 0, F.array(*plain, edge(0, 1, True, 2))).otherwise(F.array(*plain))))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").cast("bigint").alias("node"), (F.col("l_linenumber") % 2).cast("int").alias("bb"), F.col("l_orderkey").cast("bigint").alias("o"), "l_linenumber", F.col("l_suppkey").cast("bigint").alias("u")
    )
    # as many tasks as the lines need, so that a task's memory does not follow the table; the count reads file footers only
    tasks = -(-line.count() // LINES)
    spread = lambda rows, *keys: rows.repartition(tasks, *keys) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows
    line = spread(line, "node", "bb")
    order = Window.partitionBy("node", "bb").orderBy("o", "l_linenumber", "u")
    kinds = F.array(*map(F.lit, ("invoke", "get", "put", "new", "menter", "mexit", "phi", "other")))
    line = line.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    instr = line.select("node", "bb", "idx", F.element_at(kinds, (F.col("u") % 8 + 1).cast("int")).alias("kind"), (F.col("u") % 5).alias("ref"), (F.col("o") % 4).alias("field"), (F.col("o") % 3 == 0).alias("throws"))
    n = part.agg(F.count("*").alias("n"))
    first, second = (F.col("o") * 2 + 1) % F.col("n"), (F.col("o") * 3 + 2) % F.col("n")
    targets = F.when(F.col("o") % 5 == 0, F.array().cast("array<bigint>")).when(F.col("o") % 4 == 0, F.array(first, second)).otherwise(F.array(first))
    calls = line.where("u % 8 = 0").join(F.broadcast(n)).select("node", "bb", "idx", F.explode(targets).alias("target")).distinct()  # one row is broadcast
    var = part.select("node", "z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("var")).where("not (var = 4 and z % 2 = 0)")
    one, two = (F.col("node") + F.col("var")) % 6, (F.col("node") * F.col("var")) % 6
    points = var.select("node", "var", F.explode(F.when(F.col("z") % 3 == 1, F.array_distinct(F.array(one, two))).otherwise(F.array(one))).alias("obj"))
    points = spread(points, "node", "var")
    classes = spark.range(7).select(F.col("id").alias("class"), (F.col("id") + 100).alias("obj"))
    waits = part.where("z % 17 = 0").select("node", (F.col("node") % 6).alias("obj"))
    # tables that grow are joined by sorting: a broadcast would pass them through the driver
    nodes, blocks, succ, instr, calls, points, waits = (rows.hint("merge") for rows in (nodes, blocks, succ, instr, calls, points, waits))
    return Program(nodes, blocks, succ, instr, calls, points, F.broadcast(classes), waits)  # seven classes


def with_loops(p: Program, spark: SparkSession, sf_dir: str) -> Program:
    """The derived program with a way back in the methods of some parts' sizes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("node"), (F.col("p_size") % 7).alias("z"))
    back = F.expr("case z when 1 then named_struct('bb', 2, 'bb2', 0) when 3 then named_struct('bb', 1, 'bb2', 0) when 5 then named_struct('bb', 2, 'bb2', 1) when 6 then named_struct('bb', 1, 'bb2', 1) end")
    ways = part.withColumn("w", back).where("w is not null").select("node", "w.bb", "w.bb2", F.lit(False).alias("exceptional"), F.lit(3).alias("ord"))
    return replace(p, succ=p.succ.unionByName(ways))


#: Blocks that follow each other in the program with ways back, after ``SQL``.
LOOPS_SQL = """flow AS (SELECT DISTINCT node, bb, bb2 FROM succ UNION SELECT node, v.bb, v.bb2 FROM pa JOIN (VALUES (1, 2, 0), (3, 1, 0), (5, 2, 1), (6, 1, 1)) v(m, bb, bb2) ON z % 7 = m),
    behind(node, a, b) AS (SELECT * FROM flow UNION SELECT c.node, c.a, f.bb2 FROM behind c JOIN flow f ON f.node = c.node AND f.bb = c.b),
    cyclic AS (SELECT node, a AS bb FROM behind WHERE a = b)"""

#: The same tables for DuckDB, as common table expressions.
SQL = """
    pa AS (SELECT p_partkey::BIGINT AS node, p_size::BIGINT AS z, (SELECT count(*) FROM part) AS n FROM part),
    nodes AS (SELECT node, node % 7 AS class, CASE WHEN z % 3 = 0 THEN 'Primordial' ELSE 'Application' END AS loader, z % 2 = 0 AS is_static, z % 5 = 0 AS is_sync, z % 11 = 0 AS is_thread_start, z % 13 <> 0 AS has_body FROM pa),
    blocks AS (SELECT node, bb, bb = 1 AND z % 4 = 0 AS is_catch, bb = 2 AS is_exit FROM pa, (VALUES (0), (1), (2)) b(bb)),
    succ AS (SELECT node, bb, bb2, exceptional, ord FROM pa, (VALUES (0, 1, false, 0), (1, 2, false, 0), (0, 2, true, 1), (1, 2, true, 1), (0, 1, true, 2)) s(bb, bb2, exceptional, ord) WHERE ord < 2 OR z % 4 = 0),
    li AS (SELECT l_partkey::BIGINT AS node, l_linenumber % 2 AS bb, l_orderkey::BIGINT AS o, l_suppkey::BIGINT AS u, row_number() OVER (PARTITION BY l_partkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS idx FROM lineitem),
    instr AS (SELECT node, bb, idx, list_extract(['invoke', 'get', 'put', 'new', 'menter', 'mexit', 'phi', 'other'], (u % 8)::INTEGER + 1) AS kind, u % 5 AS ref, o % 4 AS field, o % 3 = 0 AS throws FROM li),
    call_targets AS (SELECT DISTINCT node, bb, idx, target FROM (
        SELECT li.*, (o * 2 + 1) % (SELECT count(*) FROM part) AS target FROM li WHERE u % 8 = 0 AND o % 5 <> 0
        UNION ALL SELECT li.*, (o * 3 + 2) % (SELECT count(*) FROM part) FROM li WHERE u % 8 = 0 AND o % 5 <> 0 AND o % 4 = 0)),
    points_to AS (SELECT DISTINCT node, var, obj FROM (
        SELECT node, var, z, (node + var) % 6 AS obj FROM pa, (VALUES (0::BIGINT), (1), (2), (3), (4)) v(var)
        UNION ALL SELECT node, var, z, (node * var) % 6 FROM pa, (VALUES (0::BIGINT), (1), (2), (3), (4)) v(var) WHERE z % 3 = 1) WHERE NOT (var = 4 AND z % 2 = 0)),
    class_obj AS (SELECT range AS class, range + 100 AS obj FROM range(7)),
    waits AS (SELECT node, node % 6 AS obj FROM pa WHERE z % 17 = 0)"""
