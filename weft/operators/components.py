"""Strongly connected components of edge tables (R13, R18, R19, R24's order, A12).

Nodes without an edge in or without one out are components of their own and are trimmed.  A node
with one edge out is contracted into the node behind it: ways through it go on there at once, and
it is of that node's component if a node before it is.  The same holds for one edge in, the other
way round.  Of neighbours that could both go, the one with the lesser hash goes, so about a
third of a long chain goes in each round, and rounds follow the logarithm of its length.

In what is left every node takes the least node that reaches it as its colour; the
nodes of a colour that reach its least node are that node's component.  They are taken away, and
so on.  At last the contracted nodes come back, the latest first.  All tables are as long as the
edges; no closure is made.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.operators.fixpoint import Order, least_fixpoint
from weft.sources.scratch import Tables


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges in and out."""
    inside = edges.select(F.col("x").alias("k")).intersect(edges.select(F.col("y").alias("k")))
    return edges.join(inside.withColumnRenamed("k", "x"), "x", "left_semi").join(inside.withColumnRenamed("k", "y"), "y", "left_semi").select("x", "y")


def _single(edges: DataFrame, number: int) -> DataFrame:
    """x, to: nodes with one edge out, to another node; of two such neighbours the one with the lesser hash."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)), F.col(c))
    one = edges.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("to")).where("n = 1 and x <> to").select("x", "to")
    ahead = one.select(F.col("x").alias("to"), rank("x").alias("rank_to"))
    behind = one.groupBy(F.col("to").alias("x")).agg(F.min(rank("x")).alias("rank_from"))
    mine = one.withColumn("rank", rank("x")).join(ahead, "to", "left").join(behind, "x", "left")
    least = lambda c: F.col(c).isNull() | (F.col("rank") < F.col(c))
    return mine.where(least("rank_to") & least("rank_from")).select("x", "to")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("y").alias("x"), F.col("x").alias("y"))


def _contract(edges: DataFrame, tables: Tables, report: Callable[[int, int], None] | None) -> tuple[DataFrame, int, list[tuple[DataFrame, DataFrame]]]:
    """The edges that trimming and contracting leave, their number, and for each round that contracted, the latest last:
    (x, to) and the nodes before each x (x, near)."""
    gone: list[tuple[DataFrame, DataFrame]] = []
    path, count = tables.counted(edges)
    edges, number, idle = tables.read(edges.schema, path), 0, 0
    while count and idle < 2:
        forwards = number % 2 == 0
        rows = _trimmed(edges)
        path, kept = tables.counted(rows if forwards else _turned(rows))
        rows = tables.read(edges.schema, path)
        single = _single(rows, number)
        path, n = tables.counted(single)
        if n:
            single = tables.read(single.schema, path)
            into = single.withColumnsRenamed({"x": "y"})
            near = rows.join(into, "y").select(F.col("y").alias("x"), F.col("x").alias("near"))
            path, _ = tables.counted(near)
            gone.append((single, tables.read(near.schema, path)))
            moved = rows.join(single.select("x"), "x", "left_anti").join(into, "y", "left").select("x", F.coalesce("to", "y").alias("y"))
            rows = moved.where("x <> y").distinct()
        path, after = tables.counted(rows if forwards else _turned(rows))
        edges = tables.read(edges.schema, path)
        # both directions in turn: what neither of them shortens by a tenth is left to the colours
        idle = idle + 1 if after * 10 > count * 9 else 0
        count, number = after, number + 1
        if report is not None:
            report(number, count)
    return edges, count, gone


def _returned(known: DataFrame, gone: list[tuple[DataFrame, DataFrame]], tables: Tables) -> DataFrame:
    """(x, c) of all nodes in components of two or more, contracted ones included."""
    schema = known.schema
    for single, near in reversed(gone):
        # a node's component is that of the node behind it if a node before it is of that one too
        behind = single.join(known.withColumnRenamed("x", "to"), "to", "left").select("x", "to", F.coalesce("c", "to").alias("c"))
        before = near.join(known.withColumnRenamed("x", "near"), "near", "left").select("x", F.coalesce("c", "near").alias("c"))
        joined = behind.join(before.distinct(), ["x", "c"], "left_semi").select("x", "to", "c")
        both = joined.select("x", "c").unionByName(joined.select(F.col("to").alias("x"), "c")).unionByName(known).distinct()
        known = tables.read(schema, tables.write(both))
    return known


def _colours(edges: DataFrame, tables: Tables) -> DataFrame:
    """x, c: the least node that reaches x, itself included."""
    labels = edges.select(F.explode(F.array("x", "y")).alias("x")).distinct().withColumn("c", F.col("x"))
    path, _ = tables.counted(labels)
    labels = tables.read(labels.schema, path)
    while True:
        near = edges.join(labels, "x").groupBy("y").agg(F.min("c").alias("near")).withColumnRenamed("y", "x")
        step = labels.join(near, "x", "left").select("x", F.least("c", F.coalesce("near", "c")).alias("c"), (F.col("near") < F.col("c")).alias("moved"))
        path, _ = tables.counted(step)
        found = tables.read(step.schema, path)
        labels = found.select("x", "c")
        if found.where("moved").isEmpty():
            return labels


def components(nodes: DataFrame, edges: DataFrame, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """x, component (its least node), for all ``nodes`` (column x); ``edges``: x, y.  ``report`` is called with
    each round of contraction and the edges that it leaves."""
    tables = Tables(edges.sparkSession)
    plain = edges.select("x", "y").where("x <> y").distinct()
    left, n, gone = _contract(plain, tables, report)
    schema, labels = left.schema, left.select("x", F.col("x").alias("c")).schema
    found: list[str] = []
    while n:
        colours = _colours(left, tables)
        ends = colours.withColumnsRenamed({"x": "y", "c": "d"})
        same = left.join(colours, "x").join(ends, "y").where("c = d").select("x", "y", "c")
        path, _ = tables.counted(same)
        same = tables.read(same.schema, path)
        back = same.select(F.col("y").alias("x"), F.col("x").alias("y"), "c")
        roots = colours.where("x = c")
        members = least_fixpoint(roots, lambda new, _, back=back: new.join(back, ["x", "c"]).select(F.col("y").alias("x"), "c"))
        path, _ = tables.counted(members)
        found.append(path)
        members = tables.read(members.schema, path).select("x")
        left = left.join(members, "x", "left_anti").join(members.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y")
        left, n, later = _contract(left, tables, report)
        gone += later
    whole = nodes.select("x").distinct()
    known = tables.read(labels, *found) if found else edges.sparkSession.createDataFrame([], labels)
    known = _returned(known, gone, tables)
    # a component that had other nodes when it was found is named by its least one now
    names = known.groupBy("c").agg(F.min("x").alias("component"))
    return whole.join(known.join(names, "c").select("x", "component"), "x", "left").select("x", F.coalesce("component", "x").alias("component"))


def in_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """x: the nodes that reach themselves."""
    found = components(nodes, edges)
    large = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    loops = edges.where("x = y").select("x").distinct()
    return found.join(large, "component", "left_semi").select("x").unionByName(loops).distinct()


def placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """x, component, level: the level of a component is the longest way of components before it, so the
    order by level is a topological one.  Of the ways to a component only the longest so far goes on."""
    tables = Tables(edges.sparkSession)
    found = components(nodes, edges)
    found = tables.read(found.schema, tables.write(found))
    ends = found.withColumnsRenamed({"x": "y", "component": "to"})
    above = edges.join(found, "x").join(ends, "y").where("component <> to").select("component", "to").distinct()
    above = tables.read(above.schema, tables.write(above))
    seed = found.select("component").distinct().withColumn("level", F.lit(0))
    longest = Order(["component"], lambda a, b: a("level") >= b("level"))
    ways = least_fixpoint(seed, lambda new, _: new.join(above, "component").select(F.col("to").alias("component"), (F.col("level") + 1).alias("level")), order=longest)
    return found.join(ways.groupBy("component").agg(F.max("level").alias("level")), "component").select("x", "component", "level")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, level of all components."""
    return placed(nodes, edges).groupBy("component").agg(F.count("*").alias("size"), F.max("level").alias("level"))
