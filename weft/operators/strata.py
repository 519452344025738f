"""Fixpoints over a graph by levels of its components.

A row holds at a node x and is handed on along edges.  Components come in the order of their
level, so when a level's turn comes, all that can arrive there has arrived: its rows are closed
under the edges inside its components, written, and handed on once along the edges that leave
them.  They never take part in a join again.  What is handed on waits in the folder of the level
that it arrives at, so a level reads its own rows and edges alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.operators import components
from weft.operators.fixpoint import least_fixpoint
from weft.sources.scratch import Tables


def stratified(
    edges: DataFrame, seed: DataFrame, hand_on: Callable[[DataFrame, DataFrame], DataFrame], report: Callable[[int, int], None] | None = None
) -> DataFrame:
    """All rows derivable from ``seed`` (x and further columns, none of them null), as a set.

    ``hand_on(rows, edges)`` gives the rows that arrive at y along edges (x, y), in the columns of
    ``seed``; it must look at each row for itself.  ``report`` is called with each level that has rows and their number.
    """
    spark, columns = seed.sparkSession, seed.columns
    tables = Tables(spark)
    plain = edges.select("x", "y").distinct()
    plain = tables.read(plain.schema, tables.write(plain))
    seed = tables.read(seed.schema, tables.write(seed.distinct()))
    nodes = plain.select(F.explode(F.array("x", "y")).alias("x")).unionByName(seed.select("x")).distinct()
    nodes = tables.read(nodes.schema, tables.write(nodes))
    place = components.placed(nodes, plain).select("x", "component", "level")
    place = tables.read(place.schema, tables.write(place))

    ends = place.select(F.col("x").alias("y"), F.col("component").alias("to"))
    ways = plain.join(place, "x").join(ends, "y").select("x", "y", (F.col("component") == F.col("to")).alias("inner"), "level")
    ordered = ways.repartitionByRange("level", "x")  # few files for a level, and many for a large one
    inside = tables.split(ordered.where("inner").select("x", "y", "level"), "level")
    between = tables.split(ordered.where("not inner").select("x", "y", "level"), "level")
    waiting = tables.split(seed.join(place.select("x", "level"), "x").select(*columns, "level"), "level")

    done: list[str] = []
    # one number: the levels follow the longest way between components, as the loop does
    last = place.agg(F.max("level").alias("n")).first().n
    for level in range(-1 if last is None else last + 1):
        arrived = tables.part(waiting, seed.schema, level=level)
        if arrived is None:
            continue
        rows = arrived.distinct()
        within = tables.part(inside, plain.schema, level=level)
        if within is not None:
            rows = least_fixpoint(rows, lambda new, _, within=within: hand_on(new, within))
        path, count = tables.counted(rows)
        done.append(path)
        if report is not None:
            report(level, count)
        leaving = tables.part(between, plain.schema, level=level)
        if leaving is not None:
            handed = hand_on(tables.read(seed.schema, path), leaving).select(*columns).distinct()
            tables.split(handed.join(place.select("x", "level"), "x").select(*columns, "level"), "level", waiting)
    return tables.read(seed.schema, *done) if done else seed
