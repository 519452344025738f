"""Trees of results (V5, K10, K12): statuses, updates, look-ups and the printed form.

A tree is a table: tree, path (the keys from the root, an array of strings), kind (base, all or
any), status and detail.  Only base rows have a status of their own; ``all`` and ``any`` rows get
theirs from the rows below, by the rank that decides (``operators.status``).  A row without rows
below is Positive under ``all`` and Negative under ``any``.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from weft.operators.status import CONJUNCTIVE, DISJUNCTIVE

SCHEMA = "tree string, path array<string>, kind string, status string, detail string"


def _rank(order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col("status")).cast("int")


def _named(order: tuple[str, ...], rank: str) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), F.col(rank))


def statuses(nodes: DataFrame) -> DataFrame:
    """The tree with all statuses, and for each row total, positive and negative base rows below it.

    One level after the other from the deepest up: as many aggregations as a tree has levels."""
    deepest = nodes.agg(F.max(F.size("path"))).first()[0]  # one number
    count = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    whole = below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = nodes.where(F.size("path") == depth)
        base = F.col("kind") == "base"
        if below is None:
            own = own.withColumns({x: F.lit(None).cast("bigint") for x in ("_total", "_positive", "_negative")}).withColumns({x: F.lit(None).cast("int") for x in ("_all", "_any")})
        else:
            above = below.groupBy("tree", F.slice("path", 1, depth).alias("path")).agg(
                F.min(_rank(CONJUNCTIVE)).alias("_all"), F.min(_rank(DISJUNCTIVE)).alias("_any"),
                *(F.sum(x).alias(f"_{x}") for x in ("total", "positive", "negative")),
            )
            own = own.join(above, ["tree", "path"], "left")
        found = F.when(base, F.col("status"))
        found = found.when(F.col("kind") == "all", F.coalesce(_named(CONJUNCTIVE, "_all"), F.lit("Positive")))
        found = found.otherwise(F.coalesce(_named(DISJUNCTIVE, "_any"), F.lit("Negative")))
        one = lambda status: F.when(base, (F.col("status") == status).cast("bigint"))
        below = own.select(
            "tree", "path", "kind", found.alias("status"), "detail",
            F.when(base, 1).otherwise(count(F.col("_total"))).cast("bigint").alias("total"),
            one("Positive").otherwise(count(F.col("_positive"))).alias("positive"),
            one("Negative").otherwise(count(F.col("_negative"))).alias("negative"),
        )
        whole = below if whole is None else whole.unionByName(below)
    if whole is None:
        zero = F.lit(0).cast("bigint")
        whole = nodes.select("*", zero.alias("total"), zero.alias("positive"), zero.alias("negative"))
    return whole


def update(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree with new statuses (tree, path, value).  Running it fails if a change names no row, a
    row that is not a base row, or one that is decided already."""
    asked = changes.select("tree", "path", F.col("value").alias("_value"))
    both = nodes.join(asked, ["tree", "path"], "full_outer")
    where = F.concat(F.col("tree"), F.lit("/"), F.array_join("path", "/"))
    wrong = F.when(F.col("kind").isNull(), F.concat(F.lit("no such result: "), where))
    wrong = wrong.when(F.col("kind") != "base", F.concat(F.lit("not a base result: "), where))
    wrong = wrong.when(F.coalesce("status", F.lit("")) != "Undecided", F.concat(F.lit("decided already: "), where))
    value = F.when(F.col("_value").isNull(), F.col("status")).when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("_value"))
    return both.select("tree", "path", "kind", value.alias("status"), "detail")


def update_detail(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree with new details (tree, path, detail) of rows of any kind."""
    asked = changes.select("tree", "path", F.col("detail").alias("_detail"), F.lit(True).alias("_asked"))
    detail = F.when(F.col("_asked"), F.col("_detail")).otherwise(F.col("detail"))
    return nodes.join(asked, ["tree", "path"], "left").select("tree", "path", "kind", "status", detail.alias("detail"))


def look_up(nodes: DataFrame, *path: str) -> DataFrame:
    """The part of each tree from a path on, as trees of their own."""
    n = len(path)
    if not n:
        return nodes
    inside = F.slice("path", 1, n) == F.array(*map(F.lit, path))
    return nodes.where(inside).withColumn("path", F.slice(F.col("path"), F.lit(n + 1), F.greatest(F.size("path") - n, F.lit(0))))


def printed(rows: DataFrame) -> DataFrame:
    """tree, text: a line for each row of ``statuses``, two blanks more for each level; the root has no key."""
    key = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(""))
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), key, F.lit(": "), F.col("status"))
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return rows.groupBy("tree").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))
