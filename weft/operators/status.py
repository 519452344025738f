"""Roll-ups of result statuses (A8, A9, A10) by the rank that decides."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

#: Statuses in the order in which they decide.
CONJUNCTIVE = ("Unprocessed", "Negative", "Error", "Undecided", "Positive")
DISJUNCTIVE = ("Unprocessed", "Positive", "Error", "Undecided", "Negative")


def roll_up(rows: DataFrame, group: str, status: str, order: tuple[str, ...]) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(status)).cast("int")
    names = F.array(*map(F.lit, order))
    counted = rows.groupBy(group).agg(F.min(rank).alias("rank"), F.count("*").alias("total"), F.count_if(F.col(status) == "Positive").alias("positive"), F.count_if(F.col(status) == "Negative").alias("negative"))
    return counted.select(group, F.element_at(names, F.col("rank")).alias("status"), "total", "positive", "negative")
