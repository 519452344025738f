"""Numbers from 0 for the rows of a table, without bringing them into one task."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from weft.sources.scratch import Tables


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a column ``name`` that counts them in the order of ``by``: places within a range of values, and
    how many rows lie in earlier ranges.  Only the ranges' sizes are summed up in one task."""
    tables = Tables(rows.sparkSession)
    ranged = rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id())
    ranged = tables.read(ranged.schema, tables.write(ranged))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # as many as ranges
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_range", "_own", "_before")


#: Facts whose bits share one word.
WORD = 63


def paged(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places for facts (key, fact) as bits of words: key, fact, page, part, bit; and for keys: key, page, mask of all its bits.
    Keys of up to 32 facts have as many bits as the next power of two, and share the word of a page with keys of that size;
    others have a page of their own, in parts of ``WORD`` facts, whose mask is the whole word.  The last three bits of a page tell its size."""
    tables = Tables(pairs.sparkSession)
    placed = numbered(pairs.select("key", "fact").distinct().withColumn("pair", F.struct("key", "fact")), "pair", "place").drop("pair")
    placed = tables.read(placed.schema, tables.write(placed))
    keys = numbered(placed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")), "key", "number")
    size = F.expr("cast(case when n <= 32 then ceil(log2(n)) else 7 end as int)")
    keys = keys.withColumn("size", size).withColumn("slot", F.expr("case when size < 7 then shiftleft(1, size) else 1 end"))
    keys = keys.withColumn("fit", F.expr(f"case when size < 7 then {WORD} div slot else 1 end"))
    keys = keys.select("key", "first", "size", F.expr("(number div fit) * 8 + size").alias("page"), F.expr("cast((number % fit) * slot as int)").alias("shift"), "slot")
    keys = tables.read(keys.schema, tables.write(keys))
    own = F.col("place") - F.col("first")
    small = F.col("size") < 7
    facts = placed.join(keys, "key").select(
        "key", "fact", "page", F.when(small, F.lit(0)).otherwise(F.floor(own / WORD)).cast("bigint").alias("part"),
        F.when(small, F.col("shift") + own).otherwise(own % WORD).cast("int").alias("bit"),
    )
    facts = tables.read(facts.schema, tables.write(facts))
    mask = F.when(small, F.expr("shiftleft(shiftleft(1L, slot) - 1L, shift)")).otherwise(F.lit(-1)).cast("bigint")
    return facts, keys.select("key", "page", mask.alias("mask"))


def whole_keys(page, bits):
    """Of ``bits`` of a page, all bits of the keys that have one."""
    found = F.lit(None).cast("bigint")
    for size in range(6):
        slot = 1 << size
        lows = sum(1 << i * slot for i in range(WORD // slot))
        any_ = F.lit(0).cast("bigint")
        for i in range(slot):
            any_ = any_.bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(i)))
        found = F.when(page % 8 == size, any_.bitwiseAND(F.lit(lows).cast("bigint")) * F.lit((1 << slot) - 1).cast("bigint")).otherwise(found)
    return F.when(page % 8 == 7, F.when(bits != 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(found)
