"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into blocks of a range of ids; a block keeps its forward index (the vectors, one
component after the other) and each component's largest and smallest value.  A query's bound
for a block is the sum over components of the larger product with those two.  Each query
takes blocks in falling order of bound and stops at the first whose bound lies below its
k-th score so far, so that ties are never lost.  Queries travel in chunks of a fixed number,
chunks in groups of a fixed number; every shard of blocks meets every group in a task of its own,
which returns k rows for each query.  So a task holds one shard and one group at most, however
many vectors and queries there are and however many rows share a vec_id.

A component x counts as floor(1024 * x), x as double.  Vectors that are null, or hold a null, NaN
or infinity, or are empty, take no part; a query is compared with vectors of its own length.
A null vec_id takes no part.  Rows that share a vec_id are candidates one by one, and no
candidate of a query with the same vec_id; a query that is repeated is answered once, for its
first vector in the order of its components.  Equal scores go to the smaller vec_id; a query with
fewer than k candidates gets all of them; an empty table gives an empty result.  Columns other
than vec_id and the vectors are not read.  Scores beyond 64 bits are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from weft.llm.common import Scratch

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a block, blocks of a shard, queries of a chunk, chunks of a group.
BLOCK, SHARD, CHUNK, GROUP = 512, 32, 256, 64


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
    sound &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(sound)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("v"), F.size("x").alias("d"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows in the order of ids as packed matrices of ``size`` at most: d, ids, values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(d: int) -> pa.RecordBatch:
            ids, values = held.pop(d)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array(values, "<i8").tobytes()])], ["d", f"{name}_ids", f"{name}_values"])

        for batch in batches:
            for i, d, v in zip(batch.column("vec_id").to_pylist(), batch.column("d").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, values = held.setdefault(d, ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == size:
                    yield out(d)
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(pack, f"d int, {name}_ids binary, {name}_values binary")


def _matrix(ids: bytes, values: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(values, "<i8").reshape(-1, d)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; in double arithmetic, which is faster, where that is exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def search(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list, list, list]:
    """The k best of the blocks for each query: query ids, vector ids, scores."""
    high, low = np.array([x.max(axis=0) for _, x in blocks], float), np.array([x.min(axis=0) for _, x in blocks], float)
    found: tuple[list, list, list] = ([], [], [])
    for own, q in zip(*queries, strict=True):
        # a little above, so that rounding of large sums cannot lower a bound below a score
        bound = np.maximum(high * q, low * q).sum(axis=1)
        bound += np.abs(bound) * 1e-9 + 1
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in np.argsort(-bound, kind="stable"):
            if least is not None and bound[b] < least:
                break
            name, x = blocks[b]
            score, other = _exact(q, x), name != own
            ids, scores = np.concatenate([ids, name[other]]), np.concatenate([scores, score[other]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            least = scores[-1] if len(ids) == k else None
        found[0].extend([own] * len(ids))
        found[1].extend(ids.tolist())
        found[2].extend(scores.tolist())
    return found


def top_k(vectors: DataFrame, column: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for every query: a row whose vec_id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession)
    rows = _valid(vectors, column)
    size = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.pmod(F.col("vec_id").cast("long"), F.lit(every)) == 0).alias("queries")).first()
    parts = max(1, -(-size.rows // (BLOCK * SHARD)))
    # the row number splits ids that very many rows share
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, "vec_id", "at").sortWithinPartitions("vec_id")
    blocks = _packed(ranged, BLOCK, "block").withColumn("shard", F.spark_partition_id())
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("m")).select("vec_id", "m.d", "m.v")
    chunks = _packed(asked.repartitionByRange(max(1, -(-size.queries // CHUNK)), "vec_id"), CHUNK, "query")
    chunks = scratch.write(chunks.withColumn("part", (F.spark_partition_id() / GROUP).cast("int")), "queries", keep=True)
    blocks = scratch.write(blocks, "blocks", keep=True)
    # a fixed number of queries against all rows, block by block: each side learns its cells
    shards = blocks.groupBy(F.col("d").alias("of")).agg(F.collect_set("shard").alias("shards"))
    groups = chunks.groupBy(F.col("d").alias("of")).agg(F.collect_set("part").alias("groups"))
    asking = chunks.join(shards, chunks["d"] == shards["of"]).select("part", "d", "query_ids", "query_values", F.explode("shards").alias("shard"))
    answering = blocks.join(groups, blocks["d"] == groups["of"]).select("shard", "d", "block_ids", "block_values", F.explode("groups").alias("part"))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for q in left.itertuples():
            own = [_matrix(b.block_ids, b.block_values, b.d) for b in right.itertuples() if b.d == q.d]
            if own:
                for a, b in zip(out, search(_matrix(q.query_ids, q.query_values, q.d), own, k), strict=True):
                    a += b
        return pd.DataFrame({"query_id": out[0], "vec_id": out[1], "score": out[2]}, dtype="int64")

    cell = ("shard", "part")
    found = asking.groupBy(*cell).cogroup(answering.groupBy(*cell)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
