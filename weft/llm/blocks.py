"""Documents in blocks, and questions that blocks put to shards about hashed strings.

Documents are written once as packed blocks to a table with a bucket for each task that wrote
them, so that what a block is told later reaches it without another shuffle of texts.  In a
round each block sends every shard one packed message with the distinct keys that belong
there; the shard answers each message, in its order, with a packed reply; and in the next
round the block derives the same keys again and reads its answers.  A key that a group of any
size shares is sent once by each block, so no shard gets more rows for a hot key than there are
blocks, and the number of shards follows the size of the input and the cores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.common import U64, Scratch, begin, text_bytes

#: Bytes of text in a block (a longer text is a block of its own), and for each shard of keys.
BLOCK, SHARD = 2 << 20, 32 << 20
#: Buckets of the table of blocks, at most (Spark allows 100,000).
BUCKETS = 50_000
_TOLD = "array<struct<round:string,shard:int,reply:binary>>"


def _bucket_hash(x: np.ndarray) -> np.ndarray:
    """The hash by which Spark deals whole 32-bit numbers to buckets: public Murmur3, seed 42."""
    turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    h = np.uint32(42) ^ (turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32)


def bucket_names(n: int) -> np.ndarray:
    """For each of n buckets a number that Spark deals to it, so no two tasks share a bucket."""
    names, at = np.full(n, -1, np.int32), 0
    while (names < 0).any():
        x = np.arange(at, at + 4 * n, dtype=np.int32)
        bucket = np.mod(_bucket_hash(x).astype(np.int64), n)
        first, where = np.unique(bucket, return_index=True)
        names[first] = np.where(names[first] < 0, x[where], names[first])
        at += 4 * n
    return names


class Block:
    def __init__(self, ids: pa.Array, texts: list[bytes], told: dict[tuple[str, int], bytes], number: int = 0):
        self.ids, self.texts, self.told, self.number = ids, texts, told, number


class Blocks:
    def __init__(self, documents: DataFrame, scratch: Scratch):
        self.scratch, self.spark = scratch, documents.sparkSession
        self.kind = documents.schema["doc_id"].dataType.simpleString()
        rows = documents.select("doc_id", "text")
        parts = rows.rdd.getNumPartitions()
        if parts > BUCKETS:
            rows, parts = rows.coalesce(BUCKETS), BUCKETS
        name = f"weft_blocks_{uuid.uuid4().hex}"
        scratch.tables.append(name)
        # with fewer buckets than shuffle partitions, joins would deal the texts out again
        self.parts = max(1, parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        names = bucket_names(self.parts)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("blocks")
            from pyspark import TaskContext

            p, n = int(names[TaskContext.get().partitionId()]), 0
            ids: list = []
            texts: list[bytes] = []
            size = 0

            def block() -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes()
                columns = {
                    "p": pa.array([p], pa.int32()),
                    "b": pa.array([p << 32 | n], pa.int64()),
                    "ids": pa.array([ids], pa.list_(kind)),
                    "ends": pa.array([ends], pa.binary()),
                    "data": pa.array([b"".join(texts)], pa.binary()),
                    "size": pa.array([size], pa.int64()),
                }
                return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

            for batch in batches:
                kind = batch.column("doc_id").type
                for i, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                    if texts and size + len(t) > BLOCK:
                        yield block()
                        ids, texts, size, n = [], [], 0, n + 1
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
            if texts:
                yield block()

        packed = rows.mapInArrow(pack, f"p int, b bigint, ids array<{self.kind}>, ends binary, data binary, size bigint")
        packed.write.format("parquet").option("compression", "zstd").bucketBy(self.parts, "p").saveAsTable(name)
        self.table = self.spark.table(name)
        self.total = self.table.agg(F.sum("size")).first()[0] or 0
        self.shards = self.shards_of(SHARD)
        self.sides: list[DataFrame] = []

    def shards_of(self, size: int) -> int:
        """Shards of about ``size`` bytes of text, and some for each core."""
        return max(4 * self.spark.sparkContext.defaultParallelism, -(-self.total // size))

    def _told(self) -> DataFrame:
        """p, told: the answers of all rounds so far, by block.  Dealt once by p; both groupings
        keep that dealing, and so does the join with the blocks."""
        rows = self.sides[0]
        for other in self.sides[1:]:
            rows = rows.unionByName(other)
        own = rows.repartition(self.parts, "p").groupBy("p", "b").agg(F.collect_list(F.struct("round", "shard", "reply")).alias("own"))
        return own.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("b", "own"))).alias("told"))

    def each(self, work: Callable[[Block], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
        """``work`` over every block, with the answers of all rounds so far."""
        rows = self.table.select("p", "b", "ids", "ends", "data")
        if self.sides:
            rows = rows.join(self._told().hint("shuffle_hash"), "p", "left")
            rows = rows.select("b", "ids", "ends", "data", F.try_element_at("told", F.col("b")).alias("told"))
        else:
            rows = rows.drop("p").withColumn("told", F.lit(None).cast(_TOLD))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("blocks")
            for batch in batches:
                for i in range(batch.num_rows):
                    ends = np.frombuffer(batch.column("ends")[i].as_py(), "<i8")
                    data = batch.column("data")[i].as_py()
                    texts = [data[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    told = {(x["round"], x["shard"]): x["reply"] for x in batch.column("told")[i].as_py() or ()}
                    yield from work(Block(batch.column("ids")[i].values, texts, told, batch.column("b")[i].as_py()))

        return rows.mapInArrow(run, fields)

    def ask(
        self,
        name: str,
        send: Callable[[Block, int], Iterator[tuple[int, bytes]]],
        answer: Callable[[Iterator[list[bytes]]], list[bytes]],
        shards: int | None = None,
    ) -> None:
        """A round: what ``send`` gives for shards, and the shards' answers, kept for later rounds.
        ``answer`` is given a shard's messages in some lists, one after the other."""
        shards = shards or self.shards

        def work(block: Block) -> Iterator[pa.RecordBatch]:
            messages = list(send(block, shards))
            for at in range(0, len(messages), 64):
                some = messages[at : at + 64]
                columns = [pa.array([s for s, _ in some], pa.int32()), pa.array([block.number] * len(some), pa.int64()), pa.array([m for _, m in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "b", "body"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("blocks")
            blocks: list[int] = []
            shard = 0

            def bodies() -> Iterator[list[bytes]]:
                nonlocal shard
                for batch in batches:
                    if batch.num_rows:
                        blocks.extend(batch.column("b").to_pylist())
                        shard = batch.column("shard")[0].as_py()
                        yield batch.column("body").to_pylist()

            replies = answer(bodies())
            for at in range(0, len(replies), 1024):
                b, some = blocks[at : at + 1024], replies[at : at + 1024]
                columns = {
                    "p": pa.array([x >> 32 for x in b], pa.int32()),
                    "b": pa.array(b, pa.int64()),
                    "round": pa.array([name] * len(b)),
                    "shard": pa.array([shard] * len(b), pa.int32()),
                    "reply": pa.array(some, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        judge.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # as types, not text
        asked = self.each(work, "shard int, b bigint, body binary")
        replies = asked.groupBy("shard").applyInArrow(judge, "p int, b bigint, round string, shard int, reply binary")
        self.sides.append(self.scratch.write(replies, f"round-{name}"))


class Keys:
    """The distinct keys of a block, dealt to shards.  A key is 64 or 128 bits."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, shards: int):
        self.wide = b is not None
        order = np.lexsort((b, a)) if self.wide else np.argsort(a, kind="stable")
        own = a[order]
        new = np.ones(len(a), bool)
        new[1:] = own[1:] != own[:-1]
        if self.wide:
            new[1:] |= b[order][1:] != b[order][:-1]
        group = np.cumsum(new) - 1
        self.of = np.empty(len(a), np.int64)
        self.of[order] = group
        self.count = np.bincount(group, minlength=0)
        self.a, self.b = own[new], b[order][new] if self.wide else None
        self.shard = (self.a % U64(shards)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")
        self.names, self.at = np.unique(self.shard[self.order], return_index=True)
        self.stops = np.append(self.at[1:], len(self.order))[: len(self.at)]  # none without keys

    def messages(self, counted: bool = False) -> Iterator[tuple[int, bytes]]:
        """For each shard its keys; and whether each occurs more than once, or with ``counted``
        how often (65,535 at most)."""
        for s, i, j in zip(self.names.tolist(), self.at.tolist(), self.stops.tolist(), strict=True):
            own = self.order[i:j]
            body = self.a[own].tobytes() + (self.b[own].tobytes() if self.wide else b"")
            last = np.minimum(self.count[own], 65535).astype("<u2") if counted else np.packbits(self.count[own] > 1)
            yield s, len(own).to_bytes(4, "little") + body + last.tobytes()

    def repeated(self, told: dict[tuple[str, int], bytes], name: str, bit: int = 0) -> np.ndarray:
        """For each key put in: whether it occurs again anywhere (or another bit of the answer)."""
        hit = np.zeros(len(self.a), bool)
        for s, i, j in zip(self.names.tolist(), self.at.tolist(), self.stops.tolist(), strict=True):
            width = (j - i + 7) // 8
            hit[self.order[i:j]] = np.unpackbits(np.frombuffer(told[name, s], np.uint8, width, bit * width), count=j - i).astype(bool)
        return hit[self.of]


def whole(parts: Iterator[list[bytes]]) -> list[bytes]:
    return [x for some in parts for x in some]


def count_keys(parts: Iterator[list[bytes]]) -> list[bytes]:
    """The shard's side: which keys occur more than once over all messages."""
    bodies = whole(parts)
    sizes = [int.from_bytes(x[:4], "little") for x in bodies]
    width = {(len(x) - 4 - (n + 7) // 8) // (8 * n) for x, n in zip(bodies, sizes, strict=True) if n}
    a = np.concatenate([np.frombuffer(x, U64, n, 4) for x, n in zip(bodies, sizes, strict=True)])
    b = np.concatenate([np.frombuffer(x, U64, n, 4 + 8 * n) for x, n in zip(bodies, sizes, strict=True)]) if 2 in width else None
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 + 8 * n * max(width)), count=n) for x, n in zip(bodies, sizes, strict=True)]).astype(bool)
    order = np.lexsort((b, a)) if b is not None else np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if b is not None:
        same &= b[order][1:] == b[order][:-1]
    again = np.zeros(len(a), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again |= flags
    ends = np.cumsum(sizes)
    return [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def count_hot_keys(parts: Iterator[list[bytes]], hot: int) -> list[bytes]:
    """For counted 64-bit keys: which occur more than once, and which ``hot`` times or more."""
    bodies = whole(parts)
    sizes = [int.from_bytes(x[:4], "little") for x in bodies]
    a = np.concatenate([np.frombuffer(x, U64, n, 4) for x, n in zip(bodies, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(x, "<u2", n, 4 + 8 * n) for x, n in zip(bodies, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(a, kind="stable")
    new = np.ones(len(a), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    total = np.empty(len(a), np.int64)
    total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(a) else 0
    ends = np.cumsum(sizes)
    own = [total[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
    return [np.packbits(x > 1).tobytes() + np.packbits(x >= hot).tobytes() for x in own]


def owners(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the place of its least one (the leftmost among equals)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return (np.minimum(low[:n], low[span - size : span - size + n]) & U64(0xFFFFFFFF)).astype(np.int64)


def marked_runs(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places are covered by runs of ``length`` from each start on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge)[:n] > 0
