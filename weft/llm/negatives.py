"""Hard negatives by distributed radix selection.

Every anchor has windows of scores: at first one for its positives, over all scores of rows with its label;
then one for each positive, over the scores of rows with another label from ``MARGIN`` percent
of the positive's score up to that score.  A window asks for the k rows nearest to its upper end.  Distances to
that end are integers; their digits are found from the highest down.  In a round each task
counts, for its rows and its anchors, the distances of a window that share the digits found so far by
their next digit; summed over tasks, the histogram shows which digit the k-th row has and how many rows lie
before it.  A task leaves out what comes after its own k-th row, as the k-th of all rows
does not come later.  When all digits are known, only rows up to the k-th distance are gathered; of
equal ones beyond k each task keeps those with the smallest ids.

Rows lie in shards of blocks by ranges of ids; anchors in parts of ``PART`` at most; every part meets every
shard in a task of its own, which returns at most k rows for each window.  So no task depends on
how many rows share a label, a vector or an id.

A component x counts as floor(256 * x), x as double.  Rows with a null id, a null label, or a vector that is null, empty or holds
a null, NaN or infinity take no part; vectors of another length are not compared.  Where the
id is divisible by 7 the label first becomes (label + 1) % 10.  Rows that share an id are candidates one by
one, and none of an anchor with that id; an anchor that is repeated is answered once, for its first
vector in the order of its components, then its smallest label.  An anchor with fewer positives or a window with fewer rows
has all of them; a window of a negative positive score is empty.  An empty table gives an empty result; columns other than vec_id, label and the
vectors are not read.  Scores beyond 2**60 are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from weft.llm.common import Scratch, begin

K, SCALE, EVERY, MARGIN = 5, 256, 100, 80
#: Rows of a block, blocks of a shard, anchors of a part, bits of a digit.
BLOCK, SHARD, PART, DIGIT = 512, 16, 4096, 8
#: Components of one product of a block of anchors with a block of rows that are computed at once.
ANCHORS = 256


def _valid(vectors: DataFrame, column: str, relabel: Column) -> DataFrame:
    """vec_id, label, v (components as integers), d (their number) of the rows that take part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), relabel.alias("label"), x.alias("x"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
    sound &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("x", lambda v: F.floor(v * SCALE).cast("long"))
    return rows.where(sound).select("vec_id", "label", whole.alias("v"), F.size("x").alias("d"))


def _blocks(rows: DataFrame, shards: int) -> DataFrame:
    """The rows in packed blocks: shard, d, ids, labels, vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(d: int) -> pa.RecordBatch:
            columns = zip(*held.pop(d), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([np.array(c, "<i8").tobytes()]) for c in columns)], ["d", "ids", "labels", "vectors"])

        for batch in batches:
            for i, label, v, d in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "d")), strict=True):
                held.setdefault(d, []).append((i, label, v))
                if len(held[d]) == BLOCK:
                    yield out(d)
        for d in list(held):
            yield out(d)

    # the row number splits ids that very many rows share
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(shards, "vec_id", "at").sortWithinPartitions("vec_id")
    packed = ranged.select("vec_id", "label", "v", "d").mapInArrow(pack, "d int, ids binary, labels binary, vectors binary")
    return packed.withColumn("shard", F.spark_partition_id())


def _unpacked(blocks: pd.DataFrame, d: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    own = blocks[blocks["d"] == d]
    return [(np.frombuffer(b.ids, "<i8"), np.frombuffer(b.labels, "<i8"), np.frombuffer(b.vectors, "<i8").reshape(-1, d)) for b in own.itertuples()]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products; in double arithmetic, which is faster, where that is exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _distances(asked: pd.DataFrame, blocks: pd.DataFrame, same: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each window of the asked anchors: its place in ``asked``, the ids of this shard's rows that it
    may take and their distances to its upper end, in the order of ids."""
    for d, group in asked.groupby("d"):
        own = _unpacked(blocks, d)
        if not own:
            continue
        ids, labels = np.concatenate([b[0] for b in own]), np.concatenate([b[1] for b in own])
        rows = np.concatenate([b[2] for b in own])
        for anchors in (group.iloc[i : i + ANCHORS] for i in range(0, len(group), ANCHORS)):
            q = np.frombuffer(b"".join(anchors["v"]), "<i8").reshape(-1, d)
            # windows of one anchor lie together: its products are computed once
            first = np.concatenate([[True], anchors["vec_id"].to_numpy()[1:] != anchors["vec_id"].to_numpy()[:-1]])
            scores = _products(q[first], rows)
            for at, a, label, vec_id, high, width in zip(anchors.index, np.cumsum(first) - 1, anchors["label"], anchors["vec_id"], anchors["high"], anchors["width"], strict=True):
                far = high - scores[a]
                take = np.flatnonzero(((labels == label) == same) & (ids != vec_id) & (far >= 0) & (far <= width))
                yield at, ids[take], far[take]


def _counted(same: bool, shift: int):
    """Of each window the histogram of the digit at ``shift`` among rows with the digits found before, up to this shard's
    k-th row."""

    def run(_, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        begin("negatives")
        out: list[tuple[int, int, int, int]] = []
        asked = asked.sort_values(["vec_id", "slot"], ignore_index=True)
        keys = list(zip(asked["vec_id"], asked["slot"], asked["prefix"], asked["need"], strict=True))
        for at, _, far in _distances(asked, blocks, same):
            vec_id, slot, prefix, need = keys[at]
            digits = far[(far >> (shift + DIGIT)) == prefix] >> shift & ((1 << DIGIT) - 1)
            counts = np.bincount(digits, minlength=1 << DIGIT)
            before = np.cumsum(counts) - counts
            for digit in np.flatnonzero((counts > 0) & (before < need)).tolist():
                out.append((vec_id, slot, digit, int(counts[digit])))
        return pd.DataFrame(out, columns=["vec_id", "slot", "digit", "n"]).astype("int64")

    return run


def _gathered(same: bool, k: int):
    """Of each window this shard's rows up to the distance found, k at most."""

    def run(_, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        begin("negatives")
        out: list[pd.DataFrame] = []
        asked = asked.sort_values(["vec_id", "slot"], ignore_index=True)
        keys = list(zip(asked["vec_id"], asked["slot"], asked["high"], asked["prefix"], strict=True))
        for at, ids, far in _distances(asked, blocks, same):
            vec_id, slot, high, limit = keys[at]
            near = np.flatnonzero(far <= limit)
            near = near[np.lexsort((ids[near], far[near]))[:k]]
            out.append(pd.DataFrame({"vec_id": vec_id, "slot": slot, "found_id": ids[near], "score": high - far[near]}))
        return pd.concat([pd.DataFrame({c: [] for c in ("vec_id", "slot", "found_id", "score")}), *out]).astype("int64")

    return run


class Selection:
    """Radix selection of anchors' windows over the rows."""

    def __init__(self, blocks: DataFrame, shards: int, anchors: DataFrame, parts: int, scratch: Scratch):
        self.blocks, self.shards, self.anchors, self.parts, self.scratch = blocks, shards, anchors, parts, scratch

    def _meet(self, windows: DataFrame, run, schema: str) -> DataFrame:
        """Every part of the anchors with every shard of the rows."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asking = self.anchors.join(windows, "vec_id").select("*", every(self.shards).alias("shard"))
        # a part is a fixed number of anchors: every block goes to each of them once
        answering = self.blocks.select("*", every(self.parts).alias("part"))
        cell = ("shard", "part")
        return asking.groupBy(*cell).cogroup(answering.groupBy(*cell)).applyInPandas(run, schema)

    def nearest(self, windows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """vec_id, slot, rank, found_id, score of the k rows nearest below each window's upper end.  ``windows``
        has vec_id, slot, high and width."""
        state = windows.where("width >= 0").select("vec_id", "slot", "high", "width", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
        state = self.scratch.write(state, f"{name}-windows")
        widest = state.agg(F.max("width")).first()[0] or 0
        rounds = max(1, -(-int(widest).bit_length() // DIGIT))
        for level in reversed(range(rounds)):
            state = self.scratch.write(self._round(state, same, level), f"{name}-{level}")
        found = self._meet(state, _gathered(same, k), "vec_id long, slot long, found_id long, score long")
        order = Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "found_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _round(self, state: DataFrame, same: bool, level: int) -> DataFrame:
        """The windows with one digit more.  One with fewer than k rows asks for no more: its limit is its width."""
        shift = DIGIT * level
        counts = self._meet(state.where("need > 0"), _counted(same, shift), "vec_id long, slot long, digit long, n long")
        summed = counts.groupBy("vec_id", "slot", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("vec_id", "slot").orderBy("digit")
        summed = summed.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        reached = summed.join(state.select("vec_id", "slot", "need"), ["vec_id", "slot"]).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        reached = reached.select("vec_id", "slot", F.col("digit").alias("next"), F.col("before").alias("passed"))
        open_ = F.col("need") > 0
        known = F.shiftleft("prefix", DIGIT) + F.col("next")
        after = state.join(reached, ["vec_id", "slot"], "left")
        prefix = F.when(~open_, F.col("prefix")).when(F.col("next").isNull(), F.col("width")).otherwise(known)
        need = F.when(open_ & F.col("next").isNotNull(), F.col("need") - F.col("passed")).otherwise(F.lit(0))
        return after.select("vec_id", "slot", "high", "width", prefix.alias("prefix"), need.cast("long").alias("need"))


def hard_negatives(vectors: DataFrame, column: str = "embedding", k: int = K, every: int = EVERY, margin: int = MARGIN, relabel: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row whose vec_id is
    divisible by ``every``) and each of its k positives, the k best rows of another label that score from
    ``margin`` percent of the positive's score up to that score."""
    with Scratch(vectors.sparkSession) as scratch:
        label = F.col("label").cast("long") if relabel is None else relabel
        rows = _valid(vectors, column, label.cast("long"))
        asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
        longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked).alias("anchors"), longest.alias("longest")).first()
        shards, parts = max(1, -(-size.rows // (BLOCK * SHARD))), max(1, -(-size.anchors // PART))
        blocks = scratch.write(_blocks(rows, shards), "blocks")
        first = rows.where(asked).groupBy("vec_id").agg(F.min(F.struct("d", "v", "label")).alias("m"))
        anchors = first.select("vec_id", "m.d", "m.v", "m.label", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"))
        anchors = scratch.write(_binary(anchors), "anchors")
        choose = Selection(blocks, shards, anchors, parts, scratch)
        # no score is farther from zero than the squared length of the longest vector
        bound = int((size.longest or 0.0) ** 2 * (1 + 1e-9)) + 1
        whole = anchors.select("vec_id", F.lit(0).cast("long").alias("slot"), F.lit(bound).cast("long").alias("high"), F.lit(2 * bound).cast("long").alias("width"))
        positives = choose.nearest(whole, k, True, "positive")
        positives = scratch.write(positives.select("vec_id", F.col("rank").cast("long").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # the smallest integer n with 100 * n >= margin * score, for scores from 0 on
        least = F.expr(f"(positive_score * {margin} + 99) div 100")
        below = F.when(F.col("positive_score") < 0, F.lit(-1)).otherwise(F.col("positive_score") - least)
        windows = positives.select("vec_id", "slot", F.col("positive_score").alias("high"), below.cast("long").alias("width"))
        negatives = choose.nearest(windows, k, False, "negative")
        out = negatives.join(positives, ["vec_id", "slot"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return scratch.write(out, "result", keep=True)


def _binary(anchors: DataFrame) -> DataFrame:
    """Vectors as bytes, which cells read without a step for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([np.array(v, "<i8").tobytes() for v in batch.column("v").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "d", "label", "part")), packed], ["vec_id", "d", "label", "part", "v"])

    return anchors.select("vec_id", "d", "label", F.col("part").cast("int").alias("part"), "v").mapInArrow(run, "vec_id long, d int, label long, part int, v binary")


def planted_label() -> Column:
    """Labels with planted mistakes: where vec_id is divisible by 7, the next label of ten."""
    label = F.col("label").cast("long")
    return F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
