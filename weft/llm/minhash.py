"""Near-duplicate documents by HyperMinHash.

A document is the set of distinct shingles of its words.  The shingles fall into 252 buckets; of
each bucket's least hash a register keeps the count of leading zeros (6 bits) and the next
10 bits.  Documents that agree in all registers of a band, not all empty, are candidates; sets
of up to ``SMALL`` shingles have exact keys instead, which no linked pair of them is without.
Equal sets are one class first, so copies cost one row each.  Of candidates the registers give
an estimate of the Jaccard similarity, corrected for registers that agree by chance; pairs
that may reach the threshold are verified on the full sets of 64-bit shingle hashes.

Candidates of a band are not paired with each other at once.  In the first round each is
compared with one member alone, the one that meets most others over all its bands (an original
meets its copies more often than these each other), and what is linked becomes one component.
In the second round members of different components are compared, in tiles whose members bring
their registers along; those with a pair whose estimate passes come again with their sets, and
only links leave the cell.  Members of a band's largest component do not meet each other, and
tiles grow with the band, so a member comes ``2 * TILES`` times at most, unless its band's sets
pass ``HELD`` bytes a tile.  So no link between components is lost, and what is written follows
the members, not their pairs.

Null and empty texts, and texts without words, have an empty set and are linked with nothing.
Fewer words than a shingle count as one shingle.  Repeated rows share their component; a null
doc_id is linked by its text like any other, and is the smallest id of a component only alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.blocks import Block, Blocks, Keys, count_keys, whole
from weft.llm.common import ITEMS_A, U64, Rows, Scratch, mix, slices, word_hashes, words_of

SHINGLE, SIMILAR = 2, 80
REGISTERS = 252
#: Shingles of a set with exact keys, at most, and shingles in such a key.
SMALL, TOGETHER = 16, 4
#: Classes of larger set sizes: from, to, bands.
CLASSES = ((SMALL + 1, 32, 11), (33, 64, 19), (65, 160, 28), (161, 1 << 62, 42))
MANTISSA = 10
#: Members of a band in a tile, and of its largest component; in larger bands there are ``TILES``
#: tiles of each kind, and more only where the sets of one would pass ``HELD`` bytes.
TILE, OWN_TILE, TILES, HELD = 512, 2048, 8, 32 << 20
#: Pairs that a cell looks at together, and bytes of rows that a worker judges together.
PAIRS, JUDGED = 1 << 18, 32 << 20
#: Classes that meet a pivot in one cell: two to this power, numbered one after the other.
MET = 10
#: How many standard deviations below the threshold an estimate may lie.
SIGMAS = 5.0


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    texts = [t.lower() for t in texts]  # A-Z only
    data, starts, ends, first = words_of(texts)
    own = word_hashes(data, starts, ends)
    sums = ITEMS_A.sums(own)
    grams = mix(ITEMS_A.grams(sums, words) + U64(words))
    out = []
    for i, j in zip(first.tolist(), first.tolist()[1:], strict=False):
        if j - i >= words:
            out.append(np.unique(grams[i : j - words + 1]))
        elif j > i:
            few = ITEMS_A.of(sums, np.array([i]), np.array([j]))
            out.append(mix(few + U64(j - i)))
        else:
            out.append(grams[:0])
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        h = mix(shingles ^ U64(0x6A09E667F3BCC909))
        bucket = ((h >> U64(40)) % U64(REGISTERS)).astype(np.int64)
        value = mix(h ^ U64(0xBB67AE8584CAA73B))
        least = np.full(REGISTERS, 2**64 - 1, U64)
        np.minimum.at(least, bucket, value)
        has = np.bincount(bucket, minlength=REGISTERS) > 0
        # leading zeros and the bits after the first one
        top = np.frexp((least >> U64(11)).astype(np.float64))[1].astype(np.int64) + 11
        top = np.maximum(top, MANTISSA + 1)
        zeros = np.minimum(64 - top, 62)
        rest = (least >> (top - 1 - MANTISSA).astype(U64)) & U64((1 << MANTISSA) - 1)
        out[has] = ((zeros + 1) << MANTISSA | rest.astype(np.int64))[has].astype(np.uint16)
    return out


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate, rows of registers against rows, leaves room for the threshold."""
    used = (a > 0) | (b > 0)
    count = np.maximum(used.sum(axis=1), 1)
    agree = ((a == b) & used).sum(axis=1)
    t = percent / 100
    chance = count / 2.0**MANTISSA / 2  # registers that agree although the least hashes differ
    estimate = np.clip((agree - chance) / np.maximum(count - chance, 1e-9), 0, 1)
    room = SIGMAS * np.sqrt(t * (1 - t) / count) + 1 / count
    # of n shingles in m buckets some share a bucket; sets far smaller than the buckets vary less
    sizes = np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)
    return sizes & (estimate >= t - room)


class Profiles:
    """The sets of a block, and the first text of each set."""

    def __init__(self, block: Block, words: int):
        self.sets: list[np.ndarray] = []
        for s, e in slices(block.texts, 1 << 20):
            self.sets += shingle_sets(block.texts[s:e], words)
        self.full = np.array([i for i, x in enumerate(self.sets) if len(x)], np.int64)
        self.digest = [hashlib.blake2b(self.sets[i].tobytes(), digest_size=16).digest() for i in self.full]
        pairs = np.frombuffer(b"".join(self.digest), U64).reshape(-1, 2)
        self.keys = pairs[:, 0], pairs[:, 1]

    def classes(self, shards: int) -> Keys:
        return Keys(*self.keys, shards)

    def own(self, told: dict, shards: int) -> list[tuple[bytes, np.ndarray]]:
        """Digest and set of the classes that this block stands for."""
        mine = np.flatnonzero(self.classes(shards).repeated(told, "classes"))
        seen: dict[bytes, np.ndarray] = {}
        for i in mine.tolist():
            seen.setdefault(self.digest[i], self.sets[self.full[i]])
        return list(seen.items())


def first_keys(parts: Iterator[list[bytes]]) -> list[bytes]:
    """The shard's side: each 128-bit key is given to one of the messages that have it."""
    bodies = whole(parts)
    sizes = [int.from_bytes(x[:4], "little") for x in bodies]
    a = np.concatenate([np.frombuffer(x, U64, n, 4) for x, n in zip(bodies, sizes, strict=True)])
    b = np.concatenate([np.frombuffer(x, U64, n, 4 + 8 * n) for x, n in zip(bodies, sizes, strict=True)])
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.zeros(len(a), bool)
    first[order[new]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(first[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def small_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each exact key of sets of up to ``SMALL`` shingles, given sorted.

    Two sets that are linked and not equal share at least percent / (100 - percent) shingles, and
    each shares at least percent of its own.  So the least few that they share lie at the front
    of both, before the places that the others need: each choice of as many there is a key."""
    few = min(TOGETHER, -(-percent // max(1, 100 - percent)))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for n in range(few, SMALL + 1):
        own = np.flatnonzero(sizes == n)
        if len(own):
            front = n - max(few, -(-percent * n // 100)) + few
            chosen = np.array(list(combinations(range(front), few)))
            values = mix(np.array([sets[i] for i in own.tolist()]) ^ U64(0x94D049BB133111EB))
            rows.append(np.repeat(own, len(chosen)))
            keys.append(mix(values[:, chosen].sum(axis=2, dtype=U64) + U64(few)).ravel())
    return np.concatenate(rows), np.concatenate(keys)


def band_keys(r: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and number of each band that is not empty, of rows of registers of sets of n shingles.

    Smaller sets leave more registers empty, so they have fewer and wider bands; the smallest have
    none (``small_keys``).  A pair is lost when each band is spoiled by a shingle of one set
    alone or is empty.  A set joins the bands of its own class of sizes and of the largest set
    that it can be linked with."""
    largest = np.asarray(n) * 100 // percent
    value = np.where(r > 0, mix(r.astype(U64) + np.arange(REGISTERS, dtype=U64) * U64(0x9E3779B97F4A7C15)), U64(0))
    rows, keys, names = [], [], []
    for c, (low, high, bands) in enumerate(CLASSES):
        own = np.flatnonzero((largest >= low) & (np.asarray(n) <= high))
        starts = -(-np.arange(bands) * REGISTERS // bands)
        total = np.add.reduceat(value[own], starts, axis=1) if len(own) else np.zeros((0, bands), U64)
        full = np.add.reduceat((r[own] > 0).astype(np.int64), starts, axis=1) > 0 if len(own) else np.zeros((0, bands), bool)
        row, band = np.nonzero(full)
        rows.append(own[row])
        keys.append(mix(total[row, band] + band.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(c)))
        names.append(band + sum(x for _, _, x in CLASSES[:c]))
    row, key, name = np.concatenate(rows), np.concatenate(keys), np.concatenate(names)
    order = np.argsort(row, kind="stable")
    return row[order], key[order], name[order]


def _least_common(r: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least band key that rows a and b share, or the largest number: of all cells of bands
    where a pair meets, one's."""
    row, key, name = band_keys(r, n, percent)
    keys = np.zeros((len(r), sum(x for _, _, x in CLASSES)), np.int64)
    keys[row, name] = key.view(np.int64)
    out = [np.where((keys[x] == keys[y]) & (keys[x] != 0), keys[x], np.iinfo(np.int64).max).min(axis=1) for x, y in ((a[s : s + 4096], b[s : s + 4096]) for s in range(0, len(a), 4096))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _by_cell(rows: DataFrame, cell: list[str], judge: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    """``judge`` over whole cells, many small ones at once; it is also given where cells begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in cell]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == x for c, x in zip(cell, last, strict=True)])
            at = int(np.flatnonzero(same)[0])  # where the batch's last cell begins, which may go on
            if at == 0 and held and all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == x for c, x in zip(cell, last, strict=True)):
                held.append(batch)
                continue
            yield from whole([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in parts if x.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            keys = [table.column(c).to_numpy() for c in cell]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            begins = np.flatnonzero(new)
            # whole cells of about JUDGED bytes together, since judging copies them
            share = np.searchsorted(begins, np.arange(0, table.num_rows, max(1, table.num_rows * JUDGED // max(1, table.nbytes))))
            stops = np.unique(np.append(share, len(begins)))
            for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                end = int(begins[y]) if y < len(begins) else table.num_rows
                yield from judge(table.slice(begins[x], end - int(begins[x])), begins[x:y] - begins[x])

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, fields)


def _estimates(r: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    ok = [may_link(r[a[s : s + 4096]], r[b[s : s + 4096]], n[a[s : s + 4096]], n[b[s : s + 4096]], percent) for s in range(0, len(a), 4096)]
    return np.concatenate(ok) if ok else np.zeros(0, bool)


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether full sets, those at a against those at b, reach the threshold."""
    ok = np.zeros(len(a), bool)
    for p, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = sets[x], sets[y]
        both = len(np.intersect1d(x, y, assume_unique=True))
        ok[p] = 100 * both >= percent * (len(x) + len(y) - both)
    return ok


def _judged(pairs: DataFrame, values: DataFrame, judge: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs (cell, a, b) that pass.  The values of a class are sent to a cell once, however
    many of the cell's pairs it is in."""
    ends = pairs.select("cell", F.col("a").alias("k"), F.col("b").alias("o")).unionAll(pairs.select("cell", F.col("b").alias("k"), F.lit(None).cast("bigint").alias("o")))
    needed = ends.groupBy("cell", "k").agg(F.collect_list("o").alias("others"))

    def run(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, k = table.column("cell").to_numpy(), table.column("k").to_numpy()
        at = {x: i for i, x in enumerate(zip(cell.tolist(), k.tolist(), strict=True))}
        left, right = [], []
        for i, (c, others) in enumerate(zip(cell.tolist(), table.column("others").to_pylist(), strict=True)):
            left += [i] * len(others)
            right += [at[c, o] for o in others]
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        ok = judge(table, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[a[ok]], k[a[ok]], k[b[ok]])], ["cell", "a", "b"])

    return _by_cell(needed.join(values.hint("merge"), "k"), ["cell"], run, "cell bigint, a bigint, b bigint")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose registers leave room for a link."""

    def judge(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _estimates(np.frombuffer(b"".join(table.column("r").to_pylist()), np.uint16).reshape(-1, REGISTERS), table.column("n").to_numpy(), a, b, percent)

    return _judged(pairs, classes.select("k", "n", "r"), judge)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def judge(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _similar([np.frombuffer(x, U64) for x in table.column("s").to_pylist()], a, b, percent)

    return _judged(pairs, classes.select("k", "s"), judge)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """k, root (the smallest k reachable), for every k that has an edge.  Labels fall along edges
    and then jump to the label of the label, until none changes."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("k"), F.least("x", "y").alias("root")), f"{name}-0")
    for turn in range(1, 200):
        near = both.join(labels.withColumnRenamed("k", "y").hint("merge"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "k").hint("merge"), "k").select("k", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        step = scratch.write(step, f"{name}-s{turn}")
        jump = step.select(F.col("k").alias("to"), F.col("to").alias("far"))
        moved = step.join(jump.hint("merge"), "to", "left").select("k", F.least("to", "far").alias("root"), "was")
        moved = scratch.write(moved, f"{name}-{turn}")
        labels = moved.select("k", "root")
        if moved.where("root <> was").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def _pairs(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a left and a right row, or of two left ones, about ``PAIRS`` at once."""
    other = left if right is None else right
    step = max(1, PAIRS // max(1, len(other)))
    for s in range(0, len(left), step):
        x, y = np.indices((len(left[s : s + step]), len(other))).reshape(2, -1)
        if right is None:
            x, y = x[x + s < y], y[x + s < y]
        yield left[s + x], other[y]


def _meeting(table: pa.Table, new: np.ndarray, r: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a and b of a cell that have different roots and whose registers leave room for a
    link, some thousands at once; a pair that meets in several bands comes in one of them, and
    one that meets by exact keys alone comes with each."""
    band, root, tile, i, j = (table.column(x).to_numpy() for x in ("band", "root", "tile", "i", "j"))
    some: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def passed() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*some, strict=True))
        ok = _estimates(r, n, a, b, percent)
        a, b = a[ok], b[ok]
        least = _least_common(r, n, a, b, percent) if len(a) else np.zeros(0, np.int64)
        own = (least == band[a]) | (least == np.iinfo(np.int64).max)
        return a[own], b[own]

    for s, e in zip(new.tolist(), [*new[1:].tolist(), len(band)], strict=True):
        if i[s] == j[s]:
            pairs = _pairs(np.arange(s, e), None)
        else:
            pairs = _pairs(s + np.flatnonzero(tile[s:e] == i[s]), s + np.flatnonzero(tile[s:e] == j[s]))
        for a, b in pairs:
            near = (root[a] != root[b]) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
            some.append((a[near], b[near]))
            size += int(near.sum())
            if size >= 8192:
                yield passed()
                some, size = [], 0
    if some:
        yield passed()


def _tiles(placed: DataFrame) -> DataFrame:
    """band, i, j, tile, k, root: the members of each band with different roots, once for each cell
    (two tiles i and j, or one) that they meet in; ``placed``: band, k, n, root.  Each two members with different
    roots meet in one cell.  Where a root has more than ``TILE`` members, they have tiles of their own, which
    do not meet each other."""
    own = placed.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    bands = own.groupBy("band").agg(F.sum("c").alias("m"), F.sum("s").alias("all"), F.count("*").alias("roots"), F.max(F.struct("c", "s", "root")).alias("most"))
    most = F.col("most.c") > TILE
    number = lambda c, s, size: F.greatest(F.least(F.ceil(c / size), F.lit(TILES)), F.ceil(8 * s / HELD))
    bands = bands.where("roots > 1").select("band", F.when(most, F.col("most")).alias("most"), F.col("m") - F.when(most, F.col("most.c")).otherwise(0), F.col("all") - F.when(most, F.col("most.s")).otherwise(0))
    bands = bands.toDF("band", "most", "m", "s")
    bands = bands.select("band", F.col("most.root").alias("main"), F.coalesce(number(F.col("most.c"), F.col("most.s"), OWN_TILE) * F.col("most.c").isNotNull().cast("int"), F.lit(0)).alias("u"), number(F.col("m"), F.col("s"), TILE).alias("t"))
    rows = placed.join(bands.hint("merge"), "band")
    main, hashed = F.coalesce(F.col("root") == F.col("main"), F.lit(False)), F.xxhash64("k")
    tile = F.when(main, F.pmod(hashed, F.greatest("u", F.lit(1)))).otherwise(F.col("u") + F.pmod(hashed, F.col("t")))
    meets = F.sequence(F.when(main, F.col("u")).otherwise(0).cast("bigint"), F.col("u") + F.col("t") - 1)
    rows = rows.select("band", "k", "root", tile.alias("tile"), meets.alias("meets"))
    return rows.select("band", "k", "root", "tile", F.explode("meets").alias("o")).select("band", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "k", "root")


def _tiled(placed: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of one band and different roots; ``placed``: band, k, n, root.
    Members are dealt to tiles by a hash; the tiles of different roots meet in cells of their own,
    whatever the size of the band.  Members bring their registers first, and those
    with a pair that may be a link come again with their sets; pairs stay within the cell."""
    spread = _tiles(placed).join(classes.select("k", "n", "r").hint("merge"), "k").select("band", "i", "j", "tile", "k", "root", "n", "r")
    cell = ["band", "i", "j"]

    def hopeful(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = np.frombuffer(b"".join(table.column("r").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        any_pair = np.zeros(table.num_rows, bool)
        for a, b in _meeting(table, new, r, table.column("n").to_numpy(), percent):
            any_pair[a] = any_pair[b] = True
        yield from table.select([*cell, "tile", "k", "root"]).filter(pa.array(any_pair)).combine_chunks().to_batches()

    def links(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x, U64) for x in table.column("s").to_pylist()]
        r = np.array([registers(x) for x in sets], np.uint16).reshape(-1, REGISTERS)
        k, n = table.column("k").to_numpy(), np.array([len(x) for x in sets], np.int64)
        for a, b in _meeting(table, new, r, n, percent):
            ok = _similar(sets, a, b, percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[a], k[b])[ok]), pa.array(np.maximum(k[a], k[b])[ok])], ["a", "b"])

    left = scratch.write(_by_cell(spread, cell, hopeful, "band bigint, i bigint, j bigint, tile bigint, k bigint, root bigint"), "hopeful")
    return _by_cell(left.join(classes.select("k", "s").hint("merge"), "k"), cell, links, "a bigint, b bigint").distinct()


def near_groups(documents: DataFrame, words: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``documents``."""
    with Scratch(documents.sparkSession) as scratch:
        return _groups(documents, words, percent, scratch)


def _groups(documents: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    blocks = Blocks(documents, scratch)
    shards = blocks.shards

    def profiles(block: Block) -> Iterator[pa.RecordBatch]:
        p = Profiles(block, words)
        c: list[bytes | None] = [None] * len(p.sets)
        for i, x in zip(p.full.tolist(), p.digest, strict=True):
            c[i] = x
        yield pa.RecordBatch.from_arrays([block.ids, pa.array([len(x) for x in p.sets], pa.int64()), pa.array(c, pa.binary())], ["doc_id", "n", "c"])

    rows = scratch.write(blocks.each(profiles, f"doc_id {blocks.kind}, n bigint, c binary"), "rows")
    blocks.ask("classes", lambda block, n: Profiles(block, words).classes(n).messages(), first_keys)

    def banded(block: Block) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        own = Profiles(block, words).own(block.told, shards)
        r = np.array([registers(x) for _, x in own], np.uint16).reshape(-1, REGISTERS)
        row, key, _ = band_keys(r, np.array([len(x) for _, x in own], np.int64), percent)
        small, exact = small_keys([x for _, x in own], percent)
        row, key = np.concatenate([row, small]), np.concatenate([key, exact])
        order = np.argsort(row, kind="stable")
        return own, r, row[order], key[order]

    blocks.ask("bands", lambda block, n: Keys(banded(block)[3], None, n).messages(), count_keys)

    def candidates(block: Block) -> Iterator[pa.RecordBatch]:
        own, r, row, key = banded(block)
        hit = Keys(key, None, shards).repeated(block.told, "bands")
        row, key = row[hit], key[hit].view(np.int64)
        at, first = np.unique(row, return_index=True)
        for s in range(0, len(at), 256):
            some = list(zip(at[s : s + 256].tolist(), first[s : s + 256].tolist(), [*first[s + 1 : s + 256].tolist(), first[s + 256] if s + 256 < len(at) else len(row)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own[i][0] for i, _, _ in some], pa.binary()),
                    pa.array([len(own[i][1]) for i, _, _ in some], pa.int64()),
                    pa.array([r[i].tobytes() for i, _, _ in some], pa.binary()),
                    pa.array([own[i][1].tobytes() for i, _, _ in some], pa.binary()),
                    pa.array([key[x:y] for _, x, y in some], pa.list_(pa.int64())),
                ],
                ["c", "n", "r", "s", "bands"],
            )

    touched = blocks.each(candidates, "c binary, n bigint, r binary, s binary, bands array<bigint>")
    touched = scratch.write(touched.withColumn("k", F.monotonically_increasing_id()), "touched")
    banded_rows = touched.select("k", "n", F.explode("bands").alias("band"))
    sizes = scratch.write(banded_rows.groupBy("band").agg(F.min("k").alias("least"), F.count("*").alias("m")), "sizes")
    members = scratch.write(banded_rows.join(sizes.hint("merge"), "band"), "members")
    larger = members.where("m > 2").select("band", "k", "m")
    hubs = larger.join(larger.groupBy("k").agg(F.sum("m").alias("meets")).hint("merge"), "k")
    hubs = scratch.write(hubs.groupBy("band").agg(F.max_by("k", F.struct("meets", -F.col("k"))).alias("hub")), "hubs")
    paired = members.join(hubs.hint("merge"), "band", "left").select(F.coalesce("hub", "least").alias("a"), F.col("k").alias("b")).where("a <> b").distinct()
    # the cells of a pivot: one for each 2 ** MET classes that a task numbered one after the other
    paired = paired.withColumn("cell", F.xxhash64("a", F.shiftright("b", MET)))
    near = scratch.write(_estimated(paired, touched, percent), "near-1")
    edges = scratch.write(_verified(near, touched, percent), "edges-1")
    roots = components(edges, scratch, "labels-1")
    # whatever lies in one band and in different components is compared; then all has been
    placed = members.join(roots.hint("merge"), "k", "left").select("band", "k", "n", F.coalesce("root", "k").alias("root"))
    links = _tiled(scratch.write(placed, "placed"), touched, percent, scratch)
    edges = edges.select("a", "b").unionByName(scratch.write(links, "edges-2"))
    roots = components(edges, scratch, "labels-2")
    classes = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    own = touched.select("c", "k").join(roots.hint("merge"), "k", "left").select("c", F.coalesce("root", "k").alias("root"))
    named = scratch.write(classes.join(own.hint("merge"), "c", "left"), "named")
    smallest = scratch.write(named.where("root is not null").groupBy("root").agg(F.min("least").alias("component")), "smallest")
    linked = named.where("root is not null").join(smallest.hint("merge"), "root").select("c", "component")
    found = scratch.write(linked.unionByName(named.where("root is null").select("c", F.col("least").alias("component"))), "found")
    joined = rows.where("c is not null").join(found.hint("merge"), "c").select("doc_id", "n", "component")
    lone = rows.where("c is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    kept = F.col("doc_id").eqNullSafe(F.col("component"))
    result = joined.unionByName(lone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
    return scratch.write(result, "result", keep=True)


def keep_one(documents: DataFrame, words: int = 5, percent: int = SIMILAR) -> DataFrame:
    """The documents, with all their columns, one of each component: that with the smallest doc_id (a
    null one is larger than any other), of rows that share it the first.  Texts without words
    are linked with nothing, so they all stay.  Decisions go by row, not by doc_id."""
    with Scratch(documents.sparkSession) as scratch:
        rows = Rows(documents, scratch)
        own = rows.column("doc_id")
        keys = F.struct(own.isNull().alias("n"), own.alias("id"), F.col("row").alias("r")).alias("doc_id")
        groups = near_groups(rows.table.select(keys, rows.column("text").alias("text")), words, percent)
        return rows.without(groups.where(~F.col("kept")).select(F.col("doc_id.r").alias("row")))
