"""Periodic runs of words: every maximal repetition of a text, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.
The texts of a batch are sorted into one suffix array (texts one after the other, so no match
crosses from one into the next) with its array of longest common prefixes.  The array of
longest previous factors follows from both, and cuts each text into Lempel-Ziv blocks.  A run
that touches a block's edge is found from that edge: Main's extensions to both sides, for each
period that the lengths of the two blocks allow.  A run strictly inside a block is a shift
of one inside the earlier occurrence of that block, and is copied from there; the runs lie in
buckets by their start, in order, so that copies can be copied on.

A period of a run that starts at or before an edge and ends in the block behind it lies below (length of
that block + length of the one before) / (exponent - 1): the part before the edge is shorter than
the block before and one period together, or that block would have been longer.

A null text has no words; a text without words has no runs and its hashes are those of empty strings.
Repeated rows are answered one by one.  An empty table gives an empty result; columns other than
doc_id and text are not read.  A null doc_id is carried along (and its text is never rewritten).
Texts are never cut: a task holds about 4 MB of texts or one text, whichever is larger, and for
each word about 60 bytes and 4 more for each doubling of its longest repeated stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import begin, slices, text_bytes

#: Least length of a run in periods and in words.
EXPONENT, LEAST = 4, 6


class Suffixes:
    """The suffixes of several texts laid end to end, sorted by doubling; ``first`` holds where each
    text starts (one entry more).  ``levels[k]`` numbers the stretches of 2**k words (shorter ones
    at a text's end), equal numbers for equal stretches of one text."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[text + 1]
        key = text * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        self.levels = [self._numbers(np.diff(key[self.order], prepend=-1) != 0, n)]
        span = 1
        open_ = self._open(self.levels[0], np.arange(n))
        while len(open_):
            rank = self.levels[-1]
            at = self.order[open_]
            after = np.where(at + span < end[at], rank[np.minimum(at + span, n)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + after
            sort = np.argsort(key, kind="stable")
            self.order[open_] = at = at[sort]
            head = np.diff(key[sort], prepend=-1) != 0
            places = open_[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
            rank = rank.copy()
            rank[at] = places
            self.levels.append(rank)
            open_ = self._open(rank, open_)
            span *= 2

    def _numbers(self, head: np.ndarray, n: int) -> np.ndarray:
        """For each place of a text where its group starts in the order; one more that equals none."""
        out = np.full(n + 1, -1, np.int32)
        out[self.order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        return out

    def _open(self, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of these places of the order, those whose groups have several members."""
        if not len(places):
            return places
        groups = rank[self.order[places]]
        same = np.flatnonzero(groups[1:] == groups[:-1])
        several = np.zeros(len(places), bool)
        several[same] = several[same + 1] = True
        return places[several]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from each i and j on (never the same place)."""
        return self._extent(i, j, forward=True)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends just before each i and j."""
        return self._extent(i, j, forward=False)

    def _extent(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        if not forward:
            i, j = i - 1, j - 1
        zero = self.levels[0]
        live = np.flatnonzero((np.minimum(i, j) >= 0) & (zero[i] == zero[j]))
        i, j, size = i[live], j[live], np.zeros(len(live), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            if forward:
                same = rank[i + size] == rank[j + size]
            else:
                a, b = i - size - step + 1, j - size - step + 1
                same = (np.minimum(a, b) >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            size[same] += step
        out[live] = size
        return out

    def common(self) -> np.ndarray:
        """The longest common prefix of each suffix and the one before it in the order."""
        out = np.zeros(len(self.order), np.int64)
        out[1:] = self.ahead(self.order[1:], self.order[:-1])
        return out


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch from there that also starts earlier in its text,
    and where.  Places that are neighbours in the order with a smaller one on either side are
    settled by a stack that keeps places rising."""
    longest, source = np.zeros((2, len(order)), np.int64)
    # only groups whose first word occurs again can have any
    near = common > 0
    near[:-1] |= near[1:]
    places = np.flatnonzero(near)
    found, origin = [0] * len(places), [0] * len(places)
    at, shared = order[places].tolist(), common[places].tolist()
    stack: list[tuple[int, int, int]] = []  # place, prefix shared with the entry below, index
    for index, (place, size) in enumerate(zip(at, shared, strict=True)):
        while stack and place < stack[-1][0]:
            _, below, which = stack.pop()
            # neighbours with a smaller place: the entry below, and this one
            if size >= below:
                found[which], origin[which] = size, place
            else:
                found[which], origin[which] = below, stack[-1][0]
            size = min(size, below)
        stack.append((place, size if stack else 0, index))
    while stack:
        _, below, which = stack.pop()
        if below:
            found[which], origin[which] = below, stack[-1][0]
    longest[order[places]], source[order[places]] = found, origin
    return longest, source


def blocks_of(longest: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks of all texts start; each text is closed by an empty block at its end."""
    starts, step = [], np.maximum(longest, 1).tolist()
    at = 0
    for end in first[1:].tolist():
        while at < end:
            starts.append(at)
            at += step[at]
        starts.append(end)
    return np.array(starts)


def runs_of(words: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Every run of length >= max(least, exponent * period): rows (start, end, period) in the order of
    start, then period.  ``exponent`` is 2 or more."""
    if len(words) < 2:
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(words, first)
    longest, source = previous_factors(suffixes.order, suffixes.common())
    edge = blocks_of(longest, first)
    length = np.diff(edge, append=edge[-1])
    # the block before an edge, none at a text's first; a text's last edge is the start of the next text too
    before = np.concatenate([[0], length[:-1]])
    found = _touching(suffixes, edge, np.maximum(length + before - 1, 0) // (exponent - 1), exponent, least)
    if len(found):
        found = _copied(found, edge, length, source, least)
    return found


def _touching(suffixes: Suffixes, edge: np.ndarray, periods: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Runs that touch an edge, by extension to both sides for each period up to the given one."""
    n = len(suffixes.order)
    at = np.repeat(edge, periods)
    period = np.arange(len(at)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    out = []
    for side in (1, -1):  # a period behind the edge, a period before it
        other = at + side * period
        ok = (other >= 0) & (other <= n) & (at <= n)
        i, j, p = at[ok], other[ok], period[ok]
        low, high = np.minimum(i, j), np.maximum(i, j)
        on, back = suffixes.ahead(low, high), suffixes.behind(low, high)
        good = on + back + p >= np.maximum(least, exponent * p)
        out.append(np.stack([low - back, high + on, p], axis=1)[good])
    found = np.concatenate(out)
    # multiples of a run's smallest period have the same bounds
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def _copied(found: np.ndarray, edge: np.ndarray, length: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """These runs and all that lie strictly inside a block, copied from where the block occurs before."""
    bucket: dict[int, set[tuple[int, int]]] = {}
    for s, e, p in found.tolist():
        bucket.setdefault(s, set()).add((e, p))
    filled = sorted(bucket)
    roomy = np.flatnonzero(length >= least + 2)
    for start, size in zip(edge[roomy].tolist(), length[roomy].tolist(), strict=True):
        origin = int(source[start])
        shift, at = start - origin, bisect_right(filled, origin)
        while at < len(filled) and filled[at] < origin + size:
            s = filled[at]
            inside = [(e + shift, p) for e, p in bucket[s] if e < origin + size]
            if inside:
                if s + shift not in bucket:
                    bucket[s + shift] = set()
                    insort(filled, s + shift)
                bucket[s + shift].update(inside)
            at += 1
    return np.array([(s, e, p) for s in filled for e, p in sorted(bucket[s], key=lambda x: x[1])], np.int64)


def rewritten(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a text with a planted repetition, for one text in ten, by the checksum of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return words[np.where(place >= a, a + (place - a) % p, place)]


Rewrite = Callable[[np.ndarray, int | None], np.ndarray]
COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _answer(runs: np.ndarray, words: list[bytes]) -> tuple[tuple, bytes]:
    """The columns of one text, and its words without those behind the first period of a run."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = words
    if len(runs):
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    collapsed = b" ".join(kept)
    size = runs[:, 1] - runs[:, 0]
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs.tolist())
    top: tuple = (None,) * 4
    if len(runs):
        i = np.lexsort((runs[:, 2], runs[:, 0], -size))[0]
        top = (int(runs[i, 0]), int(size[i]), int(runs[i, 2]), int(1000 * size[i] // runs[i, 2]))
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()), collapsed


def _batch(texts: list[bytes], ids: list, rewrite: Rewrite | None, exponent: int, least: int) -> Iterator[tuple[tuple, bytes]]:
    split = [t.split() for t in texts]  # at \x20 and \x09 to \x0D, as bytes
    flat = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
    numbers, spelled = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), None
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    if rewrite is not None:
        parts = [numbers[i:j] for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)]
        changed = [rewrite(p, i) for p, i in zip(parts, ids, strict=True)]
        for t, (old, new) in enumerate(zip(parts, changed, strict=True)):
            if new is not old:
                spelled = flat.dictionary.to_pylist() if spelled is None else spelled
                split[t] = [spelled[w] for w in new.tolist()]
        numbers = np.concatenate([*changed, np.zeros(0, np.int64)])
    runs = runs_of(numbers, first, exponent, least)
    cut = np.searchsorted(runs[:, 0], first)
    # a text's runs start before its end; those of empty texts are none
    for t, ws in enumerate(split):
        own = runs[cut[t] : cut[t + 1]].copy()
        own[:, :2] -= first[t]
        yield _answer(own, ws)


def find_runs(documents: DataFrame, rewrite: Rewrite | None = None, exponent: int = EXPONENT, least: int = LEAST, keep_text: bool = False) -> DataFrame:
    """doc_id, n_runs, the greatest run (start, length, period, exponent_milli; ties: smallest start,
    then period), runs_sha256, collapsed_sha256 and, with ``keep_text``, collapsed (the words kept).
    ``rewrite`` changes the word numbers of a text before runs are looked for."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = COLUMNS | ({"collapsed": pa.binary()} if keep_text else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("periodic")
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for i, j in slices(texts):
                rows = [(*answer, text) for answer, text in _batch(texts[i:j], ids[i:j], rewrite, exponent, least)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *cols], ["doc_id", *columns])

    spark_types = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"`{c}` {spark_types[k]}" for c, k in columns.items())
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")
