"""Substring dedup by level-wise doubling: words of passages that occur more than once.

A window is 35 consecutive words of one document.  Of the 9-word windows inside it the one with
the least hash is its anchor, so equal windows have equal anchors, and about one 9-word
window in fourteen is one.  Level 9 finds the anchors whose words occur again anywhere; level
18 extends those alone to twice the length, to the right and to the left (any 35 words around
an anchor hold one of the two); level 35, twice 18 cut to the window, takes the windows of
the anchors that are left.  At each level only repeated strings go on.  The last level
compares 128-bit fingerprints: two independent 64-bit hashes of each word (``run_hashes``), and of
their sequence.

Null and empty texts and texts of fewer than 35 words lose nothing.  Repeated rows are
documents of their own: each is a repeat of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.blocks import Block, Blocks, Keys, count_keys, marked_runs, owners
from weft.llm.common import ITEMS_A, ITEMS_B, SECOND, U64, Scratch, mix, word_hashes, words_of

WINDOW = 35


class Words:
    """The words of a block and the windows that are still candidates."""

    def __init__(self, block: Block, window: int):
        self.block, self.window = block, window
        self.short = -(-window // 4)  # 9, 18, 35
        self.data, self.starts, self.ends, self.first = words_of(block.texts)
        self.n = len(self.starts)
        self.a = word_hashes(self.data, self.starts, self.ends)
        self.sums = ITEMS_A.sums(self.a)
        grams = mix(ITEMS_A.grams(self.sums, self.short))
        self.owner = owners(grams, window - self.short + 1)
        start = np.arange(len(self.owner))
        self.text = np.searchsorted(self.first, start, side="right") - 1
        self.live = start + window <= self.first[np.minimum(self.text + 1, len(self.first) - 1)]
        self.anchors = np.unique(self.owner[self.live])
        self.grams = grams

    def keep(self, anchors: np.ndarray) -> None:
        ok = np.zeros(self.n + 1, bool)
        ok[anchors] = True
        self.live &= ok[self.owner]
        self.anchors = anchors

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the anchors' extensions to the right and, after these, to the left; and which
        anchor each belongs to.  An extension that leaves the text is left out."""
        text = np.searchsorted(self.first, self.anchors, side="right") - 1
        low, high = self.first[text], self.first[text + 1]
        right = np.flatnonzero(self.anchors + 2 * self.short <= high)
        left = np.flatnonzero((self.anchors - self.short >= low) & (self.anchors + self.short <= high))
        hashed = lambda s: mix(ITEMS_A.of(self.sums, s, s + 2 * self.short))
        keys = np.concatenate([hashed(self.anchors[right]), hashed(self.anchors[left] - self.short) ^ U64(0x5555555555555555)])
        return keys, np.concatenate([right, left])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.flatnonzero(self.live)
        b = ITEMS_B.sums(word_hashes(self.data, self.starts, self.ends, SECOND))
        return start, mix(ITEMS_A.of(self.sums, start, start + self.window)), mix(ITEMS_B.of(b, start, start + self.window))


def _anchors(w: Words, shards: int) -> Keys:
    return Keys(w.grams[w.anchors], None, shards)


def _second(w: Words, shards: int) -> tuple[Keys, np.ndarray]:
    keys, of = w.extended()
    return Keys(keys, None, shards), of


def _after_first(block: Block, window: int, shards: int) -> Words:
    w = Words(block, window)
    w.keep(w.anchors[_anchors(w, shards).repeated(block.told, "level1")])
    return w


def _after_second(block: Block, window: int, shards: int) -> Words:
    w = _after_first(block, window, shards)
    keys, of = _second(w, shards)
    w.keep(w.anchors[np.unique(of[keys.repeated(block.told, "level2")])])
    return w


def remove_repeats(documents: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept (its words joined)."""
    with Scratch(documents.sparkSession) as scratch:
        return _remove(documents, window, keep_text, scratch)


def _remove(documents: DataFrame, window: int, keep_text: bool, scratch: Scratch) -> DataFrame:
    blocks = Blocks(documents, scratch)
    shards = blocks.shards
    blocks.ask("level1", lambda block, n: _anchors(Words(block, window), n).messages(), count_keys)
    blocks.ask("level2", lambda block, n: _second(_after_first(block, window, n), n)[0].messages(), count_keys)
    blocks.ask("level3", lambda block, n: Keys(*_after_second(block, window, n).windows()[1:], n).messages(), count_keys)
    extra = ", kept binary" if keep_text else ""

    def finish(block: Block) -> Iterator[pa.RecordBatch]:
        w = _after_second(block, window, shards)
        start, a, b = w.windows()
        gone = marked_runs(w.n, start[Keys(a, b, shards).repeated(block.told, "level3")], window)
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = (total[w.first[1:]] - total[w.first[:-1]]).tolist()
        data, kept, first = w.data.tobytes(), [], w.first.tolist()
        for i, j in zip(first, first[1:], strict=False):
            stay = np.flatnonzero(~gone[i:j]) + i
            kept.append(b" ".join([data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]))
        out = {"doc_id": block.ids, "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    result = blocks.each(finish, f"doc_id {blocks.kind}, n_words bigint, n_removed bigint, kept_sha256 string{extra}")
    return scratch.write(result, "result", keep=True)
