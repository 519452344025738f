"""Packing of documents into sequences of 2048 tokens by lexical retrieval.

All texts are encoded once and written with their ids.  Document frequencies of token ids are
counted over all documents (a vector as long as the vocabulary from each task).  The index is
sharded: a shard holds about ``SHARD`` tokens of documents that were written together, as an
inverted index of BM25 weights under the corpus-wide frequencies.  A seed document fills a
window; BM25 with its heaviest terms returns its neighbours in the shard, and the unused ones
fill the window in falling order of score; when one is too long, it is cut where the window
ends and what is left becomes the next seed.  Every window is full but a shard's last, which is
cut at powers of two, so nothing is padded.

A document is its ids and then the end id.  A null or empty text is the end id alone.  Repeated
rows are packed one by one.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.bpe import library_codec, parcels
from weft.llm.common import Scratch, begin

LENGTH, END = 2048, 1
#: Tokens of a shard, about; heaviest terms of a seed that are looked up; BM25's constants.
SHARD, TERMS, K1, B = 1 << 22, 24, 1.2, 0.75


def tokenized(documents: DataFrame, ranks: str, vocabulary: int, end: int = END) -> DataFrame:
    """doc_id, n (tokens with the end), ids (packed little-endian 16- or 32-bit)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        codec = library_codec(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for s, e in parcels(texts):
                ids, counts = codec.encode_batch(texts[s:e])
                at = np.cumsum(counts)
                ids = np.insert(ids.astype(width), at, end)
                stops = at + np.arange(1, len(at) + 1)
                data, size = ids.tobytes(), ids.itemsize
                edges = [0, *(stops * size).tolist()]
                own = [data[i:j] for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array(counts + 1, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, ids binary")


def frequencies(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, documents, tokens."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing_index")
        df, docs, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                x = np.frombuffer(ids, width)
                df[np.unique(x)] += 1
                docs, total = docs + 1, total + len(x)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], term]), pa.int32()), pa.array(np.concatenate([[docs, total], df[term]]), pa.int64())], ["term", "n"])

    out, docs, total = np.zeros(vocabulary, np.int64), 0, 0
    for r in tokens.select("ids").mapInArrow(part, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] >= 0:
            out[r["term"]] = r["n"]
        elif r["term"] == -1:
            docs = r["n"]
        else:
            total = r["n"]
    return out, docs, total


class Shard:
    """An inverted index of some documents, and the windows they fill."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.sizes = np.array([len(d) for d in docs])
        terms, owner, weight = [], [], []
        for i, ids in enumerate(docs):
            term, tf = np.unique(ids, return_counts=True)
            terms.append(term.astype(np.int64))
            owner.append(np.full(len(term), i, np.int32))
            weight.append(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.top = []
        for term, w in zip(terms, weight, strict=True):
            self.top.append(term[np.argsort(-w, kind="stable")[:TERMS]])
        flat, owner, weight = np.concatenate(terms), np.concatenate(owner), np.concatenate(weight)
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.name, self.first = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.first[1:], len(flat))

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, the best first."""
        at = np.searchsorted(self.name, self.top[seed])
        own = [slice(self.first[k], self.stop[k]) for k in at.tolist()]
        score = np.bincount(np.concatenate([self.owner[s] for s in own]), np.concatenate([self.weight[s] for s in own]), len(used))
        score[used] = 0
        left = np.flatnonzero(score > 0)
        yield from left[np.argsort(-score[left], kind="stable")].tolist()

    def windows(self, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, start, tokens); all are full but the last."""
        used = np.zeros(len(self.sizes), bool)
        cursor, seed, start = 0, -1, 0
        while True:
            if seed < 0:
                while cursor < len(used) and used[cursor]:
                    cursor += 1
                if cursor == len(used):
                    return
                seed, start = cursor, 0
                used[seed] = True
            window, room = [], length
            take = min(room, int(self.sizes[seed]) - start)
            window.append((seed, start, take))
            room -= take
            own, rest = seed, (seed, start + take) if start + take < self.sizes[seed] else None
            if room:
                for k in self._fill(own, used):
                    used[k] = True
                    take = min(room, int(self.sizes[k]))
                    window.append((k, 0, take))
                    room -= take
                    if take < self.sizes[k]:
                        rest = (k, take)
                    if not room:
                        break
            yield window
            seed, start = rest if rest else (-1, 0)

    def _fill(self, seed: int, used: np.ndarray) -> Iterator[int]:
        for k in self.neighbours(seed, used):
            if not used[k]:
                yield k
        for k in np.flatnonzero(~used).tolist():  # no document left shares a term
            yield k


def pieces_of(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of a shard."""
    sequence = 0
    for window in Shard(docs, idf, mean).windows(length):
        total = sum(n for _, _, n in window)
        ends = [1 << k for k in range(length.bit_length(), -1, -1) if total & 1 << k] if total < length else [total]
        offset, left = 0, list(ends)
        for doc, start, n in window:
            while n:
                take = min(n, left[0] - offset)
                yield doc, start, take, sequence, offset
                start, n, offset = start + take, n - take, offset + take
                if offset == left[0]:
                    left.pop(0)
                    offset, sequence = 0, sequence + 1


def pack_documents(documents: DataFrame, ranks: str, vocabulary: int = 50_257, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``keep_ids`` the piece's ids (unsigned 32-bit, packed)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(documents.sparkSession)
    tokens = scratch.write(tokenized(documents, ranks, vocabulary, end), "tokens", keep=True)
    df, n_docs, n_tokens = frequencies(tokens, vocabulary)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    mean = n_tokens / max(1, n_docs)
    shared = documents.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing_index")
        from pyspark import TaskContext

        base, ids, docs, size = TaskContext.get().partitionId() << 36, [], [], 0
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal base
            rows, last = [], -1
            for doc, start, n, sequence, offset in pieces_of(docs, shared.value, mean, length):
                own = docs[doc][start : start + n].astype("<u4").tobytes()
                rows.append((ids[doc], start, n, zlib.crc32(own), len(docs[doc]), base + sequence, offset, own))
                last = sequence
            base += last + 1
            cols = list(zip(*rows, strict=True))
            kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False)], names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(x, width))
                size += len(docs[-1])
                if size >= SHARD:
                    yield flush()
                    ids, docs, size = [], [], 0
        if docs:
            yield flush()

    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return tokens.select("doc_id", "ids").mapInArrow(run, fields + ", ids binary" * keep_ids)
