"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens.  Tier one: a minimal perfect hash over the vocabulary resolves a
pre-token that is itself in the vocabulary.  Tier two: all others are merged by a heap of
candidate pairs over the linked list of their bytes, lowest rank first and leftmost among
equals.  Every worker keeps the ids of pre-tokens it has resolved; that memo is emptied when
it reaches ``MEMO`` entries, so memory is bounded and results do not depend on it.

Null and empty texts have no ids and decode to no bytes.  Repeated rows give repeated results.  An
empty table gives an empty result, columns other than doc_id and text are not read, and texts and
pre-tokens of any length are treated alike (those over ``LONGEST`` characters are not remembered).
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import begin, kept
from weft.llm.runs import LONGEST, Memo, code_points, hashes

#: Entries of the memo of resolved pre-tokens in one worker.
MEMO = 1_500_000
#: Code points with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_WHITE, _LETTER, _NUMBER, _OTHER = range(4)


@kept
def classes() -> np.ndarray:
    """The class of each code point that the pattern of ``public_tokenizers`` tells apart."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for prop, kind in (("L", _LETTER), ("N", _NUMBER)):
        for m in regex.finditer(rf"\p{{{prop}}}+", every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[list(map(ord, WHITE))] = _WHITE
    return out


def pre_token_starts(x: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the matches of ``public_tokenizers.PATTERN`` start in texts laid end to end.

    ``texts`` has the start of each text and the end.  The matches leave no gap.  A run of one
    class is a match; one blank before it belongs to it; white space before that is a match of
    its own; and an apostrophe that starts a match takes the ending of a contraction with it.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[x]
    first = np.zeros(n + 1, bool)
    first[texts] = True
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    # the last white character before something else in the same text
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    begins[last] = True
    begins[last[x[last] == 0x20] + 1] = False
    # contractions
    at = np.flatnonzero(begins & (x == 0x27) & (np.arange(n) + 1 < n) & ~first[1:])
    if len(at):
        pad = np.concatenate([x, np.zeros(2, x.dtype)])
        one, two = pad[at + 1], pad[at + 2]
        same = ~first[np.minimum(at + 2, n)]
        double = same & np.isin(one.astype(np.int64) << 8 | np.minimum(two, 0xFF), [ord(p[0]) << 8 | ord(p[1]) for p in ("re", "ve", "ll")])
        single = ~double & np.isin(one, list(map(ord, "stmd")))
        begins[at[single | double] + 1] = False
        end = np.concatenate([at[single] + 2, at[double] + 3])
        begins[end[end < n]] = True
    return np.flatnonzero(begins)


class PerfectHash:
    """A minimal perfect hash of byte strings: keys are dealt to buckets by one hash; each bucket
    has a seed under which its keys fall on free slots, the largest buckets being placed first."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = n // 2 + 1
        marks = [self._mark(k) for k in keys]
        dealt: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, m in enumerate(marks):
            dealt[m % self.buckets].append(i)
        #: A bucket's seed; for a bucket of one key, minus its slot, less one.
        self.seeds = [0] * self.buckets
        self.slot_key: list[int] = [-1] * n
        free = self.slot_key
        order = sorted((b for b in range(self.buckets) if dealt[b]), key=lambda b: -len(dealt[b]))
        alone = [b for b in order if len(dealt[b]) == 1]
        for b in order[: len(order) - len(alone)]:
            own, seed = [marks[i] for i in dealt[b]], 0
            while True:
                at = [self._slot(m, seed) for m in own]
                if all(free[s] < 0 for s in at) and len({*at}) == len(at):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(dealt[b], at, strict=True):
                free[s] = i
        left = (s for s in range(n) if free[s] < 0)
        for b, s in zip(alone, list(left), strict=False):
            self.seeds[b], free[s] = -s - 1, dealt[b][0]

    def _slot(self, mark: int, seed: int) -> int:
        x = (mark ^ seed * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) % self.n

    @staticmethod
    def _mark(key: bytes) -> int:
        return hash(key) & 0xFFFFFFFFFFFFFFFF  # it differs between processes; each builds its own table

    def find(self, key: bytes) -> int:
        """The number of the only key that can equal this one."""
        mark = self._mark(key)
        seed = self.seeds[mark % self.buckets]
        return self.slot_key[-seed - 1 if seed < 0 else self._slot(mark, seed)]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, lookup: bool = True):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.keys = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.hash = PerfectHash(self.keys if lookup else [])
        size = max(self.ids) + 1
        parts: list[bytes] = [b""] * size
        for k, i in self.ranks.items():
            parts[i] = k
        self.part_sizes = np.array([len(p) for p in parts], np.int64)
        self.part_first = np.cumsum(self.part_sizes) - self.part_sizes
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: The rank of each pair of vocabulary entries that merge.
        self.pairs = {
            self.ranks[k[:c]] << 32 | self.ranks[k[c:]]: i
            for k, i in self.ranks.items()
            for c in range(1, len(k))
            if k[:c] in self.ranks and k[c:] in self.ranks
        }
        self.memo = Memo()
        self._forget()

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a piece that is in the vocabulary."""
        key = self.hash.find(piece)
        return self.ids[key] if key >= 0 and self.keys[key] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merges over linked bytes.  A heap entry is rank * length + position."""
        get, n = self.pairs.get, len(piece)
        part = [self.single[b] for b in piece]
        due = [get(p << 32 | q, -1) for p, q in zip(part, part[1:], strict=False)]  # rank of the pair from here on
        heap = [r * n + i for i, r in enumerate(due) if r >= 0]
        heapq.heapify(heap)
        due.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            if due[i] != rank:  # a side was merged away or has grown
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], due[j], r = rank, -1, -1, -1
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | part[k], -1)) >= 0:
                    heapq.heappush(heap, r * n + i)
            due[i] = r
            if (h := before[i]) >= 0:
                r = due[h] = get(part[h] << 32 | rank, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + h)
        return [p for p in part if p >= 0]

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.whole(piece)
        return [whole] if whole is not None else self.merged(piece)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        x, bounds = code_points(texts)
        starts = pre_token_starts(x, bounds)
        ends = np.append(starts[1:], len(x))
        a, b = hashes(x, starts, ends)
        number = self.memo.find(a, b)
        if len(missing := np.flatnonzero(number < 0)):
            if len(self.pool) > MEMO:
                self._forget()
                number[:] = self.memo.find(a, b)
                missing = np.arange(len(a))
            long = ends[missing] - starts[missing] > LONGEST
            order = np.lexsort((b[missing], a[missing]))
            p, q = a[missing][order], b[missing][order]
            fresh = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            back = np.empty(len(order), np.int64)
            back[order] = np.cumsum(fresh) - 1
            one = np.concatenate([missing[order[fresh]], missing[long]])
            data = x.tobytes()
            pieces = [data[4 * s : 4 * e].decode("utf-32-le", "surrogatepass").encode() for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            own = np.arange(len(self.pool), len(self.pool) + len(one))
            self.pool += [array.array("I", self.piece_ids(p)) for p in pieces]
            n = len(one) - int(long.sum())
            number[missing] = own[:n][back]
            number[missing[long]] = own[n:]
            kept = ends[one[:n]] - starts[one[:n]] <= LONGEST
            self.memo.put(a[one[:n]][kept], b[one[:n]][kept], own[:n][kept])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, self.pool[own[0] :]), np.int64, len(one))])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(self.pool[own[0] :]), np.uint32)])
            self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        sizes = self.sizes[number]
        ids = self.flat[ranges(self.first[number], sizes)]
        text_of = np.searchsorted(starts, bounds)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[text_of])

    def _forget(self) -> None:
        self.memo.clear()
        self.pool = []
        self.sizes, self.first, self.flat = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        sizes = self.part_sizes[ids]
        data = self.part_bytes[ranges(self.part_first[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[s:e] for s, e in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_batch(np.asarray(ids, np.uint32), np.array([len(ids)]))[0]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class LibraryCodec(Codec):
    """The ids of ``tokenizers`` with misses resolved by tiktoken's own merges over the same ranks.

    If a JSON file of the same name lies beside the rank file, texts are cut at its added tokens,
    the leftmost first and the longest among equals, and these have their own ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__(path, lookup=False)
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.added: dict[str, int] = {}
        if os.path.exists(beside := os.path.splitext(path)[0] + ".json"):
            with open(beside, encoding="utf-8") as f:
                own = json.load(f)
            for token in own.get("added_tokens", []):
                if own.get("normalizer") or token["lstrip"] or token["rstrip"] or token["single_word"]:
                    raise ValueError(f"added token {token['content']!r} of {beside} is not matched as it stands")
                self.added[token["content"]] = token["id"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def piece_ids(self, piece: bytes) -> list[int]:
        return self.library._encode_single_piece(piece)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(token in t for token in self.added for t in texts):
            return super().encode_batch(texts)
        parts = [self.cut.split(t) for t in texts]  # text, token, text, ..., text
        ids, counts = super().encode_batch([p for own in parts for p in own[::2]])
        tokens = [len(own) // 2 for own in parts]
        last = np.cumsum(np.array(tokens) + 1) - 1  # the last part of each text: no token after it
        ends = np.cumsum(counts)
        ids = np.insert(ids, np.delete(ends, last), [self.added[p] for own in parts for p in own[1::2]])
        return ids, np.diff(ends[last], prepend=0) + tokens


@kept
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def parcels(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(documents: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes its ids again.  Columns: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and with ``keep_ids`` also ids (packed) and decoded (bytes)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    fields += ", ids binary, decoded binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        own = codec(vocabulary)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in parcels(texts):
                ids, counts = own.encode_batch(texts[start:end])
                back = own.decode_batch(ids, counts)
                at = np.concatenate([[0], 4 * np.cumsum(counts)]).tolist()
                packed = ids.astype("<u4", copy=False).tobytes()
                packed = [packed[s:e] for s, e in zip(at, at[1:], strict=False)]
                out["n_tokens"] += counts.tolist()
                out["ids_sha256"] += [hashlib.sha256(p).hexdigest() for p in packed]
                out["decoded_sha256"] += [hashlib.sha256(p).hexdigest() for p in back]
                if keep_ids:
                    out["ids"] += packed
                    out["decoded"] += back
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.binary(), "decoded": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], kinds[k]) for k in names)], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, fields)
