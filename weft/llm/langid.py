"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (single bytes
included, so every word can be segmented).  The score of a word is the sum over all its
segmentations, found by a forward pass over its lattice; the score of a text is the sum over
its words, a word being a run of letters in lower case after a word-start mark, which no
piece crosses.  Piece probabilities come from expected counts over all segmentations (a few
rounds of forward and backward passes) of a bounded sample of labelled documents: about
``FIT_DOCS`` of each language, chosen by a hash of the doc_id.

A text that is null or has no letter is ``und`` with score 0.  If nothing can be learned (an
empty table, no labels), every text is ``und``.  Repeated rows give repeated results.  Texts,
words and pieces of any length count whole; of languages with equal scores the first in
alphabetical order is taken.  Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.bpe import parcels
from weft.llm.common import _RELEASES, U64, Rolling, begin, kept, mix
from weft.llm.runs import LONGEST, Memo, code_points, hashes

#: Documents of each language, in expectation, from which probabilities are learned.
FIT_DOCS = 300
ROUNDS = 3
SMOOTH = 0.05
#: Entries of a worker's memo of scored words.
MEMO = 1_500_000
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNKNOWN = "und"
_ROLL = Rolling(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Pieces:
    """The vocabulary as a table of hashes of byte strings; numbers 0 to 255 are the bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {bytes([b]) for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i).lower()
                if WORD.fullmatch(piece.removeprefix(MARK)) or piece == MARK:  # others never lie in a word
                    texts.add(piece.encode())
        self.texts = sorted(texts)
        self.size = len(self.texts)
        self.longest = max(map(len, self.texts))
        keys = np.zeros(self.size, np.uint64)
        for some, own in blocks(self.texts):
            keys[some] = self._lattice(own)[np.arange(len(own)), 0, [len(t) - 1 for t in own]]
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        assert len(np.unique(keys)) == len(keys)

    def _lattice(self, words: list[bytes]) -> np.ndarray:
        """Hashes of the substrings from each byte on, of each length."""
        n = max(map(len, words))
        data = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        _ROLL._reach(n + 1)
        sums = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(data * _ROLL.up[:n], axis=1, out=sums[:, 1:])
        most = min(n, self.longest)
        out = np.zeros((len(words), n, most), np.uint64)
        for size in range(1, most + 1):
            m = n - size + 1
            out[:, :m, size - 1] = mix((sums[:, size : size + m] - sums[:, :m]) * _ROLL.down[:m] + np.uint64(size))
        return out

    def lattice(self, words: list[bytes]) -> np.ndarray:
        """The number of the piece from each byte on, of each length; -1 where there is none."""
        keys = self._lattice(words)
        at = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
        found = np.where(self.keys[at] == keys, self.number[at], -1)
        size = np.array([len(w) for w in words])[:, None, None]
        i, k = np.arange(keys.shape[1])[None, :, None], np.arange(keys.shape[2])[None, None, :]
        return np.where(i + k + 1 <= size, found, -1)


def forward(grid: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the summed probability of all segmentations, for each word and language; and the
    scaled forward sums.  ``logs``: piece by language.  Scaled by 20 a byte against underflow."""
    n, width, most = grid.shape
    p = np.vstack([np.exp(logs), np.zeros((1, logs.shape[1]))])
    a = np.zeros((n, width + 1, logs.shape[1]))
    a[:, 0] = 1
    for j in range(1, width + 1):
        for k in range(1, min(j, most) + 1):
            number = grid[:, j - k, k - 1]
            if (number >= 0).any():
                a[:, j] += a[:, j - k] * p[number] * 20.0**k
    last = a[np.arange(n), sizes]
    return np.log(np.maximum(last, 1e-300)) - (sizes * math.log(20.0))[:, None], a


def forward_long(grid: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The same for one long word, by sums of logarithms."""
    _, width, most = grid.shape
    a = np.full((width + 1, logs.shape[1]), -np.inf)
    a[0] = 0
    for j in range(1, width + 1):
        for k in range(1, min(j, most) + 1):
            if (number := grid[0, j - k, k - 1]) >= 0:
                a[j] = np.logaddexp(a[j], a[j - k] + logs[number])
    return a[width]


def expected(grid: np.ndarray, sizes: np.ndarray, weights: np.ndarray, logs: np.ndarray, out: np.ndarray) -> None:
    """Adds expected piece counts of words of one language over all segmentations."""
    n, width, most = grid.shape
    p = np.append(np.exp(logs), 0.0)
    _, a = forward(grid, sizes, logs[:, None])
    a = a[:, :, 0]
    b = np.zeros((n, width + 1))
    b[np.arange(n), sizes] = 1
    for j in range(width - 1, -1, -1):
        for k in range(1, min(width - j, most) + 1):
            number = grid[:, j, k - 1]
            if (number >= 0).any():
                b[:, j] += b[:, j + k] * p[number] * 20.0**k
    scale = weights / np.maximum(b[:, 0], 1e-300)
    for j in range(width):
        for k in range(1, min(width - j, most) + 1):
            number = grid[:, j, k - 1]
            if (has := number >= 0).any():
                out += np.bincount(number[has], (a[:, j] * b[:, j + k] * p[number] * 20.0**k * scale)[has], len(out))


def expected_long(grid: np.ndarray, weight: float, logs: np.ndarray, out: np.ndarray) -> None:
    """The same for one long word, by sums of logarithms."""
    _, width, most = grid.shape
    a, b = np.full(width + 1, -np.inf), np.full(width + 1, -np.inf)
    a[0] = b[width] = 0
    steps = [(j, k, number) for j in range(width) for k in range(1, min(width - j, most) + 1) if (number := grid[0, j, k - 1]) >= 0]
    for j, k, number in steps:
        a[j + k] = np.logaddexp(a[j + k], a[j] + logs[number])
    for j, k, number in reversed(steps):
        b[j] = np.logaddexp(b[j], b[j + k] + logs[number])
    for j, k, number in steps:
        out[number] += weight * np.exp(a[j] + logs[number] + b[j + k] - a[width])


def spelled(word: str) -> bytes:
    return (MARK + word).encode()


#: Bytes of the longest word that is scored without logarithms of sums.
SHORT = 48


def blocks(words: list[bytes], most: int = 4000) -> Iterator[tuple[list[int], list[bytes]]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), most):
        some = order[at : at + most]
        yield some, [words[i] for i in some]


def train(pieces: Pieces, counts: dict[str, Counter]) -> tuple[list[str], np.ndarray]:
    """Languages and log piece probabilities (piece by language)."""
    langs, columns = sorted(counts), []
    for lang in langs:
        pairs = [(spelled(w), n) for w, n in counts[lang].items()]
        long = [(pieces.lattice([w]), n) for w, n in pairs if len(w) > SHORT]
        pairs = [(w, n) for w, n in pairs if len(w) <= SHORT]
        words, weights = [w for w, _ in pairs], np.array([n for _, n in pairs], float)
        grids = [(np.array(some), pieces.lattice(own), np.array(list(map(len, own)))) for some, own in blocks(words)]
        # at first, a piece is the likelier the longer it is
        logs = np.array([-2.0 - 6.0 / len(t) for t in pieces.texts])
        logs -= math.log(np.exp(logs).sum())
        for _ in range(ROUNDS):
            found = np.full(pieces.size, SMOOTH)
            for some, grid, sizes in grids:
                expected(grid, sizes, weights[some], logs, found)
            for grid, n in long:
                expected_long(grid, n, logs, found)
            logs = np.log(found / found.sum())
        columns.append(logs)
    return langs, np.stack(columns, axis=1) if columns else np.zeros((pieces.size, 0))


@kept
def letters() -> np.ndarray:
    """Which code points stand in words, and which of them are letters (2)."""
    every = [chr(c) for c in range(0x110000)]
    return np.array([(bool(WORD.match(c)) + c.isalpha()) if c.isalnum() else 0 for c in every], np.uint8)


class Scorer:
    """Scores words once; the memo of a worker is emptied when it is full."""

    def __init__(self, pieces: Pieces, langs: list[str], logs: np.ndarray):
        self.pieces, self.langs, self.logs = pieces, langs, logs
        self.memo, self.rows = Memo(), np.zeros((0, len(langs)))

    def learn(self, words: list[str]) -> np.ndarray:
        """log probabilities of words by language; no letter: zeros."""
        out = np.zeros((len(words), len(self.langs)))
        own = [i for i, w in enumerate(words) if any(map(str.isalpha, w))]
        spelt = [spelled(words[i]) for i in own]
        for some, batch in blocks(spelt):
            short = [i for i, w in zip(some, batch, strict=True) if len(w) <= SHORT]
            if short:
                few = [spelt[i] for i in short]
                out[[own[i] for i in short]] = forward(self.pieces.lattice(few), np.array(list(map(len, few))), self.logs)[0]
            for i in some:
                if len(spelt[i]) > SHORT:
                    out[own[i]] = forward_long(self.pieces.lattice([spelt[i]]), self.logs)
        return out

    def score_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        texts = [t or "" for t in texts]
        return [x for s, e in parcels(texts) for x in self.score(texts[s:e])]

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        x, bounds = code_points([(t or "").lower() for t in texts])
        kind = letters()[x]
        solid = np.zeros(len(x) + 1, bool)
        solid[:-1] = kind > 0
        begins, stops = solid.copy(), np.zeros(len(x) + 1, bool)
        begins[1:] &= ~solid[:-1]
        begins[bounds] |= solid[bounds]  # a word doesn't go over into the next text
        stops[1:] = solid[:-1] & ~solid[1:]
        stops[bounds[1:]] |= solid[np.maximum(bounds[1:] - 1, 0)] & (bounds[1:] > bounds[0])
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        a, b = hashes(x, starts, ends)
        number = self.memo.find(a, b)
        if len(missing := np.flatnonzero(number < 0)):
            if len(self.rows) > MEMO:
                self.memo.clear()
                self.rows, missing = self.rows[:0], np.arange(len(a))
            long = ends[missing] - starts[missing] > LONGEST
            _, one, back = np.unique(a[missing] + U64(3) * b[missing], return_index=True, return_inverse=True)
            one = np.concatenate([missing[one], missing[long]])
            data = x.tobytes()
            words = [data[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            own = np.arange(len(self.rows), len(self.rows) + len(one))
            self.rows = np.vstack([self.rows, self.learn(words)])
            n = len(one) - int(long.sum())
            short = ends[one[:n]] - starts[one[:n]] <= LONGEST  # a long word is scored each time
            self.memo.put(a[one[:n]][short], b[one[:n]][short], own[:n][short])
            number[missing] = own[:n][back]
            number[missing[long]] = own[n:]
        total = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.rows[number], axis=0)])
        edge = np.searchsorted(starts, bounds)
        total = total[edge[1:]] - total[edge[:-1]]
        has = np.concatenate([[0], np.cumsum(kind == 2)])
        has = has[bounds[1:]] > has[bounds[:-1]]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        best = np.argmax(total, axis=1)
        share = 1 / np.exp(np.maximum(total - total[np.arange(len(total)), best][:, None], -700)).sum(axis=1)
        return [(self.langs[k], s) if h else (UNKNOWN, 0.0) for k, s, h in zip(best.tolist(), share.tolist(), has.tolist(), strict=True)]


@kept
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


_SCORERS: dict = {}
_RELEASES.append(_SCORERS.clear)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit(documents: DataFrame, vocabulary: str, docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Learns from rows that are not held out and have text and lang."""
    known = documents.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train(pieces_of(vocabulary), {})
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(docs / n)) for lang, n in sizes.items()))
    some = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_in(text))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    rows = some.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    for r in rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return train(pieces_of(vocabulary), {k: Counter(dict(sorted(v.items()))) for k, v in counts.items()})


def scorer(shared, vocabulary: str) -> Scorer:
    """One scorer for each model in a worker."""
    if shared.id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[shared.id] = Scorer(pieces_of(vocabulary), *shared.value)
    return _SCORERS[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, f"{broadcast._jbroadcast.id()}-{id(broadcast)}"

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def value(self):
        return self.broadcast.value


def identify(documents: DataFrame, vocabulary: str, docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior under equal priors)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    # bounded: one number for each piece and language
    shared = _Shared(documents.sparkSession.sparkContext.broadcast(fit(documents, vocabulary, docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        own = scorer(shared, vocabulary)
        for batch in batches:
            got = own.score_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accept(documents: DataFrame, vocabulary: str, least: float = 0.5, docs: int = FIT_DOCS) -> DataFrame:
    """The rows, all columns as they are, whose text has a language with at least this score."""
    at = documents.columns.index("text")
    shared = _Shared(documents.sparkSession.sparkContext.broadcast(fit(documents, vocabulary, docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        own = scorer(shared, vocabulary)
        for batch in batches:
            got = own.score_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and p >= least for lang, p in got], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
