"""A quality classifier: regularised quadratic discriminant over statistics of documents.

Each text gives a vector of transformed statistics (logarithms of counts and of shares).  Of
each class the mean and a covariance are estimated from sums over all labelled rows that are
not held out; the covariance is shrunk towards the diagonal of the pooled one.  The score is
the posterior of label 1 from the difference of the two Gaussian log densities, whose
Mahalanobis terms use the classes' Cholesky factors, factored once and sent to the workers.

Null and empty texts are scored like any other (all counts zero).  Labels that are null or
belong to no document are not used; of several labels of one document the largest counts.  If
a class has no labelled row, every score is the share of label 1 (0.5 without labels).  A score
equal to the threshold is predicted 1; repeated rows are scored alike; texts of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.common import Scratch
from weft.llm.langid import held_out

#: Shrinkage towards the pooled diagonal, and what is added to it.
SHRINK, RIDGE = 0.1, 1e-3
THRESHOLD = 0.3
_UPPER, _LOWER, _DIGIT, _MARK, _ODD = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_MARK[list(b".,;:?'\"()-")] = True
_ODD[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
EDGE = re.compile(r"[^\w\s]{2,}(?=\s|$)")
FEATURES = 14


def statistics(text: str) -> list[float]:
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data) + 1.0
    words = text.split()
    n = len(words) + 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    shouted = sum(map(str.isupper, words))
    letters = float(counts[_UPPER | _LOWER].sum() + counts[128:].sum()) + 1.0
    same = sum(map(str.__eq__, words, words[1:]))
    log = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log(size)),
        float(np.log(n)),
        float(np.log(size / n)),
        log(counts[_UPPER].sum() / letters),
        log(shouted / n),
        log(counts[_DIGIT].sum() / size),
        log(counts[_MARK].sum() / n),
        log(counts[_ODD].sum() / n),
        log(counts[ord("|")] / n),
        log(len(EDGE.findall(text)) / n),
        log(same / n),
        float(np.log((len(set(words)) + 1.0) / n) / np.log(n + 1.0)),
        log(1.0 - len(set(lines)) / max(1, len(lines))),
        log(len(lines) / n),
    ]


def features(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class: rows, sum of vectors, sum of their products.  Each task sends one row of a
    fixed length for each class and cell; only class by cell totals come to the driver."""
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, FEATURES)
            y = np.asarray(batch.column("y").to_pylist())
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in total:
                total[c] += x[y == c].T @ x[y == c]
        for c, s in total.items():
            if s[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(s.ravel())], ["y", "cell", "s"])

    rows = labelled.select("x", "y").mapInArrow(part, "y int, cell int, s double").groupBy("y", "cell").agg(F.sum("s").alias("s")).collect()
    out = {c: np.zeros(d * d) for c in (0, 1)}
    for r in rows:
        out[r["y"]][r["cell"]] = r["s"]
    return {c: (s[0], s.reshape(d, d)[0, 1:], s.reshape(d, d)[1:, 1:]) for c, s in out.items()}


class Discriminant:
    def __init__(self, stats: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {c: s[0] for c, s in stats.items()}
        self.share = (n[1] + 1.0) / (n[0] + n[1] + 2.0)
        self.plain = min(n.values()) < 2
        if self.plain:
            return
        mean = {c: s[1] / s[0] for c, s in stats.items()}
        cov = {c: stats[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in stats}
        pooled = sum(cov[c] * n[c] for c in stats) / sum(n.values())
        target = np.diag(np.diag(pooled)) + RIDGE * np.eye(FEATURES)
        self.parts = {}
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - SHRINK) * cov[c] + SHRINK * target)
            self.parts[c] = (mean[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[c] / sum(n.values())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(x), self.share)
        density = {}
        for c, (mean, solve, logdet, prior) in self.parts.items():
            z = (x - mean) @ solve.T
            density[c] = prior - 0.5 * ((z * z).sum(axis=1) + logdet)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(features(documents), "features", keep=True)
    own = labels.select("doc_id", F.col("quality").alias("y")).where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    known = rows.where(~held_out()).join(own.hint("merge"), "doc_id")
    model = Discriminant(sums(known))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(np.array(batch.column("x").to_pylist(), float).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
