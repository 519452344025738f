"""Personal data: fixed patterns, and spans that labelers agree on by weak supervision.

The base patterns find addresses of mail and of hosts, card numbers and international phone
numbers.  Beyond them, broad patterns propose candidates: names, numbers, dates, postal
addresses, accounts and spelled-out mail addresses.  Labelers vote on each candidate, for it,
against it or not at all: its strict form, its checksum, a gazetteer, the words before it that speak for
or against, its edges, its company and the variety of its digits.  Expectation-maximisation over the
votes of all candidates of the corpus estimates how reliable each labeler is for each
kind; base spans count as personal.  A logistic regression is then trained on the candidates' features
with the estimated probabilities as labels, and decides: a candidate that at least one
labeler votes for and whose score reaches ``THRESHOLD`` is added, unless it overlaps a base span; of added spans
that overlap, the one with the highest score stays, then the first, then the longest.

Each text is read once.  What goes on is one row for each document without its text; the model sees counts
of vote patterns (at most kinds * 3 ** labelers) and sums of fixed size over all candidates.

Null and empty texts have no spans.  Repeated rows give repeated results and count
repeatedly.  An empty table gives an empty result, a table without candidates only base spans.  A null
doc_id is carried along; columns other than doc_id and text are not read.  Texts of any length are
scanned whole, in time proportional to their length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.common import Scratch, begin

BASE = ("email", "ip", "card", "phone")
ADDED = ("person", "number", "date", "address", "account", "mail")
KINDS = BASE + ADDED
THRESHOLD = 0.9

#: The base patterns.  A digit run is tried from its first digit only: where that fails, its other digits fail too.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Broad patterns that propose candidates.
PERSON = re.compile(r"(?<![\w'-])[A-Z][^\W\d_]+(?:\x20(?:[A-Z]\.|[A-Z][^\W\d_]+(?:-[A-Z][^\W\d_]+)?)){1,3}")
DIGITS = re.compile(r"\(?[0-9][0-9().\x20/-]*[0-9]")
ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][^\W\d_]+\x20){1,3}[A-Z][^\W\d_]+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]+)+")
DATE = re.compile(r"(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))")
#: Strict forms of numbers.
GROUPED = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")

#: Gazetteers.
GIVEN = frozenset(
    """alice andrew anna anne antonio barbara carlos carmen charles christine claire daniel david elena elizabeth emily emma
    fatima francois frank george hannah hans helen ines isabel james jane javier jean jennifer john jose joseph juan julia karl
    katherine klaus laura lucia luis marc maria marie mark martin mary michael miguel mohammed nicolas nina olga omar patricia
    paul pedro peter pierre rachel richard robert sarah sofia sophie stefan susan thomas ursula victoria walter william wolfgang""".split()
)
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mme senor senora señor señora don doña".split())
STREETS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd court ct place square way terrace straße strasse platz rue calle plaza".split())
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us ca".split())

#: Words before a candidate that speak for it, by kind, and words that speak against numbers.
FOR = {
    "person": r"\b(?:name(?: is)?|named|called|signed(?: by)?|sincerely|regards|contact|patient|employee|author|mr|mrs|ms|dr|herr|frau|heiße|llamo|nombre|nom|appelle)\b",
    "number": r"\b(?:phone|tel|telephone|telefon|teléfono|téléphone|mobile|cell|fax|call|ssn|social security(?: number| no)?|passport|reisepass|pasaporte|passeport|national id|id number|whatsapp)\b",
    "date": r"\b(?:born|birth|birthday|dob|d\.o\.b|geboren|geburtsdatum|née|né|nacido|nacida|nacimiento|naissance)\b",
    "address": r"\b(?:address|lives|live|living|resides|residing|home|house|adresse|anschrift|wohnt|dirección|habite|vive)\b",
    "account": r"\b(?:iban|account|konto|cuenta|compte|bank)\b",
    "mail": r"\b(?:e-?mail|mail|write|reach|contact|courriel|correo)\b",
}
FOR_ANY = {kind: re.compile(words + r"[^\w]*(?:\w+[^\w]+){0,2}$", re.I) for kind, words in FOR.items()}
AGAINST = re.compile(r"(?:\b(?:version|release|order|invoice|isbn|issn|page|pages|section|chapter|figure|table|total|price|usd|eur|article|serial|part|build|rev|no|nr|university of|institute of|city of|republic of)\b|[$€£#=])[^\w]*$", re.I)

SHAPE, CHECK, GAZETTEER, CONTEXT, COUNTER, EDGE, COMPANY, VARIETY = range(8)
LABELERS = 8
#: Code points before a candidate that context labelers look at, and how near company is.
BEFORE, NEAR = 48, 120


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the mail pattern: from each @ back over what may stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, by start, then kind."""
    found = [Span(s, 0, e) for s, e in _mails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            found.append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


def _date(part: str) -> bool | None:
    """Whether a date-like part is a day of the calendar; None if it does not look like one."""
    m = DATE.fullmatch(part)
    if not m:
        return None
    year, one, two = (int(m[i]) for i in ((1, 3, 4) if m[1] else (8, 5, 7)))
    for month, day in ((one, two),) if m[1] else ((one, two), (two, one)):
        try:
            datetime.date(year, month, day)
        except ValueError:
            continue
        return 1900 <= year <= 2035
    return False


def proposed(text: str) -> list[Span]:
    """Candidates beyond the base patterns, whatever the labelers may say."""
    kind = KINDS.index
    found = [Span(m.start(), kind("person"), m.end()) for m in PERSON.finditer(text)]
    for m in DIGITS.finditer(text):
        part = m[0]
        digits = sum(map(str.isdigit, part))
        if _date(part) is not None:
            found.append(Span(m.start(), kind("date"), m.end()))
        elif 7 <= digits <= 19:
            found.append(Span(m.start(), kind("number"), m.end()))
    found += [Span(m.start(), kind("address"), m.end()) for m in ADDRESS.finditer(text)]
    found += [Span(m.start(), kind("account"), m.end()) for m in ACCOUNT.finditer(text)]
    low = text.lower() if "dot" in text or "DOT" in text else ""
    if "dot" in low and ("(at)" in low or "[at]" in low or " at " in low):
        found += [Span(m.start(), kind("mail"), m.end()) for m in MAIL.finditer(text)]
    return sorted(found)


def _iban(part: str) -> bool:
    plain = part.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _votes(text: str, span: Span, others: list[int]) -> tuple[int, ...]:
    """A vote of each labeler: 1, -1 or 0."""
    start, k, end = span
    kind, part = KINDS[k], text[start:end]
    digits = "".join(c for c in part if "0" <= c <= "9")
    before = text[max(0, start - BEFORE) : start].rpartition("\n")[2]
    words = [w.strip(".'").lower() for w in part.split(" ")]
    votes = [0] * LABELERS
    if kind == "number":
        votes[SHAPE] = 1 if GROUPED.fullmatch(part) else -1
        votes[CHECK] = -1 if len(digits) >= 12 and not luhn(digits) else 0
    elif kind == "date":
        votes[SHAPE] = votes[CHECK] = 1 if _date(part) else -1
    elif kind == "account":
        votes[CHECK] = 1 if _iban(part) else -1
        votes[SHAPE] = 1 if 15 <= len(part.replace(" ", "")) <= 34 else -1
    elif kind == "person":
        last = re.search(r"(\w+)\.?\s*$", before)
        titled = words[0] in TITLES or bool(last and last[1].lower() in TITLES)
        votes[GAZETTEER] = 1 if titled or words[0] in GIVEN else -1
        votes[SHAPE] = -1 if len(words) > 3 or part.isupper() or len(set(words)) < len(words) else 0
    elif kind == "address":
        votes[GAZETTEER] = 1 if words[-1] in STREETS or any(w.endswith(("straße", "strasse")) for w in words) else -1
    elif kind == "mail":
        votes[GAZETTEER] = 1 if words[-1].rpartition(")")[2].rpartition("]")[2] in ENDINGS else -1
        votes[SHAPE] = 1 if "(" in part or "[" in part else 0
    else:
        votes[SHAPE] = 1
        votes[CHECK] = 1 if kind == "card" else 0
    if kind in FOR_ANY and FOR_ANY[kind].search(before):
        votes[CONTEXT] = 1
    if AGAINST.search(before):
        votes[COUNTER] = -1
    if (start and (text[start - 1].isalnum() or text[start - 1] in "_.,-/")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
        votes[EDGE] = -1
    if any(-NEAR <= start - x <= NEAR for x in others):
        votes[COMPANY] = 1
    if digits and len(set(digits)) <= 2:
        votes[VARIETY] = -1
    return tuple(votes)


#: A candidate's features in one number: 4 bits of kind, 2 bits of each vote, 3 bits of length, 3 flags.
LENGTHS = (8, 11, 14, 18, 24, 36, 60)
FEATURES = 1 + len(KINDS) + 2 * LABELERS + len(LENGTHS) + 3


def _packed(text: str, span: Span, votes: tuple[int, ...]) -> int:
    start, kind, end = span
    bits = kind
    for i, vote in enumerate(votes):
        bits |= (vote % 3) << (4 + 2 * i)
    at = 4 + 2 * LABELERS
    bits |= sum(end - start > x for x in LENGTHS) << at
    part = text[start:end]
    line = start == 0 or text[start - 1] == "\n"
    bits |= (("-" in part) | (" " in part) << 1 | line << 2) << (at + 3)
    return bits


def _kind_votes(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    votes = (packed[:, None] >> (4 + 2 * np.arange(LABELERS))) & 3
    return packed & 15, votes


def matrix(packed: np.ndarray) -> np.ndarray:
    """The features of candidates, one row each."""
    packed = np.asarray(packed, np.int64)
    kind, votes = _kind_votes(packed)
    at = 4 + 2 * LABELERS
    length = (packed >> at) & 7
    flags = (packed[:, None] >> (at + 3 + np.arange(3))) & 1
    columns = [np.ones((len(packed), 1)), kind[:, None] == np.arange(len(KINDS)), votes == 1, votes == 2, length[:, None] > np.arange(len(LENGTHS)), flags]
    return np.concatenate(columns, axis=1).astype(float)


class Reliability(NamedTuple):
    """What expectation-maximisation found: by kind the share of personal candidates, and by kind, truth
    and labeler the probabilities of each vote (none, for, against)."""

    share: np.ndarray
    vote: np.ndarray

    def posterior(self, packed: np.ndarray) -> np.ndarray:
        kind, votes = _kind_votes(np.asarray(packed, np.int64))
        log = np.log(self.vote[kind])  # candidates, truths, labelers, votes
        each = np.take_along_axis(log, votes[:, None, :, None], axis=3)[..., 0].sum(axis=2)
        odds = each[:, 1] - each[:, 0] + np.log(self.share[kind]) - np.log1p(-self.share[kind])
        return np.where(kind < len(BASE), 1.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))


#: Prior votes (none, for, against) of a labeler on what is not and on what is personal, and their weight.
PRIOR, WEIGHT = np.array([[0.55, 0.1, 0.35], [0.55, 0.35, 0.1]]), 20.0
ROUNDS = 60


def reliabilities(packed: np.ndarray, counts: np.ndarray) -> Reliability:
    """Expectation-maximisation over patterns of votes and how many candidates have each.  A kind's own
    votes are drawn towards those of all kinds, and these towards ``PRIOR``, so that labelers keep their sense."""
    packed, counts = np.asarray(packed, np.int64), np.asarray(counts, float)
    kind, votes = _kind_votes(packed)
    seen = np.eye(3)[votes]  # patterns, labelers, votes
    prior = np.broadcast_to(PRIOR[:, None, :], (2, LABELERS, 3))
    now = Reliability(np.full(len(KINDS), 0.3), np.broadcast_to(prior, (len(KINDS), 2, LABELERS, 3)))
    for _ in range(ROUNDS):
        personal = now.posterior(packed)
        weight = np.stack([1 - personal, personal]) * counts
        shared = np.einsum("tp,plv->tlv", weight, seen) + WEIGHT * prior
        shared /= shared.sum(axis=2, keepdims=True)
        vote, share = np.empty((len(KINDS), 2, LABELERS, 3)), np.empty(len(KINDS))
        for k in range(len(KINDS)):
            own = kind == k
            sums = np.einsum("tp,plv->tlv", weight[:, own], seen[own]) + WEIGHT * shared
            vote[k] = sums / sums.sum(axis=2, keepdims=True)
            share[k] = (weight[1, own].sum() + 3) / (weight[:, own].sum() + 10)
        now = Reliability(share, vote)
    return now


STEPS, RIDGE = 8, 1.0


def fit(candidates: DataFrame, scratch: Scratch) -> tuple[Reliability, np.ndarray] | None:
    """Reliabilities and the weights of the span classifier, from all candidates (column packed);
    None if there are none."""
    low = (1 << (4 + 2 * LABELERS)) - 1
    # by the number of kinds and labelers at most kinds * 3 ** labelers rows
    patterns = candidates.groupBy(F.col("packed").bitwiseAND(F.lit(low)).alias("votes")).count().collect()
    if not patterns:
        return None
    model = reliabilities(np.array([r.votes for r in patterns]), np.array([r["count"] for r in patterns]))
    counted = scratch.write(candidates.groupBy("packed").count(), "patterns")
    weights = np.zeros(FEATURES)
    for _ in range(STEPS):
        gradient, curvature = _sums(counted, model, weights)
        step = np.linalg.solve(curvature + RIDGE * np.eye(FEATURES), gradient - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return model, np.round(weights, 6)


def _sums(counted: DataFrame, model: Reliability, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the curvature of the likelihood, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES * (FEATURES + 1))
        for batch in batches:
            packed, n = batch.column("packed").to_numpy(), batch.column("count").to_numpy()
            x = matrix(packed)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
            total[:FEATURES] += x.T @ (n * (model.posterior(packed) - p))
            total[FEATURES:] += (x.T @ (x * (n * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    rows = counted.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(FEATURES * (FEATURES + 1))
    for r in rows:
        total[r.place] = r.value
    return total[:FEATURES], total[FEATURES:].reshape(FEATURES, FEATURES)


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover together."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _overlaps(span: Span, covered: tuple[list[int], list[int]]) -> bool:
    starts, ends = covered
    before = bisect_left(starts, span.end) - 1
    return before >= 0 and ends[before] > span.start


def scan(text: str) -> tuple[list[Span], list[Span], list[int]]:
    """Base spans, candidates that overlap none of them, and the packed features of both."""
    base = base_spans(text)
    covered = _covered(base)
    more = [s for s in proposed(text) if not _overlaps(s, covered)]
    starts = sorted({s.start for s in base})
    packed = []
    for s in base + more:
        near = starts[bisect_left(starts, s.start - NEAR) : bisect_right(starts, s.start + NEAR)]
        votes = _votes(text, s, [x for x in near if x != s.start])
        packed.append(_packed(text, s, votes))
    return base, more, packed


def chosen(spans: list[Span], packed: list[int], weights: np.ndarray) -> list[Span]:
    """Of a text's candidates those that the classifier adds, none overlapping another."""
    if not spans:
        return []
    score = matrix(np.array(packed)) @ weights
    _, votes = _kind_votes(np.array(packed, np.int64))
    good = (score >= np.log(THRESHOLD / (1 - THRESHOLD))) & (votes == 1).any(axis=1)
    found: list[Span] = []
    taken: tuple[list[int], list[int]] = ([], [])
    for i in sorted(np.flatnonzero(good).tolist(), key=lambda i: (-score[i], spans[i].start, -spans[i].end, spans[i].kind)):
        span = spans[i]
        if not _overlaps(span, taken):
            place = bisect_left(taken[0], span.start)
            taken[0].insert(place, span.start)
            taken[1].insert(place, span.end)
            found.append(span)
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_LISTS = "start array<bigint>, kind array<bigint>, end array<bigint>, packed array<bigint>"
_ARROWS = pa.list_(pa.int64())


def _scanned(documents: DataFrame, kind: str) -> DataFrame:
    """A row for each document: how many of its spans are base spans, and all spans with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("personal")
        for batch in batches:
            counts, lists = [], ([], [], [], [])
            for text in batch.column("text").to_pylist():
                base, more, packed = scan(text or "")
                counts.append(len(base))
                for column, values in zip(lists, _columns(base + more, packed), strict=True):
                    column.append(values)
            arrays = [pa.array(x, _ARROWS) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *arrays], ["doc_id", "base", "start", "kind", "end", "packed"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base bigint, {_LISTS}")


def _columns(spans: list[Span], packed: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    return [s.start for s in spans], [s.kind for s in spans], [s.end for s in spans], packed


COLUMNS = {**{f"n_{k}": pa.int64() for k in BASE}, "base_sha256": pa.string(), "spans": pa.string()}


def find_personal(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds (n_email, n_ip, n_card, n_phone), base_sha256 and spans (base and
    added ones)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(documents.sparkSession)
    scanned = scratch.write(_scanned(documents, kind), "scanned", keep=True)
    fitted = fit(scanned.select(F.explode("packed").alias("packed")), scratch)
    scratch.close()
    weights = fitted[1] if fitted else np.zeros(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, *lists, packed in zip(*(batch.column(c).to_pylist() for c in ("base", "start", "kind", "end", "packed")), strict=True):
                spans = [Span(*x) for x in zip(*lists, strict=True)]
                base = spans[:n]
                counts = [sum(s.kind == k for s in base) for k in range(len(BASE))]
                added = chosen(spans[n:], packed[n:], weights)
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            arrays = [pa.array(c, k) for c, k in zip(cols, COLUMNS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *COLUMNS])

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return scanned.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
