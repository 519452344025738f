"""Secret scans: fixed patterns, and a guess-cost estimate of values in credential contexts.

The base patterns find assigned values, access keys and long hexadecimal runs.  Beyond them, a
value that follows a credential word is judged by how many guesses it withstands: a dynamic
programme splits it into dictionary words, dates, repeats, keyboard walks and brute-force
spans so that the product of their guesses is least.  A value whose least cost reaches
``MIN_LOG10`` is reported as kind ``guess``, unless a base span covers it already.

Null and empty texts have no spans.  Repeated rows give repeated results.  An empty table gives
an empty result, and columns other than doc_id and text are not read.  Texts and values of any
length are treated alike: the programme has no cut by length, and of the starts of a repeat it
keeps only those that can still matter.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import begin, kept

#: The base patterns and the least length of what they capture.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
KINDS = ("assign", "access", "hex", "guess")

#: Credential contexts of the method, and the value behind one, of any visible ASCII characters: one that a quote
#: opens ends at that quote, another one at a quote without a letter or digit after it.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)""",
    re.I | re.A,
)
VALUE = re.compile(r"""(?:"([!#-~]+)|'([!-&(-~]+)|((?:[!#-&(-~]|["'](?=[A-Za-z0-9]))+))""")
#: Every match of ASSIGN or CONTEXT holds one of these, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
#: Least log10 of guesses of a value that is reported.
MIN_LOG10 = 9.0
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> frozenset[str]:
    """Pairs of keys that lie side by side, in one row or in two."""
    pairs = set()
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for other, dx in ((y, 1), (y + 1, 0), (y + 1, -1)):
                if other < len(ROWS) and 0 <= x + dx < len(ROWS[other]):
                    near = ROWS[other][x + dx]
                    pairs |= {key + near, near + key}
    return frozenset(pairs)


NEAR = _neighbours()


class Words(dict):
    """log10 of each word's rank; ``longest`` is the length of the longest word."""

    longest = 0


@kept
def dictionary(path: str | None) -> Words:
    """The ranks in a public vocabulary of lower-case words (entries that end a word)."""
    found = Words()
    if path is not None:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        words = sorted((i, w[:-4]) for w, i in ids.items() if w.endswith("</w>") and len(w) >= 7 and w[:-4].isalpha())
        found.update((w, math.log10(rank + 1)) for rank, (_, w) in enumerate(words, 1))
        found.longest = max(map(len, found), default=0)
    return found


def _brute(part: str) -> float:
    kinds = (any(c.islower() for c in part), any(c.isupper() for c in part), any(c.isdigit() for c in part), any(not c.isalnum() for c in part))
    size = sum(n for n, has in zip((26, 26, 10, 33), kinds, strict=True) if has)
    return len(part) * math.log10(max(size, 1))


#: log10 of what a repeat costs for each character of its unit, and a walk at first and for each step.
PER_UNIT, WALK, STEP = math.log10(36), math.log10(47), math.log10(4)
UNITS, DATES = (1, 2, 3, 4), range(4, 11)


class _Repeats:
    """The cheapest repeat of units of one length that ends at a place.

    A repeat may start at any place of the stretch with this period.  Of two starts of one class
    (places a whole number of units apart) the later one is of no use once the earlier one is as
    cheap for the shortest repeat from the later; what is left are a few starts for each class.
    The last start of a class stays, as the stretch may break and begin anew with it."""

    def __init__(self, unit: int):
        self.unit, self.start = unit, 0
        self.open: list[list[tuple[int, float]]] = [[] for _ in range(unit)]

    def useless(self, later: tuple[int, float], starts: list[tuple[int, float]]) -> bool:
        return any(later[1] - cost >= math.log10(((later[0] - at) // self.unit + 2) / 2) for at, cost in starts)

    def add(self, at: int, cost: float) -> None:
        own = self.open[at % self.unit]
        if len(own) > 1 and self.useless(own[-1], own[:-1]):
            own.pop()
        own.append((at, cost))

    def end(self, j: int, low: str) -> float:
        """The least cost at j, after the character before it."""
        unit = self.unit
        if j > unit and low[j - 1] != low[j - 1 - unit]:
            self.start = j - unit
            self.open = [[x for x in own if x[0] >= self.start] for own in self.open]
        found = math.inf
        for at, cost in self.open[j % unit]:
            times = (j - at) // unit
            if times >= 2 and times * unit >= 3:
                found = min(found, cost + unit * PER_UNIT + math.log10(times))
        return found


def guess_cost(value: str, words: Words) -> float:
    """log10 of the guesses of the cheapest segmentation: a minimum over every split into words,
    dates, repeats, keyboard walks and brute-force characters, however long the value is."""
    n, low = len(value), value.lower()
    per = _brute(value) / n if n else 0.0
    best = [0.0] + [math.inf] * n
    repeats = [_Repeats(unit) for unit in UNITS]
    walk, least = 0, math.inf  # where the walk began; least cost of a start, steps before it taken off
    letters = 0  # length of the run of letters before j
    for r in repeats:
        r.add(0, 0.0)
    for j in range(1, n + 1):
        cost = best[j - 1] + per
        letters = letters + 1 if low[j - 1].isalpha() else 0
        for k in range(3, min(letters, words.longest) + 1):
            if (rank := words.get(low[j - k : j])) is not None:
                capitals = sum(map(str.isupper, value[j - k : j]))
                cost = min(cost, best[j - k] + rank + (math.log10(2) * (min(capitals, k - capitals) + 1) if capitals else 0))
        if value[j - 1].isdigit():
            for k in DATES:
                if k <= j and DATE.fullmatch(value, j - k, j):
                    cost = min(cost, best[j - k] + (math.log10(365 * 120) if k > 4 else math.log10(120)))
        for r in repeats:
            cost = min(cost, r.end(j, low))
        if j > 1 and low[j - 2 : j] not in NEAR:
            walk, least = j - 1, math.inf
        if j - 3 >= walk:
            least = min(least, best[j - 3] - (j - 3) * STEP)
        best[j] = min(cost, least + WALK + (j - 1) * STEP)
        for r in repeats:
            r.add(j, best[j])
    return best[n]


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in (ASSIGN.finditer(text) if hinted(text) else ()) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _ended(value: str, quoted: bool) -> str:
    """A value without what ends its sentence: a quoted one is whole; else points, commas and colons at its end go, and
    a bracket that nothing in it opens."""
    if quoted:
        return value
    value = value.rstrip(".,;:")
    while value.endswith(")") and value.count("(") < value.count(")"):
        value = value[:-1].rstrip(".,;:")
    return value


def added_spans(text: str, base: list[tuple[int, int, int]], words: Words) -> list[tuple[int, int, int]]:
    """Values in credential contexts that no base span covers and that are costly to guess.

    A context right behind another one takes its value over.  Contexts inside a value that is not reported are
    judged too, each with what follows it up to the next one, so each character is judged twice at most."""
    if not hinted(text):
        return []
    found = [(m.start(), m.end()) for m in CONTEXT.finditer(text)]
    out: list[tuple[int, int, int]] = []
    whole = 0  # where the last whole value ends
    reported = False
    for i, (_, at) in enumerate(found):
        following = found[i + 1][0] if i + 1 < len(found) else len(text)
        inside = at < whole
        if following <= at or (following == at + 1 and text[at] in "\"'") or (inside and reported):
            continue
        m = VALUE.match(text, at, min(whole, following) if inside else len(text))
        if m is None:
            continue
        start, end = m.span(m.lastindex)
        value = _ended(text[start:end], m.lastindex < 3)
        if not inside:
            whole, reported = end, False
        end = start + len(value)
        if not value or any(s <= start and end <= e for s, _, e in base):
            reported = reported or bool(value)
            continue
        if guess_cost(value, words) >= MIN_LOG10:
            out.append((start, 3, end))
            reported = True
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_documents(documents: DataFrame, word_list: str | None) -> DataFrame:
    """doc_id, counts of the base kinds (n_assign, n_access, n_hex), base_sha256 and spans; no rows for
    an empty table, zero counts for null and empty texts, a row for each of repeated rows."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secretscan")
        words = dictionary(word_list)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                added = added_spans(text or "", base, words)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(documents: DataFrame, word_list: str | None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mark`` (spans that touch or overlap: one
    mark); n_chars follows the text where the table has it.  All other columns stay as they are."""
    schema = documents.schema
    at = schema.fieldNames().index("text")
    chars = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else -1

    def clean(text: str | None, words: Words) -> str | None:
        if not text or not (spans := base_spans(text)) + (more := added_spans(text, spans, words)):
            return text
        out, done = [], 0
        for s, _, e in sorted(spans + more):
            if s > done or not out:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secretscan")
        words = dictionary(word_list)
        for batch in batches:
            texts = [clean(t, words) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if chars >= 0:
                n = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
                batch = batch.set_column(chars, batch.schema.field(chars), n)
            yield batch

    return documents.mapInArrow(run, schema)
