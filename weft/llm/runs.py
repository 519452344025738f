"""Runs of characters of many texts at once: their hashes, and a bounded memo keyed by them."""

from __future__ import annotations

import numpy as np

from weft.llm.common import U64, Rolling, mix

_A, _B = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
#: Characters of the longest run that is kept in a memo.
LONGEST = 64


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as code points, and where each starts (one entry more)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return x, np.concatenate([[0], np.cumsum(lengths)])


def hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = x.astype(U64) + U64(1)
    size = (ends - starts).astype(U64)
    a, b = _A.of(_A.sums(wide), starts, ends), _B.of(_B.sums(wide), starts, ends)
    return mix(a + size), mix(~b - size)


class Memo:
    """Numbers of runs by a 128-bit hash: a table of fixed size with two places for each run.
    A run that finds both taken replaces the second; so memory is bounded, and results do not
    depend on what is kept."""

    def __init__(self, bits: int = 21):
        self.mask = U64((1 << bits) - 1)
        self.a, self.b = np.zeros((2, 1 << bits), U64)
        self.number = np.full(1 << bits, -1, np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one = (a & self.mask).astype(np.int64)
        out = np.where((self.a[one] == a) & (self.b[one] == b), self.number[one], -1)
        if len(rest := np.flatnonzero(out < 0)):
            two = (b[rest] & self.mask).astype(np.int64)
            out[rest] = np.where((self.a[two] == a[rest]) & (self.b[two] == b[rest]), self.number[two], -1)
        return out

    def put(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        at = (a & self.mask).astype(np.int64)
        at = np.where(self.number[at] < 0, at, (b & self.mask).astype(np.int64))
        self.a[at], self.b[at], self.number[at] = a, b, number

    def clear(self) -> None:
        self.number[:] = -1
