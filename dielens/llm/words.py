"""Words, lines and word windows of many texts at once, as 64-bit names.

The name of a string is the sum of a fixed random number for each byte times a power for its place, so the names of
all words of a batch come from one running sum.  Names depend on the content alone: equal strings have equal names in
every task.  Two different ones among n strings share a name with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), cut from one array of the next power of two."""
    return _powers(base, 1 << max(20, int(n - 1).bit_length()))[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes of UTF-8 a negated class of ASCII characters has; bytes of other characters belong to it."""
    import re

    one = re.compile(pattern)
    return np.array([b >= 128 or bool(one.fullmatch(chr(b))) for b in range(256)])


class Texts:
    """The texts of a batch in one array of bytes, each followed by a line end."""

    def __init__(
        self, texts: pa.Array, lower: bool = False, before: bytes = b"", change: tuple[bytes, bytes] | None = None
    ):
        """``change`` replaces a string in every text; ``before`` is put in front of each that is not empty."""
        raw = texts.cast(pa.binary()).to_pylist()
        if change:
            raw = [x.replace(*change) if x else x for x in raw]
        if before:
            raw = [before + x if x else x for x in raw]
        joined = b"\n".join(x or b"" for x in raw) + b"\n"
        if lower:
            joined = joined.lower()  # A-Z alone
        self.raw = joined
        self.bytes = np.frombuffer(joined, np.uint8)
        size = np.fromiter((len(x or b"") for x in raw), np.int64, len(raw))
        self.size = size
        self.end = np.cumsum(size + 1) - 1 if len(raw) else size
        self.start = self.end - size

    @classmethod
    def of(cls, raw: bytes, start: np.ndarray, end: np.ndarray) -> Texts:
        """Texts that already stand one after another, each followed by a line end."""
        own = cls.__new__(cls)
        own.raw, own.bytes = raw, np.frombuffer(raw, np.uint8)
        own.start, own.end, own.size = start, end, end - start
        return own

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every maximal run of bytes of a class; the line end is not in it."""
        flag = np.concatenate([[False], inside[self.bytes]]).view(np.int8)
        change = np.flatnonzero(np.diff(flag))
        return change[::2], change[1::2]

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.bytes)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.take(_BYTES, self.bytes, out=total[1:])
        total[1:] *= powers(_BASE, n)
        np.cumsum(total[1:], out=total[1:])
        return mixed((total[end] - total[start]) * powers(_INVERSE, n + 1)[start])

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions each text has."""
        return np.searchsorted(positions, self.end) - np.searchsorted(positions, self.start)


def window_names(names: np.ndarray, length: int) -> np.ndarray:
    """The name of the window of ``length`` words that starts at each word (those that run past the end: 0)."""
    n = len(names)
    out = np.zeros(n, U)
    if n >= length:
        total = np.zeros(n + 1, U)
        np.cumsum(names * powers(_BASE, n), out=total[1:])
        out[: n - length + 1] = mixed((total[length:] - total[: n - length + 1]) * powers(_INVERSE, n)[: n - length + 1])
    return out


def run_names(names: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The name of each run of ``length`` words from ``start`` on; runs of different length have different names."""
    n = len(names)
    total = np.zeros(n + 1, U)
    np.cumsum(names * powers(_BASE, max(n, 1))[:n], out=total[1:])
    whole = mixed((total[start + length] - total[start]) * powers(_INVERSE, n + 1)[start])
    return mixed(whole + length.astype(U))


def window_starts(n_words: np.ndarray, length: int) -> np.ndarray:
    """Which word of the concatenated texts starts a window inside its own text."""
    end = np.repeat(np.cumsum(n_words), n_words)
    return np.arange(len(end)) + length <= end


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` places from one of the starts."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(step)[:n] > 0
