"""64-bit hashes of words and word runs, many at once, in numpy."""

from __future__ import annotations

import numpy as np

#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: White space, by byte; all of it is ASCII.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept from call to call while under 2^20."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 20:
            _powers[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words between white space, A-Z lower-cased on demand."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.lower() if lower else raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = np.concatenate([[False], ~IS_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(BASE, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * _power(INVERSE, n))


def shingles(text: str | None, width: int, lower: bool = True) -> np.ndarray:
    """Distinct hashes of the runs of `width` words; of all words where they are fewer."""
    hashes = words(text, lower)
    return np.unique(runs(hashes, min(width, max(1, len(hashes)))))
