"""Vectorised word and shingle hashing shared by the document operators."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: One random word for each byte value, and the odd base of the rolling hash.
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; kept for up to a million, else made anew."""

    def run(b: int, size: int) -> np.ndarray:
        p = np.full(size, _U(b), _U)
        p[0] = 1
        return np.multiply.accumulate(p)

    if n > 1 << 20:
        return run(_BASE, n), run(_BASE_INV, n)
    if 0 not in _POWERS:
        _POWERS[0] = run(_BASE, (1 << 20) + 1), run(_BASE_INV, (1 << 20) + 1)
    return _POWERS[0]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by one pass of a polynomial prefix sum over their bytes."""
    if not words:
        return np.empty(0, _U)
    data = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(_U))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles.

    A-Z is lower-cased and words are runs without ASCII white space. With fewer
    words than ``size`` the whole sequence is one shingle; without words, or
    for null, the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    h = word_hashes(words)
    k = min(size, len(h))
    n = len(h) - k + 1
    total = h[:n] + _U(k)
    for i in range(1, k):
        total += h[i : n + i] * mix(np.array([i], _U))
    total = np.sort(mix(total))
    return total[np.append(True, total[1:] != total[:-1])]
