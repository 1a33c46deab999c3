"""Vectorised hashing of word shingles over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Texts are hashed together up to so many bytes; a longer one goes alone.
BATCH_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _constants(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = _constants(256, 11)
_STEP = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[name][:n]


def word_hashes(data: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the words in a byte array (A-Z folded): where each starts, and a 64-bit hash of its bytes.

    ``gap`` marks the bytes between words, white space by default.
    """
    gap = _SPACE[data] if gap is None else gap
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * _powers(_STEP, "step", len(data)), out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * _powers(_BACK, "back", len(data) + 1)[starts])


def shingle_hashes(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles (see :func:`in_batches` for the rest)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    starts, words = word_hashes(data)
    last = np.searchsorted(starts, ends)
    factors = _constants(k, 77)
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * factors[j]
    rolled = mixed(rolled)
    out, first = [], 0
    for end in last.tolist():
        n = end - first
        if n >= k:
            own = np.sort(rolled[first : end - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
        elif n:
            own = mixed(np.sum(words[first:end] * factors[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        first = end
    return out


def in_batches(texts: Iterator[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct shingle hashes; fewer than ``k`` words: one for all of them; none: empty."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        some.append(raw)
        size += len(raw)
        if size >= BATCH_BYTES:
            yield from shingle_hashes(some, k)
            some, size = [], 0
    if some:
        yield from shingle_hashes(some, k)
