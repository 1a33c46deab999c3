"""SetSketch: registers of exponentially spaced truncated minima (Ertl, VLDB 2021)."""

from __future__ import annotations

import numpy as np

from loomspan.llm.shingles import mixed

REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, 65534


def _scaled(intervals: np.ndarray, share: np.ndarray, m: int) -> np.ndarray:
    """Register values of exponential points that lie at ``share`` of the given equally likely intervals."""
    x = -np.log1p(-(intervals + share) / m) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(x) / np.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers for each set of distinct 64-bit hashes; ``m`` is a power of two.

    Every element draws ``m`` points, one from each of ``m`` equally likely consecutive intervals of the
    exponential distribution, and deals them to the registers in an order of its own; a register keeps the
    least point, on a scale of powers of ``BASE``. As points only grow from interval to interval, a
    register that is filled stays as it is, so a set is done with as soon as all are. A union has the
    greater of both values in each register. The registers of an empty set are zero.
    """
    out = np.zeros((len(sets), m), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    lane = (mixed(element ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(m - 1)).astype(np.int64)
    stride = ((mixed(element ^ np.uint64(0x14057B7EF767814F)) & np.uint64(m - 1)) | np.uint64(1)).astype(np.int64)
    none = np.uint64(2**64 - 1)
    value = out.reshape(-1)
    filled = np.zeros(len(sets) * m, bool)
    for step in range(m):
        at = owner * m + ((lane + step * stride) & (m - 1))
        free = ~filled[at]
        spots, draw = at[free], mixed(element[free] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        least = np.full(len(filled), none, np.uint64)
        np.minimum.at(least, spots, draw)
        hit = np.flatnonzero(least != none)
        value[hit] = _scaled(np.float64(step), (least[hit] >> np.uint64(11)).astype(np.float64) / 2.0**53, m)
        filled[hit] = True
        open_ = ~filled.reshape(len(sets), m).all(1)
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            element, owner, lane, stride = element[keep], owner[keep], lane[keep], stride[keep]
    return out


def likelier(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: float) -> np.ndarray:
    """Whether the joint maximum-likelihood Jaccard similarity of sketch pairs is at least ``j``.

    From how many registers of the first are greater, less and equal, and from the sizes of both sets. The
    log-likelihood is concave in the similarity, so the sign of its slope at ``j`` answers it.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.maximum(x, 1e-12)
        return -np.log1p(-x * c) / log_b, c / (1 - x * c) / log_b

    (pa, da), (pb, db) = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - pa - pb, 1e-12)
    slope = -greater * da * v / pa - less * db * u / pb + equal * (da * v + db * u) / same
    # a similarity beyond the smaller size divided by the larger is impossible
    return (slope >= 0) & (np.minimum(n_a, n_b) >= j * np.maximum(n_a, n_b))
