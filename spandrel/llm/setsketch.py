"""SetSketch registers (Ertl 2021): exponentially spaced, truncated minima.

Each of m registers holds floor(1 - log_b(min over the set of h_i)), with h_i
exponentially distributed at rate a, cut to 0..q+1. Registers of a union are the
larger of the two sets' registers, and for a base near 1 two registers are equal
with a probability close to the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

REGISTERS, BASE, RATE, LIMIT = 128, 1.001, 20.0, 2**16 - 2
_RNG = np.random.default_rng(77003)
_FACTOR = _RNG.integers(1, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, REGISTERS, np.uint64)
_ROWS = 256


def sketch(hashes: np.ndarray) -> bytes:
    """The registers of a set of 64-bit hashes that isn't empty, as little-endian unsigned 16-bit numbers."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    work = np.empty((_ROWS, REGISTERS), np.uint64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at : at + _ROWS, None]
        x = work[: len(part)]
        np.multiply(part, _FACTOR, out=x)
        x += _SHIFT
        np.minimum(least, x.min(0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype("<u2").tobytes()


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from registers (pairs x m) and known set sizes.

    The likelihood is joint in the numbers of registers that are larger in a,
    larger in b, and equal; it is evaluated on a grid from 0 to the most that
    the sizes allow.
    """
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    fit = above * np.log(more) + below * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]
