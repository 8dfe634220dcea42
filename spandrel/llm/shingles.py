"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n, kept between calls."""
    if not _powers or len(_powers["up"]) < n:
        room = max(n, 2 * BLOCK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(room, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, the hashes of its words: runs without ASCII white space, A-Z lower-cased."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    up, down = _power(len(data))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a word begins, ends, begins ...
    began, ended = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    hashes = mix((total[ended] - total[began]) * down[began] + (ended - began).astype(np.uint64))
    lengths = np.array([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(began, np.cumsum(lengths)[:-1]))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles of `width` words.

    With fewer words, the whole sequence is the one shingle; without any, the set is empty.
    """
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    at = 0
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    while at < len(encoded):
        upto, size = at, 0
        while upto < len(encoded) and (upto == at or size + len(encoded[upto]) < BLOCK):
            size += len(encoded[upto]) + 1
            upto += 1
        for h in _word_hashes(encoded[at:upto]):
            n = len(h)
            if not n:
                yield h
                continue
            w = min(width, n)
            s = h[: n - w + 1] * factors[0]
            for j in range(1, w):
                s = s + h[j : n - w + 1 + j] * factors[j]
            yield np.unique(mix(s + np.uint64(w)))
        at = upto
