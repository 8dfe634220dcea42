"""Plain Python versions of the contracts of the numbered operators."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def unigram(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    count: Counter = Counter()
    for i, t in docs:
        if fold(i, 5) != 1:
            count.update([*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    return {i: (fold(i, 5) == 1, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in docs for w in [[*words(t), "\n"]]}


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, component): from every pair that shares a shingle."""
    sets, where, both = {i: shingles(t) for i, t in docs}, defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for found in where.values():
        both.update(combinations(sorted(found), 2))
    up = {i: i for i in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), k in both.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


KINDS = ("email", "ip", "card", "phone")
PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def private(text: str | None) -> list[str]:
    found = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]:
                found.append((m.start(), k, m.end()))
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def top_k(vectors: list[tuple], every: int = 20, top: int = 20) -> list[tuple]:
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))[:top]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)
