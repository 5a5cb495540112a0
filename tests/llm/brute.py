"""Plain versions of the operators, one text or one table at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def secrets(text: str | None) -> tuple[list[int], str, list[tuple[int, int, int]]]:
    spans, counts = [], []
    for place, (_, pattern, group, least) in enumerate(KINDS):
        own = [(m.start(), place, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(own))
        spans += own
    spans.sort()
    named = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)
    return counts, hashlib.sha256(named.encode()).hexdigest(), spans


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def fingerprint(text: str | None, shingle: int = 4) -> int:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple[int, int]], radius: int = 4) -> dict[int, int]:
    """doc_id -> least doc_id reachable."""
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def nearest(ids: list[int], vectors: np.ndarray, k: int = 10) -> dict[int, list[tuple[float, int]]]:
    out = {}
    for q in {i for i in ids if i % 100 == 0}:
        point = vectors[ids.index(q)]
        score = np.sqrt(((vectors - point) ** 2).sum(axis=1))
        out[q] = sorted((s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_names = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] for s in capped} | share
        capped |= over
