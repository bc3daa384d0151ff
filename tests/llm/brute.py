"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w for w in BLANKS.split(text or "") if w]


def shingles(text: str | None, k: int = 5) -> set:
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def union_find(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_components(docs: list[tuple], percent: int = 75, k: int = 5) -> dict:
    """doc_id -> (n_shingles, component_id), over all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    post = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            post[x].append(d)
    shared = defaultdict(int)
    for own in post.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = union_find(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}
