"""Plain Python versions of the operators, for small inputs."""

import re
import zlib
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), data) if lower else data)


def shingles(text, k):
    w = words(text, True)
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def groups(n, links):
    """Smallest reachable position of every position."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_copies(rows, k, num, den):
    """rows (id, text) -> list of (id, n_shingles, component_id)."""
    sets = [shingles(t, k) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                links.append((j, i))
    part = groups(len(rows), links)
    least = {}
    for (id_, _), p in zip(rows, part):
        if id_ is not None:
            least[p] = min(id_, least.get(p, id_))
    return [(id_, len(s), least.get(p) if s else id_) for (id_, _), s, p in zip(rows, sets, part)]


def without_repeats(rows, length):
    """rows (id, text) -> list of (id, kept words, number of words)."""
    first = {}
    for id_, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            if id_ is not None:
                key = tuple(w[i : i + length])
                first[key] = min(id_, first.get(key, id_))
    out = []
    for id_, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if id_ is not None and first[tuple(w[i : i + length])] < id_:
                gone[i : i + length] = [True] * length
        out.append((id_, [x for x, g in zip(w, gone) if not g], len(w)))
    return out


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """{source: size} -> {source: target}, cutting and sharing again until none is above."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cut = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in cut)
        left = sum(weight[s] for s in order if s not in cut)
        target = {s: ceiling * sizes[s] if s in cut else rest * weight[s] / left for s in order}
        above = {s for s in order if s not in cut and target[s] > ceiling * sizes[s]}
        if not above:
            return target
        cut |= above


def crc(data):
    return zlib.crc32(data)


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
