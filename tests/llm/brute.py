
"""Plain versions of the operators, for small fixtures."""

import re

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(nodes, links):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_groups(documents, least=80):
    """{id: (size, component)} for {id: text}."""
    sets = {i: shingle_set(t) for i, t in documents.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    found = groups(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}, links


def cosine_groups(vectors, threshold=0.95):
    """{id: (links, component)} for {id: vector}."""
    usable = {}
    for i, v in vectors.items():
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            usable[i] = x / np.linalg.norm(x)
    ids = sorted(usable)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
             if len(usable[a]) == len(usable[b]) and float(usable[a] @ usable[b]) >= threshold]
    found = groups(list(vectors), links)
    return {i: (sum(i in pair for pair in links), found[i]) for i in vectors}
