"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text, k=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near(rows, percent=85):
    """rows (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for v in by.values() for n, a in enumerate(v) for b in v[n + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    low = defaultdict(list)
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            low[r].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(low[root[i]], default=None)
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=repr)


def repeats(rows, size=100):
    """rows (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha256)}; doc_ids are distinct."""
    docs = sorted((d, (t or "").encode()) for d, t in rows)
    seen, out = set(), {}
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
