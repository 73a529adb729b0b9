"""Plain, slow versions of what the operators compute."""

import hashlib
import re

import numpy as np

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components(texts, n, percent):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def cut_repeats(rows, length=100):
    """[(removed, spans, sha256 of what is left)] for texts in order."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def exact_links(texts, n, percent):
    """Pairs (a, b) of a prefix-filter join over distinct sets: sets as similar as wanted share one of their rarest shingles."""
    sets, counts = {}, {}
    for d, t in sorted(texts.items()):
        own = shingles(t, n)
        if own and own not in sets:
            sets[own] = d
    for own in sets:
        for x in own:
            counts[x] = counts.get(x, 0) + 1
    index, links = {}, []
    for own, d in sorted(sets.items(), key=lambda x: (len(x[0]), x[1])):
        rare = sorted(own, key=lambda x: (counts[x], x))[: len(own) - -(-percent * len(own) // 100) + 1]
        for other in {o for x in rare for o in index.get(x, ())}:
            if 100 * len(other) >= percent * len(own):
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    links.append((sets[other], d))
        for x in rare:
            index.setdefault(x, []).append(own)
    return links
