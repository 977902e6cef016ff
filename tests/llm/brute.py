"""Brute-force versions, one document after the other."""

import hashlib
import re


def blank_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def term_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def substring_dedup(rows, width):
    first = {}
    for i, t in rows:
        w = blank_words(t)
        for a in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[a : a + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = blank_words(t)
        gone = set()
        for a in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[a : a + width])] < i:
                gone.update(range(a, a + width))
        out.append((i, len(w), len(gone), sha([x for k, x in enumerate(w) if k not in gone])))
    return out


def shingles(text, width):
    w = blank_words(lower(text))
    return {tuple(w[a : a + width]) for a in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width, least):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if i is not None and j is not None and both and 100 * both >= least * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(x), None if i is None else find(i)) for i, x in sets]


def contamination(rows, items, width):
    windows = {}
    for k, t in items:
        w = term_words(t)
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(k)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, t in rows:
        w, hit, found = term_words(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if own := windows.get(tuple(w[a : a + m])):
                    hit.update(range(a, a + m))
                    found |= own
        names = sorted({str(k) for k in found if k is not None})
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out
