"""Row-at-a-time twins of the operators, straight from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(hit), n < 50 or 100 * sum(hit) > 50 * n


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows, percent=80):
    """rows: distinct (doc_id, text); {doc_id: (n_shingles, component, kept)}."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def word_windows(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def byte_strings(rows, k=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            key = b[i : i + k]
            if key in seen:
                gone[i : i + k] = b"\1" * k
            seen.add(key)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def viterbi(scores, transitions, first):
    """The best labels of one page by trying all."""
    import itertools

    def value(labels):
        return first[labels[0]] + sum(e[x] for e, x in zip(scores, labels)) + sum(transitions[a][b] for a, b in zip(labels, labels[1:]))

    return max(itertools.product(range(2), repeat=len(scores)), key=value)
