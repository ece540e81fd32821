"""Plain single-process forms of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_lines(docs, min_chars=10):
    """[(doc_id, text)] -> per row (n_lines, n_dropped, kept text)."""
    holders = defaultdict(set)
    last = float("inf")
    keyed = []
    for doc, text in docs:
        doc = last if doc is None else doc
        lines = [(line, line.strip(SPACES).translate(LOWER)) for line in (text or "").split("\n")]
        keyed.append((doc, lines))
        for _, k in lines:
            if len(k) >= min_chars:
                holders[k].add(doc)
    out = []
    for doc, lines in keyed:
        kept = [line for line, k in lines if len(holders[k]) < 2 or doc == min(holders[k])]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(a, b, percent=75):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def linked_components(docs, percent=75):
    """[(doc_id, text)] -> per row (n_shingles, component)."""
    last = float("inf")
    ids = [last if d is None else d for d, _ in docs]
    sets = [shingles(t) for _, t in docs]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        if similar(sets[i], sets[j], percent):
            a, b = sorted((root(ids[i]), root(ids[j])))
            parent[b] = a
    return [(len(s), None if root(d) == last else root(d)) for d, s in zip(ids, sets)]


def mixed(docs, weights=(5, 2, 1), repeats=3):
    """[(doc_id, source, text)] -> (per row (size, source size, target, taken), [(row, copy, words)])."""
    size = [len(WORD.findall(t or "")) for _, _, t in docs]
    total = defaultdict(int)
    for (_, s, _), n in zip(docs, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: float(repeats * total[s]) for s in order}
    target, free = {}, list(order)
    while True:  # share again until none is above its limit
        rest = sum(size) - sum(cap[s] for s in order if s not in free)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            break
        free = [s for s in free if s not in over]
    target = {s: level * weight[s] if s in free else cap[s] for s in order}
    entries = []
    for s in order:
        rows = [i for i, d in enumerate(docs) if d[1] == s]
        rows.sort(key=lambda i: (hashlib.md5(str(docs[i][0] if docs[i][0] is not None else "").encode()).hexdigest(), docs[i][0] is not None and docs[i][0], size[i]))
        start, met = 0, int(target[s])
        for copy in range(repeats):
            for i in rows:
                stop = start + size[i]
                ends = [met, stop] if start < met < stop else [stop]
                for piece, (a, b) in enumerate(zip([start, *ends], ends)):
                    if target[s]:
                        key = hashlib.md5(str(docs[i][0] if docs[i][0] is not None else "").encode()).hexdigest()
                        entries.append((b / target[s], key, docs[i][0] or 0, size[i], copy, piece, b - a, i))
                start = stop
    taken, used, parts = [0] * len(docs), 0, defaultdict(int)
    for *_, copy, _, words, i in sorted(entries):
        used += words
        if used > sum(size):
            break
        taken[i] += words
        parts[i, copy] += words
    rows = [(n, total[d[1]], target[d[1]], t) for n, d, t in zip(size, docs, taken)]
    return rows, [(i, c, w) for (i, c), w in parts.items() if w]


def leading_words(text, n):
    spans = list(re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text))
    return "".join(m[0] for m in spans[:n])
