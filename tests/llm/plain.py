"""Brute-force versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def water_fill(sizes, weights, share, cap):
    """Rounds of sharing, clamping and sharing again."""
    left, target, free = share * sum(sizes.values()), {}, {s for s in sizes if weights[s] > 0}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total >= cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free} | {s: 0.0 for s in sizes if weights[s] <= 0}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target | {s: 0.0 for s in sizes if weights[s] <= 0}


def components(rows, k, num, den):
    """{doc_id: (n_shingles of the texts, component)}, all pairs."""
    sets = []
    for doc, text in rows:
        w = words((text or "").translate(FOLD))
        sets.append((doc, set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return Counter((d, len(s), root(d)) for d, s in sets)


def drop_lines(rows, chars, docs):
    key = lambda line: line.strip(BLANK).translate(FOLD)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < docs or d == max(held[key(x)])]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def secrets(text, rules):
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), rank, r.kind, m.end()))
    return sorted(found)


def overlaps(text, items, span, masks, window, share):
    """Items with a window of words that a seed hits and enough of which are equal."""
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate(FOLD))
    doc, got = split(text), set()
    for item, t in items:
        test = split(t)
        w = min(window, len(test))
        if len(test) < span:
            continue
        for i in range(len(doc) - w + 1):
            for j in range(len(test) - w + 1):
                same = [a == b for a, b in zip(doc[i : i + w], test[j : j + w], strict=True)]
                if 100 * sum(same) >= share * w and any(
                    all(same[o + p] for p in range(span) if p % masks != r) for o in range(w - span + 1) for r in range(masks)
                ):
                    got.add(item)
    return got
