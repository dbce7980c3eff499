"""Plain Python versions of what the corpus operators compute."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def components(nodes, links):
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    return {n: root(n) for n in nodes}


def near(docs, k, percent):
    """{doc_id: (shingles, component)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def lines(docs, percent):
    """{doc_id: line numbers that go}, for distinct ids."""
    seen, out = [], {}
    for d, t in sorted(docs):
        out[d] = []
        for n, line in enumerate((t or "").lower().split("\n")) if t is not None else []:
            words = set(re.split(r"[ \t\r\x0b\x0c]+", line)) - {""}
            if not words:
                continue
            if any(100 * len(words & other) >= percent * len(words | other) for other in seen):
                out[d].append(n)
            seen.append(words)
    return out


def edits(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def xx(seed, *values):
    """Spark's xxhash64 of some values: texts by their UTF-8 bytes, longs by 8 bytes, bytes as they are; each hash is the seed of the next."""
    import xxhash

    for v in values:
        data = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def fingerprint(text):
    """128 signed votes over words, each with the word before it, weighted by the word's length."""
    votes, last = [0] * 128, 0
    for w in WORD.findall(text or ""):
        own = xx(42, w)
        h = xx(42, last, own)
        both, last = h | xx(42, h, (1).to_bytes(4, "little")) << 64, own
        for i in range(128):
            votes[i] += min(len(w), 16) * (1 if both >> i & 1 else -1)
    bits = sum(1 << i for i, v in enumerate(votes) if v > 0)
    return f"{bits & (1 << 64) - 1:016x}{bits >> 64:016x}"


def discriminant(rows, pooled=0.1, diagonal=0.05):
    """Of rows (x, class): a function that gives the log-density and prior of class 1 less those of class 0, with whole inverses and determinants."""
    import numpy as np

    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    scale = np.sqrt(np.maximum(((x - x.mean(0)) ** 2).mean(0), 1e-9))
    z = (x - x.mean(0)) / scale
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    within = sum((y == c).sum() * cov[c] for c in (0, 1)) / len(y)
    out = {}
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * within
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        out[c] = z[y == c].mean(0), np.linalg.inv(s), np.linalg.slogdet(s)[1], np.log((y == c).mean())

    def difference(v):
        v, side = (np.array(v) - x.mean(0)) / scale, {}
        for c, (mean, inverse, logdet, prior) in out.items():
            side[c] = prior - 0.5 * (logdet + (v - mean) @ inverse @ (v - mean))
        return side[1] - side[0]

    return difference


def decode(margins, code, weight):
    """The least weighted logistic loss over codewords, bit by bit: (which codeword, losses)."""
    import math

    losses = []
    for word, w in zip(code, weight):
        losses.append(sum(wb * math.log1p(math.exp(-m * b)) for m, b, wb in zip(margins, word, w)))
    return losses.index(min(losses)), losses


def run_lengths(texts, least):
    """Pairs (later, earlier) of texts that share a run of `least` words, by every run of every text."""
    where, out = {}, set()
    for d, t in enumerate(texts):
        ws = WORD.findall(lower(t or ""))
        for i in range(len(ws) - least + 1):
            where.setdefault(tuple(ws[i : i + least]), set()).add(d)
    for ds in where.values():
        out |= {(b, a) for a in ds for b in ds if a < b}
    return out
