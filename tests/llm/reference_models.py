"""Brute-force versions of the operators, for small inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import xxhash

AWKWARD = [
    (1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "x " * 3000), (6, "same text here"), (7, "same text here"), (8, "same text here "), (9, "ünï cödé ☃ 漢字"),
    (None, "no id"), (10, "twice"), (10, "twice"), (11, "0" * 5000), (12, "\x00\x01\x02"), (13, None), (14, "one id"), (14, "two texts"),
]


def generated(n=120, seed=0):
    """Rows with shared passages, copies and near copies."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [words(r.randrange(15, 150)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = r.random()
        text = words(r.randrange(0, 200))
        if kind < 0.5:
            at = r.randrange(len(text) + 1)
            text[at:at] = r.choice(passages)
        elif kind < 0.7 and rows:
            text = rows[r.randrange(len(rows))][1].split()
            if r.random() < 0.6 and text:
                text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def words_of(text):
    return (text or "").encode().split()


def substring(rows, width=20):
    first = {}
    for d, t in sorted(rows):
        w = words_of(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = {}
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def suffix(rows, width=400):
    count = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            count[b[i : i + width]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


def fingerprint(text, k=4):
    w = [x.decode() for x in words_of(text)]
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, budget=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > ceiling * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        free -= over
    return target


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())
