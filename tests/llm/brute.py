"""Plain versions of the operators, over rows in memory, which tests compare with."""

import hashlib
import re
from collections import Counter, defaultdict

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    """kind -> [(start, end)]"""
    out = {}
    for kind, pattern in KINDS.items():
        found = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), m.end()))
        out[kind] = found
    return out


def repeats(texts, length=200):
    """For each text: bytes, removed bytes, runs, what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        upto = 0
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                for j in range(max(i, upto), i + length):
                    gone[j] = 1
                upto = i + length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def shingles(text, width):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(text)]
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(rows, width, t):
    """doc_id -> (shingles, component) by every pair that shares a shingle."""
    sets = {d: shingles(x, width) for d, x in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        shared = Counter(e for x in s for e in where[x] if e < d)
        for e, n in shared.items():
            if 100 * n >= t * (len(s) + len(sets[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}
