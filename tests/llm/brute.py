"""Plain Python counterparts of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        s += n if n < 10 else n - 9
    return s % 10 == 0


def pii(text):
    t = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def secrets(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def digest(spans):
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def quality(text):
    t = text or ""
    w = WS.findall(t)
    tri = list(zip(w, w[1:], w[2:], strict=False))
    c, hit = Counter(tri), set()
    for i, x in enumerate(tri):
        if c[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WS.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xx(seed: int, *parts: bytes) -> int:
    h = seed
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return h


def grams(text, buckets):
    """Bucket numbers as the operator makes them: XXH64 with seed 42, chained over several values."""
    w = WS.findall(text or "")
    one = [xx(42, x.encode()) for x in w]
    pack = lambda x: x.to_bytes(8, "little")
    two = [xx(42, pack(a), pack(b)) for a, b in zip(one, one[1:], strict=False)]
    ends = [xx(42, x[-2:].encode()) for x in w]
    return [signed(x) % buckets for x in (*one, *two, *ends)]


def lines(texts, least):
    keys = [{k for x in (t or "").split("\n") if (k := key(x))} for t in texts]
    c = Counter(k for s in keys for k in s)
    out = []
    for t in texts:
        ls = (t or "").split("\n")
        left = [x for x in ls if c[key(x)] < least or not key(x)]
        out.append((len(ls), len(ls) - len(left), sha("\n".join(left))))
    return out


def key(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def contamination(texts, items, window=8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for item, t in items:
        w = low(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            if size:
                wins[tuple(w[i : i + size])].add(item)
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if got := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= got
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), sha(",".join(ids)), len(ids) >= 2))
    return out


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def shingle_set(text, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WS.findall(w)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def near_left(rows):
    """Pairs of similar rows (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    return sum(similar(a, b) for i, a in enumerate(sets) for b in sets[:i])


def has_earlier(rows, row):
    """Whether another row that is no later (null ids last) is similar to row."""
    order = lambda r: (r[0] is None, r[0] or 0)
    mine = shingle_set(row[1])
    return any(q != row and order(q) <= order(row) and similar(mine, shingle_set(q[1])) for q in rows)
