"""Plain versions of the operators' contracts, over lists of rows, for comparison in tests."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = {}
    for i, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out[i] = (len((text or "").encode()), n, n > 512)
    return out


def op2_targets(sizes: dict) -> dict:
    """sizes: of each source; targets by filling step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]} if free else set()
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    return target


def op3(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a:a + 10])].add("" if i is None else str(i))
    lengths = sorted({len(k) for k in windows})
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[a:a + n]))):
                    hit.update(range(a, a + n))
                    found |= who
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
    return out


def op4(docs, k=20):
    first = {}
    rows = sorted((i, WORD.findall(t or "")) for i, t in docs)
    for i, w in rows:
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a:a + k]), (i, a))
    out = {}
    for i, w in rows:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] != (i, a):
                gone.update(range(a, a + k))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode()))
    return out


def op5(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by = defaultdict(list)
    for i in sets:
        for g in sets[i]:
            by[g].append(i)
    shared = Counter()
    for group in by.values():
        for x in range(len(group)):
            for y in range(x):
                shared[group[y], group[x]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def op6(docs):
    out = {}
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        count = Counter(tuple(w[a:a + 3]) for a in range(len(w) - 2))
        rep = set()
        for a in range(len(w) - 2):
            if count[tuple(w[a:a + 3])] > 1:
                rep.update((a, a + 1, a + 2))
        out[i] = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep),
                  len(w) < 50 or 100 * len(rep) > 50 * len(w))
    return out


def op7(docs, path):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path), 0, {}
    for i, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    return out


def op8(pages, least=0):
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    out = {}
    for i, html in pages:
        raw = (html or "").encode()
        kind = "response" if first[html or ""] == i or len(raw) < least else "revisit"
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind,
                  first[html or ""] if kind == "revisit" else None)
    return out


def op10(docs, k=50):
    first = {}
    rows = sorted((i, (t or "").encode()) for i, t in docs)
    for i, b in rows:
        for a in range(len(b) - k + 1):
            first.setdefault(b[a:a + k], i)
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if first[b[a:a + k]] < i:
                gone[a:a + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def op11(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    from itertools import permutations

    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        bits = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                bool(re.search("[#$%&*|]", t)), i > least[t])
        rows.append((part or "", {x for x, b in zip("ABCDE", bits) if b}, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [r for r in own if x in r[1] and not before & r[1]]
                share[part, x] += len(here)
                out[part, "".join(order), k + 1] = (
                    sum(not (before | {x}) & r[1] for r in own), len(here), sum(x in r[1] and bool(before & r[1]) for r in own),
                    sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here))
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def op12(docs, trained, classes, k, smooth=0.1, back_off=16.0):
    """Scores with given classes of words; docs and trained: (id, text). The end is ' ' and in class 0."""
    from math import log10

    def tokens(text):
        return [*WORD.findall((text or "").translate(LOWER)), " "]

    count, follow = Counter(), Counter()
    for _, text in trained:
        seq = tokens(text)
        count.update(seq)
        follow.update(zip([classes[w] for w in [" ", *seq]], [classes[w] for w in seq]))
    n, v = sum(count.values()), len(count)
    if not n:
        return {i: (len(tokens(t)), 0, 0, 0.0, 0.0) for i, t in docs}
    size, once = Counter(), Counter()
    for w, c in count.items():
        size[classes[w]] += c
        once[classes[w]] += c == 1
    share = [(size[c] + smooth) / (n + smooth * k) for c in range(k)]

    def after(c, d):
        return share[d] if c is None else (follow[c, d] + back_off * share[d]) / (size[c] + back_off)

    out = {}
    for i, text in docs:
        base = score = 0.0
        seq, before = tokens(text), 0
        for w in seq:
            base += log10((count[w] + smooth) / (n + smooth * (v + 1)))
            if w in count:
                c = classes[w]
                score += log10(after(before, c) * count[w] / (size[c] + once[c] + smooth))
                before = c
            else:
                score += log10(sum(after(before, c) * (once[c] + smooth) / (size[c] + once[c] + smooth) for c in range(k)))
                before = None
        out[i] = (len(seq), sum(w in count for w in seq), n, base, score)
    return out


def op13(docs, items, runs=1, buckets=10_000, seed=2024, least=20, percent=10):
    from math import floor, log

    def found(text):
        w = ALNUM.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[a:a + k]).encode()) % buckets for k in range(1, runs + 1) for a in range(len(w) - k + 1)]

    own = {i: found(t) for i, t in docs}
    s = Counter(b for _, f in own.values() for b in f)
    t = Counter(b for _, text in items for b in found(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = {}
    for i, (n, f) in own.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{i}".encode())[:8], 16)
        out[i] = (n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))))
    order = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(order[:percent * len(order) // 100])}
    return {i: (*x[1:], rank.get(i)) for i, x in out.items()}
