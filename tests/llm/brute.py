"""Slow, plain versions of the operators, written from what they promise."""

import hashlib
import math
import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_words(text) -> list[bytes]:
    return (text or "").encode().split()


def contamination(docs, items, window=10):
    pieces: dict[tuple, set] = {}
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            pieces.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(p) for p in pieces}:
            for i in range(len(w) - n + 1):
                if (own := pieces.get(tuple(w[i : i + n]))) is not None:
                    found |= own
                    hit.update(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def simhash(text) -> int:
    from xxhash import xxh64_intdigest

    w = (text or "").translate(LOW).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    docs = [(d, simhash(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if (x ^ y).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [(d, f"{x:016x}", find(d)) for d, x in docs]


def repeats(docs, window=20):
    seen, out = set(), []
    for doc, text in sorted(docs):
        w, gone = plain_words(text), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((doc, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def model_scores(docs, in_training, order, mu):
    """(doc, n_tokens, n_known, N, base, score) of each row, with exact counts."""
    tokens = [(d, (t or "").translate(LOW).encode().split() + [b""]) for d, t in docs]
    grams = Counter()
    for d, x in tokens:
        full = [b"", *x]
        for i in range(1, len(full)) if in_training(d) else ():
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[tuple(full[i - k + 1 : i + 1])] += 1
    one = {g: n for g, n in grams.items() if len(g) == 1}
    total, size = sum(one.values()), len(one)
    out = []
    for d, x in tokens:
        full, base, score, known = [b"", *x], 0.0, 0.0, 0
        for i in range(1, len(full)):
            p = (grams[(full[i],)] + 1) / (total + size + 1)
            base += math.log10(p)
            known += grams[(full[i],)] > 0
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    p = (grams[tuple(full[i - k + 1 : i + 1])] + mu * p) / (grams[tuple(full[i - k + 1 : i])] + mu)
            score += math.log10(p)
        out.append((d, len(x), known, total, base, score))
    return out


def fill_middle(docs):
    out = []
    for d, text in docs:
        text = text or ""
        w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = sha(f"1:{'' if d is None else d}")
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((d, len(w), "plain", None, None, sha(text), sha(text)))
            continue
        a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
        p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
        form = "spm" if h4 % 100 < 20 else "psm"
        made = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        out.append((d, len(w), form, len(p), len(m), sha(made), sha(text)))
    return out


def best_fit_decreasing(lengths, window):
    """How many windows plain best-fit decreasing needs."""
    from bisect import bisect_left, insort

    room: list[int] = []
    n = 0
    for x in sorted(lengths, reverse=True):
        k = bisect_left(room, x)
        left = room.pop(k) if k < len(room) else window
        n += left == window
        if left > x:
            insort(room, left - x)
    return n


def divergence(docs, top=200):
    """Every kept term for every group, as the definition says; docs are (lang, source, text)."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = Counter(t for _, _, w in own for t in set(w))
        kept = {t for t, n in holders.items() if n >= 3}
        counts = {s: Counter(t for _, x, w in own if x == s for t in w if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            parts = {
                "pair": [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s],
                "term": [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, rows in parts.items():
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(rows, 1) if part == "pair" or k <= top]
    return out
