"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def katz(rows, k=5):
    docs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, WORD.findall((t or "").translate(LOWER)) + ["\0end"]) for d, t in rows]
    c1, c2, ch = collections.Counter(), collections.Counter(), collections.Counter()
    for _, out, w in docs:
        if not out:
            pairs = list(zip(["\0begin", *w[:-1]], w, strict=True))
            c1.update(w)
            c2.update(pairs)
            ch.update(h for h, _ in pairs)
    n, v = sum(c1.values()), len(c1)

    def star(counts):
        r = collections.Counter(counts.values())
        a = (k + 1) * r[k + 1] / r[1] if r[1] else 1
        out = [i - 0.5 for i in range(k + 1)]
        for i in range(1, k + 1):
            if r[i] and r[i + 1] and a < 1:
                s = ((i + 1) * r[i + 1] / r[i] - i * a) / (1 - a)
                out[i] = s if 0 < s < i else out[i]
        return lambda c: out[c] if c <= k else c - 0.5

    s1, s2 = star(c1), star(c2)
    p1 = {w: s1(c) / n for w, c in c1.items()}
    unknown = 1 - sum(p1.values())
    seen, mass = collections.Counter(), collections.Counter()
    for (h, w), c in c2.items():
        mass[h] += s2(c) / ch[h]
        seen[h] += p1[w]
    back = {h: (1 - mass[h]) / (1 - seen[h]) for h in mass}
    for h in list(ch)[:20]:
        total = sum(s2(c2[h, w]) / ch[h] if (h, w) in c2 else back[h] * p1[w] for w in c1) + back[h] * unknown
        assert abs(total - 1) < 1e-9
    result = []
    for d, out, w in docs:
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(s2(c2[h, x]) / ch[h] if (h, x) in c2 else back.get(h, 1) * p1.get(x, unknown)) for h, x in zip(["\0begin", *w[:-1]], w, strict=True))
        result.append((d, out, len(w), sum(x in c1 for x in w), n, base, score))
    return result


def repeats(rows, size=50):
    big = float("inf")
    docs = [(big if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, big), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == big else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def alike(rows, t=85, k=4):
    sets = []
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, (_, s) in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= t * (len(s) + len(sets[j][1]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)].append(d)
    return [(d, len(s), min(least[top(i)]) if least[top(i)] and s else d) for i, (d, s) in enumerate(sets)]


def similar_windows(rows, items, threshold=0.8, k=5):
    """(doc, item): best weighted Jaccard similarity of an item-sized window."""
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    best = {}
    for item, text in items:
        m = split(text)
        if not m:
            continue
        n = min(k, len(m))
        grams = lambda w, n=n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        own = grams(m)
        for d, t in rows:
            w = split(t)
            if not set(own) & set(grams(w)):
                continue
            for i in range(max(len(w) - len(m) + 1, 1)):
                g = grams(w[i : i + len(m)])
                low = sum((own & g).values())
                s = low / (sum(own.values()) + sum(g.values()) - low)
                if s >= threshold and s > best.get((d, item), 0) + 1e-12:
                    best[d, item] = s
    return best
