"""Plain Python versions of what the text operators compute."""

import math
import re
import string
import zlib
from collections import Counter, defaultdict
from statistics import median

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(docs, words=4, percent=80):
    """{id: (set size, component)} from [(id, text)] with different ids."""
    sets = {}
    for i, t in docs:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} from {source: words}, None last; caps one after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        total = sum(weight[s] for s in names if s not in full)
        out |= {s: left * weight[s] / total for s in names if s not in full}
        over = [s for s in names if s not in full and out[s] > most * sizes[s]]
        if not over:
            return out
        for s in over:
            full.add(s)
            out[s] = most * sizes[s]
        left = sum(sizes.values()) - sum(out[s] for s in full)
        if len(full) == len(names):
            return out


def counts(text):
    """words, their characters, symbols, repeated lines, words in repeated 3-word windows."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def contamination(text, items, width=10):
    """(words, hit words, found item ids) against [(item id, text)]."""
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        q = ALNUM.findall(lower(t))
        n = min(width, len(q))
        windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def longest_matches(text, items, width=10):
    """All verbatim matches of a window or more that can't go on to either side: (item id, first in item, first in text, words)."""
    w, out = ALNUM.findall(lower(text)), []
    for i, t in items:
        q = ALNUM.findall(lower(t))
        for a in range(len(q)):
            for b in range(len(w)):
                if q[a] != w[b] or a and b and q[a - 1] == w[b - 1]:
                    continue
                n = 0
                while a + n < len(q) and b + n < len(w) and q[a + n] == w[b + n]:
                    n += 1
                if n >= min(width, len(q)):
                    out.append((str(i), a, b, n))
    return sorted(out)


def phrases(text, labels):
    """(words, places, first, last, labels) of {phrase: label}."""
    w = ALNUM.findall(lower(text))
    at = []
    for p, label in labels.items():
        q = p.split()
        at += [(k, label) for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
    at.sort()
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def _kneser_ney(texts, order):
    """p(gram) of a modified Kneser-Ney model of symbols, as a function, from plain dictionaries."""
    levels = {order: Counter()}
    for t in texts:
        t = "\x02" * (order - 1) + t + "\x03"
        levels[order].update(t[k : k + order] for k in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut, total, held = {}, defaultdict(int), defaultdict(float)
    for k, level in levels.items():
        n = [max(1, sum(c == x for c in level.values())) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cut[k] = [min(max(c - (c + 1) * y * n[c] / n[c - 1], 0.1), 0.9 * c) for c in (1, 2, 3)]
        for g, c in level.items():
            total[g[:-1]] += c
            held[g[:-1]] += cut[k][min(c, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / 0x110000
        c, h = levels[len(gram)][gram], gram[:-1]
        if not total[h]:
            return p(gram[1:])
        return (c - cut[len(gram)][min(c, 3) - 1] if c else 0) / total[h] + held[h] / total[h] * p(gram[1:])

    return p


def fails(t):
    """Whether a text fails the base rules."""
    n, _, _, _, again = counts(t)
    return n < 50 or 100 * again > 50 * n


def judged(docs, half_of, chosen, order=4, width=6.0):
    """{id: (bits, kept)} from [(id, text, lang)]; half_of gives a text's half, chosen holds the (lang, text) that count, once each."""
    base, train, left = {}, defaultdict(list), set(chosen)
    for i, t, lang in docs:
        _, chars, _, _, _ = counts(t)
        base[i] = fails(t)
        if (lang, t) not in left:
            continue
        left.discard((lang, t))
        odd, capitals = sum(c in string.punctuation for c in t or ""), sum("A" <= c <= "Z" for c in t or "")
        if not base[i] and odd <= 0.1 * chars and capitals <= 0.2 * chars:
            train[half_of(t), lang].append(t)
    models = {k: _kneser_ney(v, order) for k, v in train.items()}
    every = {h: _kneser_ney([t for (x, _), v in train.items() if x == h for t in v], order) for h in (0, 1)}
    bits = {}
    for i, t, lang in docs:
        if not base[i]:
            own, whole = models.get((1 - half_of(t), lang), lambda g: 1 / 0x110000), every[1 - half_of(t)]
            s = "\x02" * (order - 1) + t + "\x03"
            bits[i] = sum(-math.log2((own(s[k : k + order]) + whole(s[k : k + order])) / 2) for k in range(len(t) + 1)) / (len(t) + 1)
    out, size = {}, {i: len(t or "") + 1 for i, t, _ in docs}
    for lang in {x for _, _, x in docs}:
        each = {t: (round(bits[i], 4), math.sqrt(size[i] / (size[i] + 1000))) for i, t, x in docs if (x, t) in chosen and x == lang}.values()
        middle = median(b for b, _ in each) if each else 0
        spread = median(round(abs(b - middle) * w, 4) for b, w in each) if each else 0
        for i, t, x in docs:
            if x == lang:
                reach = width * 1.4826 * max(spread, 0.015) / math.sqrt(size[i] / (size[i] + 1000))
                out[i] = (bits.get(i), i in bits and abs(bits[i] - middle) <= reach)
    return out


def licence_shares(text, templates, least):
    """The share of each template that the best chain of its longest matches covers, by trying every place."""
    w = ALNUM.findall(lower(text))
    out = []
    for _, t in templates:
        q = ALNUM.findall(lower(t))

        def ending(end):  # words of the longest match with q that ends before `end`, and its places
            n, places = 0, []
            for b in range(1, len(q) + 1):
                k = 0
                while k < min(end, b) and w[end - 1 - k] == q[b - 1 - k]:
                    k += 1
                if k > n:
                    n, places = k, []
                if k == n and n:
                    places.append(b)
            return n, places

        found, lengths = set(), [ending(k) for k in range(len(w) + 1)] + [(0, [])]
        for end in range(1, len(w) + 1):
            n, places = lengths[end]
            if n >= least and lengths[end + 1][0] != n + 1:
                found |= {(end - n, b - n, n) for b in places}
        found, best = sorted(found), []
        for j, (_, at, n) in enumerate(found):
            before = [best[i] + at + n - max(at, found[i][1] + found[i][2]) for i in range(j) if found[i][1] + found[i][2] < at + n]
            best.append(max([n, *before]))
        out.append(min(1.0, max(best, default=0) / len(q)))
    return out
