"""Plain versions of the operators, and documents with all kinds of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = {ord("A") + i: ord("a") + i for i in range(26)}
SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, shard string, spans string, _rank int, n_lines string, at int, body string, _text int, _key int, run int"


def docs(seed=0, n=70):
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, empty, blank and long texts, repeated ids and rows."""
    r = random.Random(seed)
    vocabulary = ["alpha", "Be", "gamma", "dé", "e", "zeta,", "Étá", "x1", "the", "of", "und", "le"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(r.randint(6, 20)) for _ in range(8)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            text = r.choice(out)[1]
        elif kind < 0.35 and out:
            words = (r.choice(out)[1] or "a b c").split(" ")
            words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = "\n".join(r.choice(shared) if r.random() < 0.4 else line(r.randint(0, 25)) for _ in range(r.randint(0, 6)))
        out.append((i, text))
    near = shared[0].split(" ")
    out += [(None, shared[1]), (None, None), (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "12 34 !!"), (5, shared[2]), (5, out[5][1]), (n + 4, line(9000)), (n + 5, "a" * 3000)]
    out += [(n + 6 + k, " ".join(near[:k] + ["new"] + near[k:])) for k in range(3)] + [(n + 9 + k, " ".join(near[:k] + near[k + 1 :])) for k in range(3)]
    return out


def frame(spark, rows):
    """Documents with more columns, some of them null, named like those the operators make."""
    return spark.createDataFrame([(i, t, None if i and i % 7 == 0 else "en", None, None if t is None else len(t), 1, "f", "s", "p", 2, "n", 3, "b", 4, 5, 6) for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def contamination(rows, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    grams = defaultdict(set)
    for name, t in items:
        w = words(t)
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            grams[tuple(w[k : k + n])].add(name)
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit.update(range(k, k + size))
                    names |= grams[g]
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def substrings(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def simhash(t, shingle=4):
    w = [x for x in re.split(SPACE, (t or "").translate(UPPER)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """Smallest id of the group of each (id, fingerprint), over any number of links."""
    fps = np.array([f for _, f in prints], np.uint64)
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = root(i), root(int(j))
            group[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, f, least.get(root(k))) for k, (i, f) in enumerate(prints)), key=str)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def lines(rows, order, least=8):
    """(id, text, lines, equal, near) by comparing all pairs of lines; ``order`` gives the place of a row among equal ids."""
    found, words = {}, lambda x: tuple(w for w in re.split(SPACE, x) if w)
    place = lambda i, t: (i is not None, i or 0, order(t))
    for i, t in rows:
        for p, x in enumerate(t.split("\n") if t is not None else ()):
            if words(x):
                found[words(x)] = min(found.get(words(x), (*place(i, t), p)), (*place(i, t), p))
    big = [w for w in found if len(w) >= least]
    near = {w for w in big if any(found[v] < found[w] and one_edit(v, w) for v in big if abs(len(v) - len(w)) < 2)}
    out = []
    for i, t in rows:
        kept, n = [], [0, 0, 0]
        for p, x in enumerate(t.split("\n") if t is not None else ()):
            w = words(x)
            fate = 0 if not w else 1 if found[w] != (*place(i, t), p) else 2 if w in near else 0
            n[fate] += 1
            kept += [x] if not fate else []
        out.append((i, t if t is None else "\n".join(kept), sum(n), n[1], n[2]))
    return sorted(out, key=str)


def suffix_tree(rows, k):
    tokens = [[w for w in re.split(SPACE, (t or "").translate(UPPER)) if w] + ["\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    single = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, distinct = sum(single.values()), len(single)
    base = lambda w: (single[w] + 0.5) / (total + 0.5 * (distinct + 1))
    grams, size, states, examined, depth = {}, {(): total}, set(), set(), 0

    def p(c, w):
        while c and c not in states:
            c = c[1:]
        return (grams[c][w] + k * p(c[1:], w)) / (size[c] + k) if c else base(w)

    while True:
        depth += 1
        here = defaultdict(Counter)
        for ws, h in zip(tokens, held):
            padded = ["\0", *ws]
            for q in range(depth - 1, 0 if h else len(ws)):
                here[tuple(padded[q + 1 - depth : q + 1])][ws[q]] += 1
        size |= {c: sum(g.values()) for c, g in here.items()}
        grams |= here
        fit = {c for c in here if 2 <= size[c] < size[c[1:]] and (depth == 1 or (c[1:] in states and c[:-1] in examined))}
        gains = {c: sum(m * math.log10((m - 1 + k * p(c[1:], w)) / (size[c] - 1 + k) / p(c[1:], w)) for w, m in here[c].items()) for c in fit}
        new = {c for c in fit if round(gains[c], 6) > 0}
        examined |= fit
        states |= new
        if not new:
            break
    out = []
    for (i, _), ws, h in zip(rows, tokens, held):
        score = sum(math.log10(p(tuple(["\0", *ws][max(0, q + 1 - depth) : q + 1]), w)) for q, w in enumerate(ws))
        out.append((i, h, len(ws), sum(single[w] > 0 for w in ws), total, round(sum(math.log10(base(w)) for w in ws), 4), round(score, 4)))
    return sorted(out, key=str), Counter(map(len, states))
