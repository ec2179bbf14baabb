"""Mismatch kernels against all words of the alphabet."""

import random
from collections import Counter
from itertools import product

import pytest

from edgeloom.operators import kernels as K


def _brute(seqs, k, m):
    letters = sorted({c for s in seqs.values() for c in s})
    words = ["".join(w) for w in product(letters, repeat=k)]
    near = lambda g, f: sum(a != b for a, b in zip(g, f)) <= m
    rows = {}
    for i, s in seqs.items():
        grams = Counter(s[p : p + k] for p in range(len(s) - k + 1))
        rows[i] = {g: sum(n for f, n in grams.items() if near(g, f)) for g in words}
    dot = lambda x, y: sum(v * y[g] for g, v in x.items())
    ids = sorted(i for i in rows if any(rows[i].values()))
    return {(a, b): dot(rows[a], rows[b]) / (dot(rows[a], rows[a]) * dot(rows[b], rows[b])) ** 0.5 for n, a in enumerate(ids) for b in ids[n + 1 :]}


# Four letters give a negative weight for (4, 1) and (4, 2), so neighbours are listed; nine do not.
@pytest.mark.parametrize("letters, k, m", [("ACGT", 4, 1), ("ABCDEFGHI", 3, 1), ("ABCDEFGHI", 3, 2)])
def test_equals_all_neighbours(spark, letters, k, m):
    r = random.Random(5)
    seqs = {f"q{i}": "".join(r.choice(letters) for _ in range(r.randint(0, 14))) for i in range(14)}
    seqs["all"] = letters
    seqs["copy"] = seqs["q3"]
    frame = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    want = {p: s for p, s in _brute(seqs, k, m).items() if s >= 0.6 - 1e-9}
    got = {(x.a, x.b): x.s for x in K.mismatch_kernel(frame, k, m, 0.6).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(s) for p, s in want.items())


def test_weights_count_common_neighbours():
    from math import comb

    for k, m, letters in ((3, 1, 41), (4, 2, 20), (4, 1, 4)):
        w = K.blank_weights(k, m, letters)
        for d in range(k + 1):
            assert sum(w[j] * comb(k - d, j - d) for j in range(d, k + 1)) == K.common_neighbours(k, m, letters, d)
