"""Near-duplicate embeddings against a comparison of all pairs."""

import math

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, gid int, vec string, n int, root string, least string, dims string"


def plain(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = [[] for _ in rows]
    for p, a in enumerate(ok):
        for b in ok[p + 1 :]:
            if len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in (a, b))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for i in range(len(rows)):
        group, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - group
            group |= new
            todo += new
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, least == rows[i][0]))
    return sorted(out, key=str)


def sample():
    """Tight and wide groups, lone vectors, and all that cannot link."""
    r, rows = np.random.default_rng(3), []
    for size, spread in ((60, 0.2), (40, 0.35), (5, 0.1), (3, 0.1), (90, 0.45)):
        base = r.standard_normal(16)
        rows += [(len(rows) + k, (base + r.standard_normal(16) * spread).tolist()) for k in range(size)]
    rows += [(len(rows) + k, r.standard_normal(16).tolist()) for k in range(100)]
    one = [1.0] * 15
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [math.nan] + one), (904, [None] + one), (905, [math.inf] + one), (906, rows[0][1]), (906, rows[0][1])]
    return rows + [(None, rows[0][1]), (None, [9.0] * 3), (None, [9.0] * 3), (907, [1e-200] * 3), (908, [-0.0, 1.0]), (909, [0.0, 2.0]), (3, rows[70][1]), (910, [1e200] * 16)]


@pytest.fixture(scope="module")
def table(spark):
    rows = sample()
    return rows, spark.createDataFrame([(*r, 1, "v", 2, "r", "l", "d") for r in rows], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("settings", [{}, {"block": 8}])
def test_equals_all_pairs(table, settings):
    from edgeloom.llm.vectors import near_vectors

    assert sorted([tuple(r) for r in near_vectors(table[1], **settings).collect()], key=str) == plain(table[0])


def test_narrow_windows_find_nearly_all_links_at_the_threshold(spark):
    from edgeloom.llm.vectors import near_vectors

    r, pairs = np.random.default_rng(5), []
    for _ in range(150):  # pairs of cosine 0.905
        x, y = r.standard_normal((2, 24))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        pairs += [x, 0.905 * x + math.sqrt(1 - 0.905**2) * y / np.linalg.norm(y)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    got = {v: n for v, n in near_vectors(df, window=8, recall=0.97).select("vec_id", "n_links").collect()}
    assert np.mean([got[i] == 1 for i in range(300)]) >= 0.9


def test_empty_table(spark, table):
    from edgeloom.llm.vectors import near_vectors

    assert near_vectors(spark.createDataFrame([], table[1].schema)).collect() == []
