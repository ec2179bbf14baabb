import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.operators import scale as S


def _df(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def _components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_chain_star_and_loops(spark, monkeypatch):
    real = S.salted_join
    monkeypatch.setattr(G, "salted_join", lambda *a, rows=None, **k: real(*a, hot_rows=10, **k))
    rng = random.Random(2)
    e = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"s{i}") for i in range(40)]
    e += [(f"r{rng.randrange(50)}", f"r{rng.randrange(50)}") for _ in range(30)] + [("solo", "solo")]
    got = {r.id: r.component for r in G.connected_components(_df(spark, e)).collect()}
    assert got == _components(e)


def test_hop_distance_is_bounded_bfs(spark):
    e = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "n3")]
    src = spark.createDataFrame([("n0",), ("absent",)], "id string")
    got = {r.id: r.hops for r in G.hop_distance(_df(spark, e), src, 3).collect()}
    assert got == {"n0": 0, "n1": 1, "n3": 1, "n2": 2, "n4": 2, "n5": 3}


def _walks(spark, edges, **kw):
    rows = G.biased_walks(spark.createDataFrame(edges, "src string, dst string, weight double"), **kw).collect()
    walks = {}
    for r in rows:
        walks.setdefault(r.walk, {})[r.step] = r.node
    return {w: [s[i] for i in sorted(s)] for w, s in walks.items()}


def test_walks_follow_edges_and_repeat(spark):
    rng = random.Random(4)
    e = sorted({(f"a{rng.randrange(8)}", f"b{rng.randrange(8)}", 1.0) for _ in range(25)})
    w = _walks(spark, e, num_walks=2, length=5)
    ok = {(a, b) for a, b, _ in e} | {(b, a) for a, b, _ in e}
    assert len(w) == 2 * len({x for p in ok for x in p})
    assert all(len(x) == 5 and all(p in ok for p in zip(x, x[1:])) for x in w.values())
    assert w == _walks(spark, e, num_walks=2, length=5)


def _law(edges, p, q):
    """Probabilities of the neighbours of v after a step from u."""
    w = {}
    for a, b, x in edges:
        for c, d in ((a, b), (b, a)):
            w.setdefault(c, {})[d] = max(w.get(c, {}).get(d, 0.0), x)

    def of(u, v):
        out = {x: k / p if x == u else k if x in w[u] else k / q for x, k in w[v].items()}
        return {x: k / sum(out.values()) for x, k in out.items()}

    return of


@pytest.mark.parametrize("p, q, cell", [(0.25, 2.0, 3), (4.0, 0.5, 256)])
def test_steps_follow_their_law(spark, p, q, cell):
    # Triangles, weights, a loop, and a hub whose neighbours fill several cells.
    e = [("u", "m", 1.0), ("u", "v", 1.0), ("v", "m", 1.0), ("m", "x", 1.0), ("m", "y", 2.0), ("m", "m", 1.5), ("x", "y", 1.0)]
    e += [("m", f"z{i}", 0.5 + i / 10) for i in range(12)] + [("u", f"z{i}", 1.0) for i in range(0, 12, 3)]
    seen = {}
    for w in _walks(spark, e, p=p, q=q, num_walks=1000, length=4, cell=cell).values():
        for u, v, x in zip(w, w[1:], w[2:]):
            seen.setdefault((u, v), {}).setdefault(x, []).append(1)
    law, square, free = _law(e, p, q), 0.0, 0
    for (u, v), found in seen.items():
        want, total = law(u, v), sum(map(len, found.values()))
        assert found.keys() <= want.keys()
        for x, share in want.items():
            if total * share > 5:
                square += (len(found.get(x, [])) - total * share) ** 2 / (total * share)
                free += 1
    assert free > 100 and square / free < 1.4


def test_walks_carry_only_their_last_nodes(spark, monkeypatch):
    from edgeloom.operators import walks as M

    longest, keep = [], M.checkpointed
    def watched(df):
        out = keep(df)
        if "path" in out.columns:
            longest.append(out.agg(F.max(F.size("path"))).first()[0])
        return out

    monkeypatch.setattr(M, "checkpointed", watched)
    e = [("a", "x", 1.0), ("b", "x", 1.0), ("b", "y", 2.0), ("a", "y", 1.0), ("c", "y", 1.0), ("c", None, 0.5)]
    w = _walks(spark, e, num_walks=8, length=15)
    assert longest and max(longest) <= M.STEPS
    # One that came to a node without a name is no walk, whatever was written of it before.
    assert 0 < len(w) < 40 and all(len(x) == 15 for x in w.values())


def test_dtdt_counts_paths(spark):
    rng = random.Random(6)
    e = sorted({(f"d{rng.randrange(9)}", f"t{rng.randrange(9)}") for _ in range(40)} | {("d0", f"t{i}") for i in range(9)})
    pairs = [(f"d{i}", f"t{j}") for i in range(9) for j in range(9)]
    got = {(r.src, r.dst): r["sum"] for r in G.dtdt_on_pairs(_df(spark, e), _df(spark, pairs)).collect()}
    s = set(e)
    for d, t in pairs:
        want = sum(1 for a, t1 in e if a == d for d2, t2 in e if t2 == t and (d2, t1) in s)
        assert got.get((d, t), 0) == want
    assert {(r.src, r.dst): r["sum"] for r in G.dtdt_on_edges(_df(spark, e)).collect()} == {k: v for k, v in got.items() if k in s}


def test_combine_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "src_vec array<double>, dst_vec array<double>")
    want = {"Concat": [1, 2, 3, 5], "Hadamard": [3, 10], "AVG": [2, 3.5], "WL1": [2, 3], "WL2": [4, 9]}
    for func, value in want.items():
        assert G.combine_vectors(df, func).first().feature == value


def test_node_vectors_follow_their_company(spark):
    import numpy as np

    from edgeloom.operators.learn import node_embeddings

    rng = np.random.default_rng(0)
    walks = [(w, s, f"{'ab'[w % 2]}{rng.integers(8)}") for w in range(60) for s in range(12)]
    out = {r.id: np.array(r.vec) for r in node_embeddings(spark.createDataFrame(walks, "walk int, step int, node string"), dim=16, window=3).collect()}
    assert set(out) == {n for _, _, n in walks} and all(abs(v @ v - 1) < 1e-9 for v in out.values())
    same = np.mean([out[x] @ out[y] for x in out for y in out if x < y and x[0] == y[0]])
    other = np.mean([out[x] @ out[y] for x in out for y in out if x[0] < y[0]])
    assert same > other + 0.3


@pytest.mark.parametrize("rank", [40, 3])
def test_leading_vectors_are_eigenvectors(spark, rank):
    import numpy as np

    from edgeloom.operators.learn import leading_vectors

    r = np.random.default_rng(0)
    a = r.standard_normal((40, rank)) * (r.random((40, rank)) < 0.5)
    a = a @ np.diag(0.7 ** np.arange(rank) * np.where(np.arange(rank) % 3, 1.0, -1.0)) @ a.T
    cells = spark.createDataFrame([(f"n{i}", f"n{j}", float(a[i, j])) for i in range(40) for j in range(40) if a[i, j]], "a string, b string, w double")
    vectors, values = leading_vectors(cells, 5, rounds=40, tol=1e-6)
    want = np.linalg.eigvalsh(a)
    want = want[np.argsort(-np.abs(want))][:5]
    got = {v.id: np.array(v.vec) for v in vectors.collect()}
    n = min(rank, 5)
    x = np.array([got.get(f"n{i}", np.zeros(len(values))) for i in range(40)])[:, :n]
    assert values[:n] == pytest.approx(want[:n], rel=1e-3)
    assert np.abs(a @ x - x * values[:n]).max() < 1e-2 * np.abs(values[0]) and np.abs(x.T @ x - np.eye(n)).max() < 1e-9


def test_cooccurrence_counts_all_pairs_within_the_window(spark):
    r = random.Random(3)
    walks = [(w, s, f"n{r.randrange(4)}") for w in range(5) for s in range(r.randrange(1, 14)) if r.random() < 0.9]
    want = {}
    for w, s, a in walks:
        for w2, s2, b in walks:
            if w == w2 and 0 < abs(s - s2) <= 3:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(x.a, x.b): x.n for x in G.cooccurrence(spark.createDataFrame(walks, "walk int, step int, node string"), 3).collect()} == want


def test_hops_without_a_bound(spark):
    e = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    got = {r.id: r.hops for r in G.hop_distance(_df(spark, e), spark.createDataFrame([("n0",)], "id string")).collect()}
    assert got == {f"n{i}": i for i in range(13)}


def test_hops_from_many_sources(spark):
    """More sources than bits of a word, loops, a hub, odd cycles, several components: breadth-first search of each."""
    rng = random.Random(8)
    e = [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(110)] + [("hub", f"s{i}") for i in range(40)]
    e += [(f"o{i}", f"o{(i + 1) % 7}") for i in range(7)] + [("solo", "solo"), ("hub", "r0"), ("s1", "hub")]
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for most in (None, 0, 2):
        want = {}
        for source in near:
            level, hops = {source}, 0
            want[source, source] = 0
            while level and hops != most:
                hops += 1
                level = {y for x in level for y in near[x] if (source, y) not in want}
                want.update({(source, y): hops for y in level})
        ids = spark.createDataFrame([(x,) for x in [*near, "hub", "absent", None]], "id string")
        got = G.hop_distance(_df(spark, e), ids, most).collect()
        assert {(r.source, r.id): r.hops for r in got} == want and len(got) == len(want)


def test_hops_without_edges(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.hop_distance(e, spark.createDataFrame([("a",)], "id string")).collect() == []


def test_walk_queries_use_the_operators_defaults(spark, monkeypatch):
    from inspect import signature

    from edgeloom.operators import learn
    from edgeloom.plans import QUERIES
    from edgeloom.plans import tables as T

    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    walks = spark.createDataFrame([("a#0", 0, "a")], "walk string, step int, node string")
    monkeypatch.setattr(T, "interactions", lambda *_: edges)
    seen = []
    for module, name in ((G, "biased_walks"), (learn, "node_embeddings")):
        def spy(*args, _f=signature(getattr(module, name)), **kw):
            bound = _f.bind(*args, **kw).arguments
            seen.append({k: v for k, v in list(bound.items())[1:] if v != _f.parameters[k].default})
            return walks
        monkeypatch.setattr(module, name, spy)
    for name in ("biased_walks", "node_embeddings"):
        QUERIES[name](spark, "")
    assert seen == [{}, {}, {}]


def test_products_travel_as_lists(spark, monkeypatch):
    """Lists of a few entries and a hub whose sums are dealt to several tasks give the plain product, nameless ends included."""
    monkeypatch.setattr(G, "LISTED", 3)
    monkeypatch.setattr(G, "TASK_PATHS", 10)
    rng = random.Random(5)
    left = [(f"i{rng.randrange(6)}", f"k{rng.randrange(8)}", float(rng.randrange(1, 5))) for _ in range(20)]
    left += [("hub", f"k{k}", 2.0) for k in range(8)] + [(None, "k1", 1.0), (None, "k2", 3.0), ("i0", None, 1.0)]
    right = [(f"k{rng.randrange(8)}", f"j{rng.randrange(12)}", float(rng.randrange(1, 5))) for _ in range(60)] + [("k1", None, 2.0), (None, "j1", 1.0)]
    want = {}
    for i, k, v in left:
        for q, j, w in right:
            if k is not None and k == q:
                want.setdefault((i, j), []).append(v * w)
    x, y = spark.createDataFrame(left, "i string, k string, v double"), spark.createDataFrame(right, "k string, j string, w double")
    got = G._product(x, y, (F.col("v"), F.col("v")), (F.col("w"), F.lit(1.0) * F.col("w"))).collect()
    assert len(got) == len(want)
    assert {(r.i, r.j): (r.sum, r.max) for r in got} == {k: (sum(v), max(v)) for k, v in want.items()}


def test_steps_of_walks_are_not_broadcast(spark):
    """Each step is two rows of one side, sized by a packed table: the spans meet by a merge join."""
    walks = [(w, s, f"n{(w * s) % 7}") for w in range(6) for s in range(12)] + [(None, 1, "x"), (7, 1, None), (7, 2, "x")]
    out = G.cooccurrence(S.checkpointed(spark.createDataFrame(walks, "walk long, step int, node string")), 3)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for w, s, a in walks:
        for v, t, b in walks:
            if w is not None and w == v and 0 < abs(t - s) <= 3:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.n for r in out.collect()} == want


def test_information_of_walks_does_not_broadcast_their_steps(spark, tmp_path):
    """The registered query, up to the counts: nothing that is as long as the walks is broadcast."""
    from datetime import datetime, timedelta

    from edgeloom.plans import QUERIES

    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(minutes=i % 17), i % 5, "ab"[i % 2], f'{{"k": {i % 4}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    counts = QUERIES["cooccurrence"](spark, str(tmp_path))
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    n = {(r.a, r.b): r.n for r in counts.collect()}
    own, total = {}, sum(n.values())
    for (a, _), c in n.items():
        own[a] = own.get(a, 0) + c
    from math import log

    want = {p: round(log(c * total / (own[p[0]] * own[p[1]])), 6) for p, c in n.items() if c * total > own[p[0]] * own[p[1]]}
    got = {(r.a, r.b): r.w for r in QUERIES["positive_information"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want) and want
