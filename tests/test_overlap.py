import math
import random

import pytest

from edgeloom.operators import kernels as K
from edgeloom.operators import overlap as OV


def _sets(seed, n=60, hub=True):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        s = {f"f{rng.randrange(25)}" for _ in range(rng.randrange(1, 9))}
        if hub and i % 3:
            s.add("hub")
        out[f"e{i:02d}"] = s
    # A group of copies and sets that consist of the hub only.
    for i in range(12):
        out[f"c{i:02d}"] = {"f1", "f2", "hub"}
    out["h1"] = out["h2"] = {"hub"}
    return out


def _rows(spark, sets):
    return spark.createDataFrame([(i, f, 1) for i, s in sets.items() for f in s], "id string, f string, w long")


def _brute(sets, sim, t):
    ids = sorted(sets)
    return {(a, b): sim(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] & sets[b] and sim(sets[a], sets[b]) >= t - 1e-9}


def _same(df, want):
    got = {(r.a, r.b): r.s for r in df.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


JAC = lambda x, y: len(x & y) / len(x | y)
COS = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))


@pytest.fixture(params=["small", "usual"])
def way(request, monkeypatch):
    # Small index limits so that the fixture's features count as warm and hot.
    index = OV.index_rows
    monkeypatch.setattr(OV, "POSTING", 3)
    if request.param == "usual":
        return
    monkeypatch.setattr(OV, "index_rows", lambda rows, need, n_rows=None: index(rows, need, cold=2, warm=16))


@pytest.mark.parametrize("t", [0.2, 0.5, 0.9])
def test_jaccard(spark, way, t):
    s = _sets(1)
    _same(K.jaccard(_rows(spark, s), t), _brute(s, JAC, t))


@pytest.mark.parametrize("t", [0.3, 0.75])
def test_cosine(spark, way, t):
    s = _sets(2)
    _same(K.cosine_binary(_rows(spark, s), t), _brute(s, COS, t))


@pytest.mark.parametrize("t", [0.4, 0.8])
def test_gip(spark, way, t):
    s = _sets(3)
    gamma = len(s) / sum(len(x) for x in s.values())
    _same(K.gip(_rows(spark, s), t), _brute(s, lambda x, y: math.exp(-gamma * len(x ^ y)), t))


@pytest.mark.parametrize("t", [0.3, 0.7])
def test_weighted_and_counts(spark, way, t):
    rng = random.Random(4)
    vec = {i: {f: rng.randrange(1, 6) for f in s} for i, s in _sets(4).items()}
    rows = spark.createDataFrame([(i, f, c) for i, v in vec.items() for f, c in v.items()], "id string, f string, c long")

    def pairs(sim):
        ids = sorted(vec)
        values = {(a, b): sim(vec[a], vec[b]) for i, a in enumerate(ids) for b in ids[i + 1:]}
        return {k: v for k, v in values.items() if v >= t - 1e-9 and v > 0}

    norm = lambda v: math.sqrt(sum(c * c for c in v.values()))
    _same(K.cosine_weighted(rows.withColumnRenamed("c", "w"), t), pairs(lambda x, y: sum(c * y.get(f, 0) for f, c in x.items()) / norm(x) / norm(y)))
    _same(K.dice_counts(rows, t), pairs(lambda x, y: 2 * sum(min(c, y.get(f, 0)) for f, c in x.items()) / (sum(x.values()) + sum(y.values()))))


@pytest.mark.parametrize("k", [1, 3, 20])
def test_knn_over_folded_copies(spark, k):
    s = _sets(5)
    rows, members = OV.fold_copies(_rows(spark, s))
    assert rows.select("id").distinct().count() == len({frozenset(x) for x in s.values()})
    got = {}
    for r in OV.expand_knn(K.jaccard(rows, 0.3), members, k).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for a in s:
        near = sorted(((-JAC(s[a], s[b]), b) for b in s if b != a and JAC(s[a], s[b]) >= 0.3 - 1e-9))[:k]
        assert [d for _, d in sorted(got.get(a, []))] == [b for _, b in near]


@pytest.mark.parametrize("k, caps", [(1, (2, 6, None)), (5, (4, None)), (100, (1024, None))])
def test_knn_is_exact_and_never_short(spark, monkeypatch, k, caps):
    monkeypatch.setattr(OV, "POSTING", 3)
    s = _sets(7, n=30)
    s |= {f"lone{i}": {f"own{i}"} for i in range(4)} | {f"z{i:02d}": {"hub"} for i in range(20)}  # some share nothing, a third are the hub alone
    got = {}
    for r in OV.knn(_rows(spark, s), k, caps).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, round(r.s, 9)))
    for a in s:
        near = sorted((-JAC(s[a], s[b]), b) for b in s if b != a)[:k]
        # Fillers that share nothing come from the 2 k + 1 smallest ids.
        assert [(d, v) for _, d, v in sorted(got[a])] == [(b, round(-v, 9)) for v, b in near]


def test_partitioning_does_not_matter(spark):
    s = _sets(6)
    a = {tuple(r) for r in K.jaccard(_rows(spark, s).repartition(1), 0.4).collect()}
    b = {tuple(r) for r in K.jaccard(_rows(spark, s).repartition(13, "f"), 0.4).collect()}
    assert a == b


def test_impute_and_ic(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "src string, dst string")
    sim = spark.createDataFrame([("a", "c", 0.5), ("b", "c", 0.25)], "a string, b string, s double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out = {(r.src, r.dst): r.v for r in K.impute_profiles(edges, sim, nodes).collect()}
    assert out["c", "x"] == pytest.approx(1.0) and out["c", "y"] == pytest.approx(2 / 3) and len(out) == 5


def test_minmax_constant_column(spark):
    m = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 2.0), ("a", "y", 1.0), ("b", "y", 3.0)], "i string, j string, v double")
    out = {(r.i, r.j): r.v for r in K.minmax_columns(m).collect()}
    assert out == {("a", "x"): 0.0, ("b", "x"): 0.0, ("a", "y"): 0.0, ("b", "y"): 1.0}


@pytest.mark.parametrize("blocks", [False, True])
def test_index_and_blocks_agree_with_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(OV, "meets_in_blocks", lambda x: blocks)
    whole = OV.block_overlaps
    monkeypatch.setattr(OV, "block_overlaps", lambda rows, need: whole(rows, need, size=23))
    monkeypatch.setattr(OV, "COLUMNS", 5)
    sets = _sets(11)
    _same(K.jaccard(_rows(spark, sets), 0.3), _brute(sets, JAC, 0.3))
    _same(K.cosine_binary(_rows(spark, sets), 0.5), _brute(sets, COS, 0.5))
    rng = random.Random(5)
    counts = {i: {f: rng.randrange(1, 6) for f in s} for i, s in sets.items()}
    table = spark.createDataFrame([(i, f, c) for i, s in counts.items() for f, c in s.items()], "id string, f string, c long")
    dice = lambda x, y: 2 * sum(min(x[f], y[f]) for f in x.keys() & y.keys()) / (sum(x.values()) + sum(y.values()))
    cos = lambda x, y: sum(x[f] * y[f] for f in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    ids = sorted(counts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]]
    for kernel, sim, t in ((K.dice_counts(table, 0.6), dice, 0.6), (K.cosine_weighted(table.withColumnRenamed("c", "w"), 0.7), cos, 0.7)):
        _same(kernel, {(a, b): sim(counts[a], counts[b]) for a, b in pairs if sim(counts[a], counts[b]) >= t - 1e-9})


def test_dense_rows_meet_in_blocks_and_sparse_ones_by_the_index(spark):
    dense = {f"d{i:03d}": {f"f{j}" for j in range(40) if (i * 7 + j * j) % 3} for i in range(90)}
    sparse = {f"s{i:04d}": {f"g{i // 2}", f"u{i}"} for i in range(3000)}
    assert OV.meets_in_blocks(OV.index_rows(_rows(spark, dense), OV.jaccard_at(0.4)))
    assert not OV.meets_in_blocks(OV.index_rows(_rows(spark, sparse), OV.jaccard_at(0.4)))
    _same(K.jaccard(_rows(spark, dense), 0.4), _brute(dense, JAC, 0.4))


def test_tasks_grow_with_the_meetings(spark, monkeypatch):
    """However many rows meet, a task adds up about as many meetings as it is given."""
    s, t = _sets(9), 0.2
    parts, kept = [], OV.checkpointed
    monkeypatch.setattr(OV, "meets_in_blocks", lambda x: False)
    monkeypatch.setattr(OV, "TASK_MEETINGS", 200)
    monkeypatch.setattr(OV, "checkpointed", lambda df: parts.append(df.rdd.getNumPartitions()) or kept(df))
    _same(K.jaccard(_rows(spark, s), t), _brute(s, JAC, t))
    assert max(parts) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_without_a_shuffle(spark):
    """However many blocks a row meets, it is shuffled once, into its own block."""
    dense = {f"d{i:03d}": {f"f{j}" for j in range(40) if (i * 7 + j * j) % 3} for i in range(90)}
    pairs = OV.block_overlaps(_rows(spark, dense), OV.jaccard_at(0.4), size=7)
    assert "Exchange" not in _plan(pairs) and "CartesianProduct" in _plan(pairs)
    _same(pairs.selectExpr("a", "b", "overlap / (na + nb - overlap) AS s"), _brute(dense, JAC, 0.4))


@pytest.mark.parametrize("entry", [0, 1e18])
@pytest.mark.parametrize("lookup", [0, 2048, 1e18])
@pytest.mark.parametrize("need", [OV.cosine_sets_at(0.5), OV.dice_counts_at(0.5), OV.within_distance(6.0)])
def test_block_pairs_finish_what_no_product_was_made_of(monkeypatch, entry, lookup, need):
    """Stopping after the first columns, never, or where it pays gives the same pairs."""
    import numpy as np

    monkeypatch.setattr(OV, "COLUMNS", 4)
    monkeypatch.setattr(OV, "LOOKUP", lookup)
    monkeypatch.setattr(OV, "ENTRY", entry)
    monkeypatch.setattr(OV, "PASS", -1)
    monkeypatch.setattr(OV, "MET", 50)
    monkeypatch.setattr(OV, "PAIRS", 9)
    rng = np.random.default_rng(3)

    def block(n):
        rows = [np.sort(rng.choice(30, rng.integers(0, 9), replace=False)) for _ in range(n)]
        ws = [np.sqrt(rng.integers(1, 4, len(r))) if not need.product else np.ones(len(r)) for r in rows]
        side = {"lens": np.array([len(r) for r in rows]), "fs": np.concatenate(rows), "ws": np.concatenate(ws)}
        return side | {"n": np.array([float((w * w).sum()) for w in ws])}, [dict(zip(r.tolist(), w.tolist())) for r, w in zip(rows, ws)]

    (xs, left), (ys, right) = block(40), block(25)
    term = (lambda p, q: p * q) if need.product else (lambda p, q: min(p * p, q * q))
    want = {}
    for r, x in enumerate(left):
        for c, y in enumerate(right):
            o = sum(term(w, y[f]) for f, w in x.items() if f in y)
            n = sorted([xs["n"][r], ys["n"][c]])
            if o > 0 and o >= need.reach(np.array(n[0]), np.array(n[1])) - 1e-9:
                want[r, c] = pytest.approx(o)
    r, c, value = OV._block_pairs(xs, ys, need)
    assert want and dict(zip(zip(r.tolist(), c.tolist()), value.tolist())) == want and len(r) == len(want)


def test_plan_of_a_large_table_is_chosen_by_some_ids(spark, monkeypatch):
    """The marks of all rows are not made where the rows meet in blocks, and the pairs are the same."""
    s = {f"d{i:03d}": {f"f{j}" for j in range(40) if (i * 7 + j * j) % 3} for i in range(90)}
    made, index = [], OV.index_rows
    monkeypatch.setattr(OV, "INDEXED", 500)
    monkeypatch.setattr(OV, "index_rows", lambda rows, need, **more: made.append(rows.count()) or index(rows, need, **more))
    _same(K.jaccard(_rows(spark, s), 0.4), _brute(s, JAC, 0.4))
    assert len(made) == 1 and made[0] < sum(map(len, s.values())) / 2


def test_counts_and_blanks_of_sequences_are_dealt_once(spark):
    seq = spark.createDataFrame([("a", "abcabc"), ("b", "abd")], "id string, seq string")
    rows = K.unit_rows(K.blanked_rows(K.kmer_counts(seq, 3, ways=8), 3, [1, 1, 1, 1]))
    dealt = [line for line in _plan(K.blanked_rows(K.kmer_counts(seq, 3, ways=8), 3, [1, 1, 1, 1])).split("\n") if "Exchange" in line]
    assert len(dealt) == 1 and rows.groupBy("id").count().count() == 2


def test_sparse_rows_that_meet_often_go_into_blocks(spark):
    """Thirty of many features a row: the index lists each pair more than once, while few entries of two blocks meet."""
    rng = random.Random(8)
    x = [(f"r{i:03d}", f"f{f}", 1) for i in range(600) for f in rng.sample(range(3000), 30)]
    rows = spark.createDataFrame(x, "id string, f string, w long")
    assert OV.meets_in_blocks(OV.index_rows(rows, OV.jaccard_at(0.05)))
