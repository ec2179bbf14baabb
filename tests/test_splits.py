import hashlib
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import splits as N


def _md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(7)
    e = {(f"d{rng.randrange(12)}", f"t{rng.randrange(30)}") for _ in range(90)}
    e |= {("hub", f"t{i}") for i in range(30)}  # a drug with every target
    e |= {("big", f"t{i}") for i in range(20)}  # more partners than non-partners
    return sorted(e)


@pytest.fixture(scope="module")
def pos(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("ratio", [1, 3])
def test_negatives_per_drug(spark, edges, pos, ratio):
    neg = [tuple(r) for r in N.negatives_per_drug(pos, pos.select("dst"), ratio).collect()]
    assert len(neg) == len(set(neg)) and not set(neg) & set(edges)
    targets = {t for _, t in edges}
    for d in {s for s, _ in edges}:
        deg = sum(1 for s, _ in edges if s == d)
        assert sum(1 for s, _ in neg if s == d) == min(len(targets) - deg, ratio * deg)
    again = {tuple(r) for r in N.negatives_per_drug(pos.repartition(11), pos.select("dst"), ratio).collect()}
    assert again == set(neg)


def test_negatives_make_few_draws_too_many(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"d{d:02d}", f"t{t:03d}") for d in range(40) for t in rng.sample(range(400), 5)]
    pos = spark.createDataFrame(rows, "src string, dst string")
    targets = spark.createDataFrame([(f"t{t:03d}",) for t in range(400)], "dst string")
    sizes, kept = [], N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: sizes.append((out := kept(df)).count()) or out)
    assert N.negatives_per_drug(pos, targets, 4).count() == 800
    assert max(sizes) < 2 * 800


def test_negatives_of_a_nameless_drug_end(spark):
    rows = [(None, "t1"), ("d1", "t1"), *((f"e{i}", f"t{i}") for i in range(30))]
    pos = spark.createDataFrame(rows, "src string, dst string")
    got = [r.src for r in N.negatives_per_drug(pos, pos.select("dst"), 1).collect()]
    assert sorted(got) == sorted(r[0] for r in rows if r[0])


def test_negatives_global(edges, pos):
    neg = [tuple(r) for r in N.negatives_global(pos, 50).collect()]
    assert len(neg) == len(set(neg)) == 50 and not set(neg) & set(edges)
    free = len({s for s, _ in edges}) * len({t for _, t in edges}) - len(edges)
    assert N.negatives_global(pos, 10_000).count() == free


@pytest.fixture(scope="module")
def distance(edges):
    rng = random.Random(9)
    ts = sorted({t for _, t in edges})
    return [(a, b, float(rng.randrange(0, 24)) / 2) for i, a in enumerate(ts) for b in ts[i + 1:]]


def test_negatives_by_distance_is_greedy(spark, edges, pos, distance):
    dist = spark.createDataFrame(distance, "a string, b string, d double")
    got = {(r.src, r.dst): r.neg for r in N.negatives_by_distance(pos, dist, 5.0, 6.5).collect()}
    near = {}
    for a, b, d in distance:
        if 5.0 < d < 6.5:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    want = {}
    for drug in {s for s, _ in edges}:
        own, used = {t for s, t in edges if s == drug}, set()
        for t in sorted(own, key=lambda t: _md5(0, drug, t)):
            for c in sorted(near.get(t, []), key=lambda c: _md5(0, drug, t, c)):
                if c not in own and c not in used:
                    used.add(c)
                    want[drug, t] = c
                    break
    assert got == want


def test_holdout_final(spark):
    rng = random.Random(3)
    e = sorted({(f"d{i}", f"t{rng.randrange(6)}") for i in range(40) for _ in range(5)} | {("lone", "t0"), ("two", "t0"), ("two", "t1")})
    held = [tuple(r) for r in N.holdout_final(spark.createDataFrame(e, "src string, dst string")).collect()]
    assert set(held) <= set(e) and len({s for s, _ in held}) == len(held) and held
    deg = {s: sum(1 for x, _ in e if x == s) for s, _ in e}
    assert all(deg[s] > 2 for s, _ in held)
    left = {t: sum(1 for x in e if x[1] == t) - sum(1 for x in held if x[1] == t) for _, t in e}
    assert all(v >= 5 for t, v in left.items() if any(x[1] == t for x in held))
    # Nobody who could still give a target away was left out.
    for s in deg:
        if deg[s] > 2 and s not in {x for x, _ in held}:
            assert all(left[t] <= 5 for x, t in e if x == s)


def test_folds_partition_the_pairs(pos, edges):
    for make in (N.folds_sp, N.folds_sd, N.folds_st):
        rows = make(pos, 5).collect()
        assert sorted((r.src, r.dst) for r in rows) == edges
        if make is N.folds_sp:
            sizes = [sum(1 for r in rows if r.fold == f) for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
        else:
            side = "src" if make is N.folds_sd else "dst"
            assert all(len({r.fold for r in rows if r[side] == x}) == 1 for x in {r[side] for r in rows})


def _labelled(spark, pos):
    neg = N.negatives_per_drug(pos, pos.select("dst"), 1)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


@pytest.mark.parametrize("mode", ["Sp", "Sd", "St"])
def test_repair_folds(spark, mode):
    rng = random.Random(5)
    e = sorted({(f"d{rng.randrange(30)}", f"t{min(rng.randrange(60), rng.randrange(60))}") for _ in range(160)})
    p = spark.createDataFrame(e, "src string, dst string")
    make = {"Sp": N.folds_sp, "Sd": N.folds_sd, "St": N.folds_st}[mode]
    before = make(_labelled(spark, p), 5)
    entity = "src" if mode == "St" else "dst"
    lone = N.fold_spread(before, entity).filter("n_folds = 1").count()
    after, left = N.repair_folds(before, p, mode)
    rows = after.collect()
    assert len(rows) == before.count() and len({(r.src, r.dst) for r in rows}) == len(rows)
    assert not {(r.src, r.dst) for r in rows if r.label == 0} & set(e)
    assert {(r.src, r.dst) for r in rows if r.label == 1} == set(e)
    assert left.count() < lone or lone == 0
    if mode != "Sp":
        side = "dst" if mode == "St" else "src"
        assert N.fold_spread(after, side).filter("n_folds > 1").count() == 0


def test_repair_leaves_only_what_no_offer_fits(spark):
    # Targets u0…u3 sit in one fold; only the last drug's negatives can still be given to them, all others are partners.
    drugs = [f"d{i}" for i in range(8)]
    rows = [(i % 3, d, f"t{j}", 0) for i, d in enumerate(drugs) for j in range(2)] + [((i + 1) % 3, d, f"t{j}", 0) for i, d in enumerate(drugs) for j in range(2, 4)]
    rows += [((i + 2) % 3, d, f"t{4 + j}", 0) for i, d in enumerate(drugs) for j in range(2)]
    rows += [(0, f"own{n}", f"u{n}", 1) for n in range(4)]
    pos = [(f"own{n}", f"u{n}") for n in range(4)] + [(d, f"u{n}") for d in drugs[:-1] for n in range(3)] + [(d, "u3") for d in drugs]
    before = spark.createDataFrame(rows, "fold int, src string, dst string, label int")
    after, left = N.repair_folds(before, spark.createDataFrame(pos, "src string, dst string"))
    assert [r.dst for r in left.filter("dst like 'u%'").collect()] == ["u3"]
    assert not {(r.src, r.dst) for r in after.filter("label = 0").collect()} & set(pos)


def test_repair_of_a_single_fold_returns_all(spark):
    one = spark.createDataFrame([(0, "a", "x", 1), (0, "b", "y", 0)], "fold int, src string, dst string, label int")
    after, left = N.repair_folds(one, one.filter("label = 1"))
    assert after.count() == 2 and sorted(r.dst for r in left.collect()) == ["x", "y"]


def test_check_splits_names_the_setting(spark, pos):
    lab = _labelled(spark, pos)
    assert N.check_splits(N.folds_sd(lab, 5).withColumn("seed", F.lit(0))).first().verdict.startswith("Sd")
    assert N.check_splits(N.folds_st(lab, 5).withColumn("seed", F.lit(0))).first().verdict.startswith("St")
    full = spark.createDataFrame([(f, f"d{d}", f"t{t}", 1, 0) for f in (0, 1) for d in (0, 1) for t in (0, 1)], "fold int, src string, dst string, label int, seed int")
    assert N.check_splits(full).first().verdict == "Sp"


def test_oversample_reaches_parity(spark):
    df = spark.createDataFrame([(f"a{i}", "x", int(i < 3)) for i in range(17)], "src string, dst string, label int")
    counts = {r.label: r["count"] for r in N.oversample(df).groupBy("label").count().collect()}
    assert counts == {0: 14, 1: 14}


def test_contiguous_remainder_goes_last(spark):
    df = spark.createDataFrame([(f"a{i}", "x") for i in range(23)], "src string, dst string")
    sizes = {r.fold: r["count"] for r in N.kfold_contiguous(df, 5).groupBy("fold").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 4, 4: 7}


def test_train_val_test_covers_all(pos, edges):
    rows = N.train_val_test(pos).collect()
    assert len(rows) == len(edges) and {r.part for r in rows} == {"train", "val", "test"}


def test_negatives_are_an_even_sample(spark):
    # 40 drugs of 3 among 100 targets: about 120 picks over 100 targets, none a partner, none repeated for a drug.
    pos = spark.createDataFrame([(f"d{i:02d}", f"t{(7 * i + j) % 100:03d}") for i in range(40) for j in range(3)], "src string, dst string")
    targets = spark.createDataFrame([(f"t{j:03d}",) for j in range(100)], "dst string")
    picks = [tuple(r) for seed in range(3) for r in N.negatives_per_drug(pos, targets, 2, seed).collect()]
    known = {tuple(r) for r in pos.collect()}
    assert len(picks) == 3 * 240 and not known & set(picks)
    use = {}
    for _, t in picks:
        use[t] = use.get(t, 0) + 1
    expected = len(picks) / 100
    assert len(use) > 95 and sum((use.get(f"t{j:03d}", 0) - expected) ** 2 / expected for j in range(100)) < 160  # chi-squared, 99 degrees
    # Drugs with most targets as partners get what is left.
    dense = spark.createDataFrame([("a", f"t{j:03d}") for j in range(97)] + [("b", "t000")], "src string, dst string")
    got = sorted(tuple(r) for r in N.negatives_per_drug(dense, targets, 1).collect())
    assert [t for d, t in got if d == "a"] == ["t097", "t098", "t099"] and len(got) == 4


def test_global_negatives_of_a_dense_network(spark):
    pairs = [(f"d{i}", f"t{j}") for i in range(5) for j in range(6)]
    got = [tuple(r) for r in N.negatives_global(spark.createDataFrame(pairs[:-4], "src string, dst string")).collect()]
    assert sorted(got) == sorted(pairs[-4:])
