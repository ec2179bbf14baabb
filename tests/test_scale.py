import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions.hashing import digest_bucket, order_key
from edgeloom.operators import scale as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    # Group "hot" holds a third of the rows.
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(20)}", i, float(rng.randrange(40))) for i in range(900)]
    return spark.createDataFrame(data, "g string, i long, v double").repartition(5)


def test_ranked_equals_sorting(rows):
    x = rows.withColumn("k", order_key(3, "g", "i"))
    out = S.ranked(x, ["g"], ["k"], digest_bucket(F.col("k")), "r").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append((r.k, r.r))
    assert len(out) == 900
    for members in groups.values():
        assert [r for _, r in sorted(members)] == list(range(1, len(members) + 1))


def test_ranked_by_value_with_ties(rows):
    out = S.ranked_by_value(rows, ["g"], "v", order_key(0, "i")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append((r["rank"], r.v))
    for members in groups.values():
        members.sort()
        assert [k for k, _ in members] == list(range(1, len(members) + 1))
        assert [v for _, v in members] == sorted((v for _, v in members), reverse=True)


def test_running_sum(rows):
    at = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    cuts = S.cut_points(rows, "v", 8)
    out = S.running_sum(at, ["g"], ["v"], S.range_bucket(F.col("v"), cuts), {"upto": F.col("n")}).collect()
    for r in out:
        assert r.upto == sum(o.n for o in out if o.g == r.g and o.v <= r.v)


def test_dense_index_is_sorted_and_gapless(spark):
    ids = [f"id{i:04d}" for i in range(257)] * 2
    df = spark.createDataFrame([(x,) for x in ids], "x string").repartition(7)
    out = S.dense_index(df, "x").collect()
    assert [r.x for r in sorted(out, key=lambda r: r.idx)] == sorted(set(ids))
    assert sorted(r.idx for r in out) == list(range(257))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("g1", 3), ("g5", 4)], "g string, w int")
    plain = sorted(map(str, rows.join(right, ["g"], how).collect()))
    salted = sorted(map(str, S.salted_join(rows, right, ["g"], how, hot_rows=50).select(rows.join(right, ["g"], how).columns).collect()))
    assert plain == salted


def test_checkpoint_needs_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    class Frame:
        sparkSession = Session

    with pytest.raises(RuntimeError):
        S.checkpointed(Frame)


def test_symbol_overlap_deals_its_rows_to_more_tasks(spark, monkeypatch):
    from edgeloom.operators import edges as E

    rng = random.Random(7)
    syms = {(rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(12)])) for _ in range(60)}
    rows = {(rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for _ in range(40)}
    want = {(min(p, q), max(p, q)) for p, s in syms for x, y in rows for q, t in syms if None not in (s, t, p, q) and (s, t) == (x, y) and p != q}
    monkeypatch.setattr(E, "TASK_ROWS", 5, raising=False)
    got = E.symbol_overlap(spark.createDataFrame([*syms] * 2, "id string, sym int"), spark.createDataFrame([*rows] * 2, "sym1 int, sym2 int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() > 8


def test_annotation_ic_sends_lists_and_deals_them_to_more_tasks(spark, monkeypatch):
    from math import log

    from edgeloom.operators import kernels as K
    from edgeloom.operators import overlap as OV

    rng = random.Random(8)
    terms = {(rng.choice([None, *(f"d{i}" for i in range(20))]), f"t{rng.randrange(30)}") for _ in range(60)}
    closure = {(f"t{i}", f"t{i}") for i in range(30)} | {(f"t{i}", f"g{i % 9}") for i in range(30)}
    full = {(d, a) for d, t in terms for u, a in closure if t == u}
    n, df = len({d for d, _ in full} - {None}), {}
    for _, a in full:
        df[a] = df.get(a, 0) + 1
    rare = [(d, -log(df[a] / n), a) for d, a in full if -log(df[a] / n) >= 0.8]
    own, want = {}, {}
    for d, ic, _ in rare:
        own[d] = max(own.get(d, 0), ic)
    for d, ic, a in rare:
        for e, _, b in rare:
            if a == b and d != e and None not in (d, e):
                want[d, e] = max(want.get((d, e), 0), round(ic / own[d], 9))
    monkeypatch.setattr(OV, "TASK_MEETINGS", 4)
    got = K.annotation_ic(spark.createDataFrame([*terms], "id string, term string"), spark.createDataFrame([*closure], "term string, ancestor string"), 0.8)
    assert {(r.a, r.b): round(r.s, 9) for r in got.collect()} == want and len(want) > 20
    assert got.rdd.getNumPartitions() > 8


def test_annotation_ic_pairs_frequent_terms_in_blocks(spark, monkeypatch):
    """Ids that share many terms, most of them frequent: every pair that shares any term, by blocks and by lists alike."""
    from math import isnan, log

    from edgeloom.operators import kernels as K

    rng = random.Random(9)
    terms = {(rng.choice([None, *(f"d{i}" for i in range(300))]), f"t{rng.randrange(40)}") for _ in range(2500)} | {("lone", "t0"), ("other", "t99")}
    closure = {(f"t{i}", f"t{i}") for i in range(40)} | {(f"t{i}", f"g{i % 3}") for i in range(40)} | {(f"t{i}", "all") for i in range(40)} | {("t1", None), ("t99", "t99")}
    full = {(d, a) for d, t in terms for u, a in closure if t == u}
    n, df = len({d for d, _ in full} - {None}), {}
    for _, a in full:
        df[a] = df.get(a, 0) + 1
    held, want = {}, {}
    for d, a in full:
        if None not in (d, a):
            held.setdefault(d, {})[a] = -log(df[a] / n)
    for d, x in held.items():
        for e, y in held.items():
            if d != e and x.keys() & y.keys():
                want[d, e] = round(max(x[a] for a in x.keys() & y.keys()) / max(x.values()), 9)
    frames = spark.createDataFrame([*terms], "id string, term string"), spark.createDataFrame([*closure], "term string, ancestor string")
    monkeypatch.setattr(K, "MANY", 300)
    for shared in (0.0, 1e9):
        monkeypatch.setattr(K, "SHARED", shared)
        got = K.annotation_ic(*frames).collect()
        assert {(r.a, r.b): round(r.s, 9) for r in got} == want and len(got) == len(want) > 80_000
    one = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, term string"), spark.createDataFrame([("t", "t")], "term string, ancestor string")
    for shared in (0.0, 1e9):
        monkeypatch.setattr(K, "SHARED", shared)
        assert [isnan(r.s) for r in K.annotation_ic(*one).collect()] == [True, True]
        assert K.annotation_ic(one[0].limit(0), one[1]).collect() == []
