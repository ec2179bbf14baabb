"""Small hand-computed cases: ties, empties, NULL and boundary values."""

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import cleaning as C
from edgeloom.operators import edges as E
from edgeloom.operators import evaluate as V
from edgeloom.operators import idmap as M
from edgeloom.operators import learn as L
from edgeloom.operators import rank as R
from edgeloom.operators import stats as A


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_cleaning(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (None,)], "y double")
    assert [r.label for r in C.binarize(df, "y").collect()] == [1, 0, 0]
    assert _one(spark, ">10.5", C.parse_qualified("x")) == 10.5 and _one(spark, "n/a", C.parse_qualified("x")) is None
    assert _one(spark, "CID100000085", C.normalize_id("x", r"^CID\d0*")) == "85"
    assert _one(spark, "CIDm00002244", C.extract_id("x")) == "2244" and _one(spark, "CIDs00002244", C.extract_id("x")) is None
    assert _one(spark, "ASPIRIN (ACID) 500 MG, TABLETS", C.clean_name("x", ["MG", "TABLETS"])) == "ASPIRIN"
    assert _one(spark, "hsa10", C.insert_colon("x")) == "hsa:10"
    assert _one(spark, "1d 2h 3m 4s", C.parse_duration("x")) == 93784 and _one(spark, "OOT", C.parse_duration("x")) is None
    assert _one(spark, "5m", C.parse_duration("x")) == 300
    assert _one(spark, "net_a_d32_1", C.run_name_part("x", 2)) == "d32" and _one(spark, "a", C.run_name_part("x", 2)) is None
    chain = _one(spark, "A/B=1-200", C.split_chain("x"))
    assert (chain.chain, chain.start, chain.end) == ("A", 1, 200)
    assert _one(spark, "1.9 A", C.strip_unit("x")) == 1.9 and _one(spark, "-", C.strip_unit("x")) is None
    kw = spark.createDataFrame([(None, ["kinase", "gpcr"]), ("1.1", []), (None, ["x"])], "ec string, kw array<string>")
    assert [r.c for r in kw.select(C.classify("ec", "kw", ["gpcr", "kinase"]).alias("c")).collect()] == ["gpcr", "enzyme", "notAnnotated"]


def test_maps_keep_first_or_last(spark):
    m = spark.createDataFrame([("k", "late", 2), ("k", "early", 1), ("z", None, 1)], "k string, v string, ord int")
    df = spark.createDataFrame([("k",), ("q",)], "id string")
    assert [r.id for r in M.map_ids(df, "id", m, "first").orderBy(F.desc_nulls_last("id")).collect()] == ["early", None]
    assert [r.id for r in M.map_ids(df, "id", m, "last").orderBy(F.desc_nulls_last("id")).collect()] == ["late", None]


def test_two_keys(spark):
    m = spark.createDataFrame([("a", "A", 0), ("b", "B", 0)], "k string, v string, ord int")
    df = spark.createDataFrame([("a", "b"), ("a", "?"), ("?", "b"), ("?", "?")], "k1 string, k2 string")
    get = lambda mode: {(r.k1, r.k2): r.id for r in M.map_two_keys(df, "k1", "k2", m, "id", mode).collect()}
    assert get("coalesce") == {("a", "b"): "B", ("a", "?"): "A", ("?", "b"): "B", ("?", "?"): None}
    assert get("reference") == {("a", "b"): "B", ("a", "?"): None, ("?", "b"): "B", ("?", "?"): None}


def test_compose_skips_dead_ends(spark):
    a = spark.createDataFrame([("c", "s1", 1), ("c", "s2", 2), ("d", "s9", 1)], "k string, v string, ord int")
    b = spark.createDataFrame([("s1", "KEGG1"), ("s2", "KEGG2")], "k string, v string").withColumn("ord", F.lit(0))
    c = spark.createDataFrame([("KEGG1", "DB1")], "k string, v string").withColumn("ord", F.lit(0))
    assert [tuple(r) for r in M.compose_maps(a, b, c).collect()] == [("c", "DB1")]


def test_bands_exclude_their_limits(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.5, 3.0, 5.0, 19.0, 20.0, None)], "d double")
    r = A.band_shares(d, "d").first()
    assert (r.low, r.mid, r.high, r.rest) == tuple(round(100 * k / 7, 6) for k in (1, 1, 1, 4))
    near = E.band_join(spark.createDataFrame([("p", "a")], "src string, dst string"), spark.createDataFrame([("a", "b", 5.0), ("a", "c", 5.5), ("a", "e", 7.0)], "a string, b string, d double"), 5.0, 7.0)
    assert [r.cand for r in near.collect()] == ["c"]


def test_histogram_top_edge(spark):
    v = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    assert {r.bin: r.n for r in A.histogram(v, "v", 2, 0, 1).collect()} == {1: 1, 2: 2}
    assert {r.bin: r.n for r in A.histogram(v, "v", 2, scale=True).collect()} == {1: 1, 2: 2}


def test_lists_add_up(spark):
    e = spark.createDataFrame([("d1", "t1"), ("d1", "t2"), ("d2", "t3")], "src string, dst string")
    s = A.dataset_stats(e).first()
    assert (s.n_src, s.n_dst, s.n_nodes, s.n_edges, s.n_components, s.largest_component) == (2, 3, 5, 3, 2, 3)
    assert s.density == 30.0
    assert E.undirected_edge_count(E.symmetrize(e.unionByName(spark.createDataFrame([("x", "x")], e.schema)))).first().n_edges == 4


def test_matrix_checks(spark):
    rows = [("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", 0.5), ("b", "a", 0.5)]
    check = lambda r: tuple(A.matrix_checks(spark.createDataFrame(r, "a string, b string, s double")).first())
    assert check(rows) == (True, True, True)
    assert check(rows[:3]) == (True, False, True)
    assert check([("a", "a", 0.9)] + rows[1:]) == (True, True, False)


def test_ties_go_to_the_smaller_id(spark):
    sim = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("a", "d", 0.9)], "a string, b string, s double")
    assert [r.dst for r in R.knn_edges(sim, 2).filter("src = 'a'").orderBy("rank").collect()] == ["d", "b"]


def test_median(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 2.0, 9.0)] + [("y", v) for v in (5.0, 1.0, 3.0)], "g string, v double")
    assert {r.g: r.median for r in R.group_median(df, "g", "v").collect()} == {"x": 2.0, "y": 3.0}


def test_ranking_metrics_with_ties_and_one_class(spark):
    p = spark.createDataFrame([(0, 0.9, 1), (0, 0.5, 1), (0, 0.5, 0), (0, 0.1, 0), (1, 0.3, 1)], "fold int, score double, label int")
    m = {r.fold: r for r in V.ranking_metrics(p).collect()}
    assert m[0].auc == pytest.approx(0.875) and m[0].ap == pytest.approx((1 + 2 / 3) / 2) and m[1].auc is None
    assert m[0].aupr == pytest.approx((1 + (1 + 2 / 3) / 2) / 2)


def test_signed_rank(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 3.0), (4.0, 4.0), (9.0, 7.0)], "a double, b double")
    r = V.paired_signed_rank(df, "a", "b").first()
    assert (r.n, r.w_plus, r.w_minus, r.w) == (3, 5.0, 1.0, 1.0)


def test_grid_and_resume(spark):
    settings = L.grid({"d": [32, 64], "lr": [0.1]})
    assert len(settings) == 2
    done = spark.createDataFrame([(L.run_name(settings[0]), 0.5)], "run string, auc double")
    assert L.pending_runs(settings, done) == [settings[1]]
    asked = []
    evaluate = lambda s: asked.append(s) or spark.createDataFrame([(0.9,)], "auc double")
    out = L.grid_search(settings, evaluate, done)
    assert asked == [settings[1]] and out.count() == 2 and L.best_run(out).first().auc == 0.9
