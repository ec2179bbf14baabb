"""Sampling, split, learning and evaluation queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..operators import evaluate as V
from ..operators import splits as N
from ..operators.scale import checkpointed
from . import tables as T
from .registry import query
from .tables import with_views

R6 = lambda c: F.round(c, 6)


# -- negatives --------------------------------------------------------------

_DRAW = "(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) % {n})"


def _draws_sql(ratio):
    """The first ratio·degree different non-partners in the order of the draws, or in md5 order where they are many."""
    draw = _DRAW.format(key="'0|' || src || '|' || i", n="n")
    return (
        with_views("inter") + f""", tgt AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS idx FROM (SELECT DISTINCT dst FROM inter)), k AS (SELECT count(*) AS n FROM tgt),
    d AS (SELECT src, n, least({ratio} * count(*), n - count(*)) AS want, count(*) * {2 * (ratio + 1)} >= n AS many FROM inter, k GROUP BY src, n),
    dr AS (SELECT src, want, i, {draw} AS idx FROM (SELECT src, n, want, unnest(range(0, 16 * want)) AS i FROM d WHERE NOT many)),
    cand AS (SELECT src, want, dst, printf('%020d', min(i)) AS o FROM dr JOIN tgt USING (idx) GROUP BY 1, 2, 3 UNION ALL SELECT src, want, dst, md5('0|' || src || '|' || dst) FROM d, tgt WHERE many),
    free AS (SELECT src, want, dst, row_number() OVER (PARTITION BY src ORDER BY o, dst) AS r FROM cand WHERE NOT EXISTS (SELECT 1 FROM inter p WHERE p.src = cand.src AND p.dst = cand.dst))
    SELECT src, dst FROM free WHERE r <= want"""
    )


for _ratio in (1, 10):

    @query(f"negatives_per_drug_{_ratio}", _draws_sql(_ratio))
    def _(spark, sf, ratio=_ratio):
        pos = checkpointed(T.interactions(spark, sf))
        return N.negatives_per_drug(pos, pos.select("dst"), ratio)


@query(
    "negatives_global",
    with_views("inter") + f""", s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i FROM (SELECT DISTINCT src FROM inter)), t AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS j FROM (SELECT DISTINCT dst FROM inter)),
    k AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM inter) AS m),
    pick AS (SELECT p, {_DRAW.format(key="'0s|' || p", n="ns")} AS i, {_DRAW.format(key="'0t|' || p", n="nt")} AS j FROM (SELECT *, unnest(range(0, 8 * m)) AS p FROM k)),
    free AS (SELECT src, dst, lpad(CAST(min(p) AS VARCHAR), 20, '0') AS o FROM pick JOIN s USING (i) JOIN t USING (j) WHERE NOT EXISTS (SELECT 1 FROM inter q WHERE q.src = s.src AND q.dst = t.dst) GROUP BY 1, 2),
    dense AS (SELECT src, dst, md5('0|' || src || '|' || dst) AS o FROM s, t WHERE NOT EXISTS (SELECT 1 FROM inter q WHERE q.src = s.src AND q.dst = t.dst)),
    either AS (SELECT free.* FROM free, k WHERE 2 * (least(m, ns * nt - m) + m) < ns * nt UNION ALL SELECT dense.* FROM dense, k WHERE 2 * (least(m, ns * nt - m) + m) >= ns * nt)
    SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY o, src, dst) AS r FROM either), k WHERE r <= m""",
)
def _(spark, sf):
    return N.negatives_global(T.interactions(spark, sf))


@query("all_negatives", with_views("affinity", "inter") + "SELECT DISTINCT src, dst FROM affinity EXCEPT SELECT src, dst FROM inter")
def _(spark, sf):
    return N.all_negatives(T.affinity(spark, sf).select("src", "dst").distinct(), T.interactions(spark, sf))


@query("negatives_by_distance")
def _(spark, sf):
    return N.negatives_by_distance(T.interactions(spark, sf), T.target_distance(spark, sf), 2.5, 4.6)


@query(
    "negatives_nearest",
    with_views("inter", "dist") + """, m AS (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist)
    SELECT src, dst, neg, d FROM (SELECT s.src, s.dst, m.b AS neg, m.d, row_number() OVER (PARTITION BY s.src, s.dst ORDER BY m.d, m.b) AS r FROM inter s JOIN m ON s.dst = m.a
    WHERE NOT EXISTS (SELECT 1 FROM inter p WHERE p.src = s.src AND p.dst = m.b)) WHERE r = 1""",
)
def _(spark, sf):
    return N.negatives_nearest(T.interactions(spark, sf), T.target_distance(spark, sf))


@query(
    "final_negatives",
    with_views("inter", "dist") + """, m AS (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist), c AS (SELECT DISTINCT i.src, m.b AS dst FROM inter i JOIN m ON i.dst = m.a WHERE d > 2.5 AND d < 5),
    f AS (SELECT src, dst, md5('0|' || src || '|' || dst) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM inter p WHERE p.src = c.src AND p.dst = c.dst)), o AS (SELECT src, arg_min(dst, k) AS dst, min(k) AS k FROM f GROUP BY 1)
    SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY k, src) AS r FROM o) WHERE r <= (SELECT count(*) // 2 FROM (SELECT src FROM inter GROUP BY 1 HAVING count(*) > 2))""",
)
def _(spark, sf):
    """As many as half of the drugs that may give a positive away."""
    pos = checkpointed(T.interactions(spark, sf))
    n = pos.groupBy("src").count().filter("count > 2").count()
    return N.final_negatives(pos, T.target_distance(spark, sf), n=n // 2)


@query("holdout_final")
def _(spark, sf):
    return N.holdout_final(T.interactions(spark, sf))


@query("negative_coverage", "SELECT count(DISTINCT dst) AS n_used, round(100.0 * count(DISTINCT dst) / (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity < 30), 2) AS percent FROM (" + _draws_sql(1) + ")")
def _(spark, sf):
    pos = checkpointed(T.interactions(spark, sf))
    return V.negative_coverage(N.negatives_per_drug(pos, pos.select("dst")), pos)


# -- folds ------------------------------------------------------------------

@query("kfold", with_views("folds") + "SELECT seed, src, dst, label, fold FROM folds")
def _(spark, sf):
    return T.labelled_folds(spark, sf)


@query("kfold_stratified", with_views("lab") + "SELECT src, dst, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('0|' || src || '|' || dst), src, dst) - 1) % 10 AS INTEGER) AS fold FROM lab")
def _(spark, sf):
    return N.kfold(T.labelled_pairs(spark, sf), 10, stratify="label")


@query("kfold_contiguous", with_views("lab") + "SELECT src, dst, label, CAST(least((row_number() OVER (ORDER BY md5('0|' || src || '|' || dst), src, dst) - 1) // (SELECT count(*) // 10 FROM lab), 9) AS INTEGER) AS fold FROM lab")
def _(spark, sf):
    return N.kfold_contiguous(T.labelled_pairs(spark, sf), 10)


@query("kfold_drugs", with_views("lab") + ", d AS (SELECT src, CAST((row_number() OVER (ORDER BY md5('0|' || src), src) - 1) % 100 AS INTEGER) AS fold FROM (SELECT DISTINCT src FROM lab)) SELECT src, dst, label, fold FROM lab JOIN d USING (src)")
def _(spark, sf):
    return N.kfold_entity(T.labelled_pairs(spark, sf), "src", 100)


_SP = ", sp AS (SELECT src, dst, label, CAST((row_number() OVER (ORDER BY md5('0|' || src), src, md5('0|' || src || '|' || dst), dst) - 1) % {n} AS INTEGER) AS fold FROM lab) "


@query("folds_sp", with_views("lab") + _SP.format(n=10) + "SELECT src, dst, label, fold FROM sp")
def _(spark, sf):
    return N.folds_sp(T.labelled_pairs(spark, sf))


for _name, _side in (("folds_sd", "src"), ("folds_st", "dst")):

    @query(
        _name,
        with_views("lab") + f", d AS (SELECT {_side}, CAST((row_number() OVER (ORDER BY n DESC, md5('0|' || {_side})) - 1) % 10 AS INTEGER) AS fold FROM (SELECT {_side}, count(*) AS n FROM lab GROUP BY 1)) SELECT src, dst, label, fold FROM lab JOIN d USING ({_side})",
    )
    def _(spark, sf, name=_name):
        return getattr(N, name)(T.labelled_pairs(spark, sf))


@query(
    "train_val_test",
    with_views("lab") + _SP.format(n=5) + "SELECT src, dst, label, CASE WHEN fold = 0 THEN 'test' WHEN CAST('0x' || substr(md5('val0|' || src || '|' || dst), 1, 7) AS BIGINT) / 268435456.0 < 0.125 THEN 'val' ELSE 'train' END AS part FROM sp",
)
def _(spark, sf):
    return N.train_val_test(T.labelled_pairs(spark, sf))


@query(
    "check_splits",
    with_views("folds") + """, s AS (SELECT seed, count(DISTINCT f) AS src_folds FROM (SELECT seed, src, min(fold) AS f FROM folds GROUP BY 1, 2 HAVING count(DISTINCT fold) = 1) GROUP BY 1),
    d AS (SELECT seed, count(DISTINCT f) AS dst_folds FROM (SELECT seed, dst, min(fold) AS f FROM folds GROUP BY 1, 2 HAVING count(DISTINCT fold) = 1) GROUP BY 1)
    SELECT seed, n_folds, src_folds, dst_folds, CASE WHEN src_folds = 0 AND dst_folds = 0 THEN 'Sp' WHEN src_folds = n_folds AND dst_folds = n_folds THEN 'Sd+St' WHEN src_folds = n_folds THEN CASE WHEN dst_folds = 0 THEN 'Sd' ELSE 'Sd, St not exact' END
    WHEN dst_folds = n_folds THEN CASE WHEN src_folds = 0 THEN 'St' ELSE 'St, Sd not exact' END ELSE 'not exact' END AS verdict FROM
    (SELECT n.seed, n_folds, COALESCE(src_folds, 0) AS src_folds, COALESCE(dst_folds, 0) AS dst_folds FROM (SELECT seed, count(DISTINCT fold) AS n_folds FROM folds GROUP BY 1) n LEFT JOIN s ON s.seed = n.seed LEFT JOIN d ON d.seed = n.seed)""",
)
def _(spark, sf):
    return N.check_splits(checkpointed(T.labelled_folds(spark, sf)))


@query(
    "fold_proportions",
    with_views("folds") + """, t AS (SELECT seed, fold, CAST(sum(label) AS BIGINT) AS test_pos, CAST(sum(1 - label) AS BIGINT) AS test_neg FROM folds GROUP BY 1, 2)
    SELECT *, CAST(sum(test_pos) OVER (PARTITION BY seed) - test_pos AS BIGINT) AS train_pos, CAST(sum(test_neg) OVER (PARTITION BY seed) - test_neg AS BIGINT) AS train_neg FROM t""",
)
def _(spark, sf):
    return N.fold_proportions(T.labelled_folds(spark, sf))


@query("cv_distribution", with_views("folds") + "SELECT seed, src, fold, count(*) AS n FROM folds GROUP BY 1, 2, 3")
def _(spark, sf):
    return N.cv_distribution(T.labelled_folds(spark, sf), "src")


@query("expand_train", with_views("folds") + "SELECT seed, src, dst, label, f AS fold, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS part, CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END AS kind FROM folds, (SELECT unnest(range(0, 10)) AS f)")
def _(spark, sf):
    return N.expand_train(T.labelled_folds(spark, sf), 10)


@query(
    "oversample",
    with_views("lab") + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || src || '|' || dst), src, dst) AS r, count(*) OVER (PARTITION BY label) AS n FROM lab),
    k AS (SELECT max(n) AS m FROM r) SELECT src, dst, label, unnest(range(1, (m - r) // n + 2)) AS "copy" FROM r, k""",
)
def _(spark, sf):
    return N.oversample(T.labelled_pairs(spark, sf))


@query("repair_left")
def _(spark, sf):
    """What no repair can spread over two folds, and how many rows of each class the repaired folds have."""
    pairs = T.labelled_pairs(spark, sf)
    folds, left = N.repair_folds(N.folds_sp(pairs), T.interactions(spark, sf))
    return left.select(F.lit("left").alias("what"), F.col("dst").alias("id"), F.lit(1).cast("long").alias("n")).unionByName(folds.groupBy(F.col("label").cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit("class").alias("what"), "id", "n"))


@query("repair_folds")
def _(spark, sf):
    pairs = T.labelled_pairs(spark, sf)
    return N.repair_folds(N.folds_sp(pairs), T.interactions(spark, sf))[0]


# -- evaluation -------------------------------------------------------------

_CELLS = "sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp"


@query("confusion", with_views("pred") + f"SELECT fold, {_CELLS} FROM pred GROUP BY 1")
def _(spark, sf):
    return V.confusion(T.predictions(spark, sf))


@query("confusion_total", with_views("pred") + f"SELECT {_CELLS} FROM pred")
def _(spark, sf):
    """Summed over the folds."""
    return V.confusion(T.predictions(spark, sf), by=())


@query("best_run", "SELECT run, auc FROM (SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS auc FROM orders GROUP BY 1) ORDER BY auc DESC, run LIMIT 1")
def _(spark, sf):
    from ..operators.learn import best_run

    return best_run(T.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("auc")))


@query(
    "ranking_metrics",
    with_views("pred") + """, g AS (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
    m AS (SELECT fold, (tp * 1.0) / (tp + fp) AS pr, CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) * 1.0 / (tp + fp - pos - neg) ELSE 1.0 END AS pb, pos FROM c),
    a AS (SELECT fold, sum(pos * pr) AS ap, sum(pos * (pr + pb) / 2) AS aupr, sum(pos) AS np FROM m GROUP BY 1),
    u AS (SELECT x.fold, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS auc FROM pred x JOIN pred y ON x.fold = y.fold AND x.label = 1 AND y.label = 0 GROUP BY 1)
    SELECT a.fold, round(auc, 6) AS auc, round(aupr / np, 6) AS aupr, round(ap / np, 6) AS ap FROM a LEFT JOIN u ON a.fold = u.fold""",
)
def _(spark, sf):
    m = V.ranking_metrics(T.predictions(spark, sf))
    return m.select("fold", *[R6(c).alias(c) for c in ("auc", "aupr", "ap")])


_PRF = with_views("pred") + f""", c AS (SELECT fold, {_CELLS} FROM pred GROUP BY 1),
p AS (SELECT *, tp + fp + fn + tn AS n, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END AS r1, CASE WHEN tn + fn > 0 THEN tn * 1.0 / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn * 1.0 / (tn + fp) ELSE 0 END AS r0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0, (tp + fn) * 1.0 / n AS w1, (tn + fp) * 1.0 / n AS w0 FROM p) """
_MIX = {"binary": ("1", "0"), "macro": ("0.5", "0.5"), "weighted": ("w1", "w0")}

for _avg, (_a, _b) in _MIX.items():

    @query(f"prf_{_avg}", _PRF + f"SELECT fold, round((tp + tn) * 1.0 / n, 6) AS accuracy, round({_a} * p1 + {_b} * p0, 6) AS precision, round({_a} * r1 + {_b} * r0, 6) AS recall, round({_a} * f1 + {_b} * f0, 6) AS f1 FROM f")
    def _(spark, sf, avg=_avg):
        m = V.prf(T.predictions(spark, sf), avg)
        return m.select("fold", *[R6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "best_threshold",
    with_views("pred") + """, g AS (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS point, sum(pos) OVER (PARTITION BY fold) AS np, sum(neg) OVER (PARTITION BY fold) AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
    r AS (SELECT fold, score, tp * 1.0 / np AS tpr, fp * 1.0 / nn AS fpr FROM c WHERE np > 0 AND nn > 0 AND point >= 5), q AS (SELECT *, tpr / (tpr + fpr) AS pr FROM r),
    s AS (SELECT *, round(2 * pr * tpr / (tpr + pr + 0.00001), 12) AS f1 FROM q)
    SELECT fold, round(score, 9) AS threshold, round(f1, 6) AS f1, round(tpr, 6) AS sensitivity, round(1 - fpr, 6) AS specificity FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, score DESC) AS k FROM s) WHERE k = 1""",
)
def _(spark, sf):
    m = V.best_threshold(T.predictions(spark, sf))
    return m.select("fold", F.round("threshold", 9).alias("threshold"), *[R6(c).alias(c) for c in ("f1", "sensitivity", "specificity")])


for _k in (10, 50):

    @query(
        f"ap_at_{_k}",
        with_views("pred") + f""", t AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, dst, src) AS r FROM pred), h AS (SELECT *, sum(label) OVER (PARTITION BY fold ORDER BY r) AS hits FROM t WHERE r <= {_k}),
    g AS (SELECT fold, sum(CASE WHEN label = 1 THEN hits * 1.0 / r ELSE 0 END) AS g FROM h GROUP BY 1), n AS (SELECT fold, sum(label) AS np FROM pred GROUP BY 1)
    SELECT n.fold, round(CASE WHEN np > 0 THEN g / least(np, {_k}) ELSE 0 END, 6) AS ap FROM n JOIN g ON n.fold = g.fold""",
    )
    def _(spark, sf, k=_k):
        return V.ap_at_k(T.predictions(spark, sf), k).withColumn("ap", R6("ap"))


@query(
    "regression_errors",
    """SELECT l_returnflag, round(avg((l_quantity - f) * (l_quantity - f)), 4) AS mse, round(median(abs(l_quantity - f)), 4) AS median_abs_error, round(1 - avg((l_quantity - f) * (l_quantity - f)) / var_pop(l_quantity), 4) AS r2
    FROM (SELECT l_returnflag, l_quantity, l_extendedprice / 2000 AS f FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 2000).alias("f"))
    m = V.regression_errors(li, "l_returnflag", "l_quantity", "f")
    return m.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("mse", "median_abs_error", "r2")])


@query(
    "paired_signed_rank",
    """SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS w FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus FROM
    (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM (SELECT l_quantity - 10 * l_linenumber AS d FROM lineitem) WHERE d <> 0))""",
)
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_quantity", (F.col("l_linenumber") * 10).cast("double").alias("ref"))
    return V.paired_signed_rank(li, "l_quantity", "ref")


# -- learning ---------------------------------------------------------------

def _labelled_vectors(spark, sf):
    e = T.embeddings(spark, sf).select("id", F.col("vec").cast("array<double>").alias("feature"), (F.col("label") < 3).cast("int").alias("label"))
    return N.kfold(e, 3, ids=("id",)).select("fold", F.col("id").alias("src"), F.lit("-").alias("dst"), "label", "feature")


@query("fit_forest")
def _(spark, sf):
    from ..operators.learn import fit_pairs

    return fit_pairs(_labelled_vectors(spark, sf), 3, "forest", numTrees=5, maxDepth=3)


@query("fit_boosted")
def _(spark, sf):
    from ..operators.learn import fit_pairs

    return fit_pairs(_labelled_vectors(spark, sf), 3, "boosted", maxIter=2, maxDepth=3)


@query("grid_search")
def _(spark, sf):
    from ..operators import learn as L

    vectors = checkpointed(_labelled_vectors(spark, sf))

    def run(setting):
        scored = L.fit_pairs(vectors, 3, "forest", **setting)
        return V.ranking_metrics(scored, by=()).select("auc", "aupr")

    return L.grid_search(L.grid({"numTrees": [3, 5], "maxDepth": [2]}), run)


@query("cross_dataset")
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators import learn as L

    v = checkpointed(_labelled_vectors(spark, sf)).withColumn("_x", array_to_vector("feature"))
    parts = {f"part{f}": v.filter(F.col("fold") == f) for f in (0, 1, 2)}
    fit = lambda df, seed: L._classifier("forest", seed, numTrees=3, maxDepth=3).fit(df)

    def score(model, df):
        s = model.transform(df).select(vector_to_array("probability")[1].alias("score"), "label")
        return V.ranking_metrics(s, by=()).select("auc", "aupr")

    return L.cross_dataset(parts, fit, score, seeds=(0, 1))


@query("factor_scores")
def _(spark, sf):
    from ..operators.learn import factor_scores

    e = checkpointed(T.interactions(spark, sf))
    test = e.filter(order_key(0, "src", "dst") < "1")
    return factor_scores(e.join(test, ["src", "dst"], "left_anti"), test)


@query("inductive_scores")
def _(spark, sf):
    """All pairs of one drug in ten, which the fit never sees, scored by the features of both ends."""
    from ..operators.factor import inductive_scores

    pairs = checkpointed(T.labelled_pairs(spark, sf))
    new = order_key("new", "src") < "1a"
    return inductive_scores(pairs.filter(~new), pairs.filter(new), T.drug_features(spark, sf), T.target_features(spark, sf))
