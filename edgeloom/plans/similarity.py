"""Kernel, graph and feature queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import graph as G
from ..operators import kernels as K
from ..operators import overlap as OV
from ..operators import rank as R
from ..operators.scale import checkpointed
from . import tables as T
from .registry import query
from .tables import with_views

R6 = lambda c: F.round(c, 6)


def _rounded(df):
    return df.select("a", "b", R6("s").alias("s"))


# -- set kernels ------------------------------------------------------------

@query("jaccard_targets", with_views("tsim") + "SELECT a, b, round(s, 6) AS s FROM tsim")
def _(spark, sf):
    return _rounded(T.target_similarity(spark, sf))


def _set_sql(view, node, feature, value, at):
    return (
        with_views(view) + f"SELECT a, b, round({value}, 6) AS s FROM (SELECT x.{node} AS a, y.{node} AS b, count(*) AS o FROM {view} x JOIN {view} y ON x.{feature} = y.{feature} AND x.{node} < y.{node} GROUP BY 1, 2) "
        f"JOIN (SELECT {node} AS ka, count(*) AS na FROM {view} GROUP BY 1) ON a = ka JOIN (SELECT {node} AS kb, count(*) AS nb FROM {view} GROUP BY 1) ON b = kb WHERE {value} >= {at} - 1e-9"
    )


@query("jaccard_side_effects", _set_sql("se", "src", "dst", "o * 1.0 / (na + nb - o)", 0.35))
def _(spark, sf):
    return _rounded(K.jaccard(K.profiles(T.side_effects(spark, sf)), 0.35))


@query("cosine_binary", _set_sql("se", "src", "dst", "o / sqrt(na * nb * 1.0)", 0.5))
def _(spark, sf):
    return _rounded(K.cosine_binary(K.profiles(T.side_effects(spark, sf)), 0.5))


@query("tanimoto_bits", _set_sql("supply", "src", "dst", "o * 1.0 / (na + nb - o)", 0.3))
def _(spark, sf):
    return _rounded(K.tanimoto_bits(K.profiles(T.supply(spark, sf)), 0.3))


_BITS = """WITH fp AS (SELECT DISTINCT l_partkey AS p, l_suppkey % 2048 AS f FROM lineitem), n AS (SELECT p, count(*) AS n FROM fp GROUP BY 1), o AS (SELECT x.p AS p, y.p AS q, count(*) AS o FROM fp x JOIN fp y ON x.f = y.f AND 'T'||x.p < 'T'||y.p GROUP BY 1, 2)
SELECT 'T'||o.p AS a, 'T'||q AS b, round(o * 1.0 / (x.n + y.n - o), 6) AS s FROM o JOIN n x ON x.p = o.p JOIN n y ON y.p = q WHERE o * 1.0 / (x.n + y.n - o) >= 0.3 - 1e-9"""


@query("tanimoto_words", _BITS)
def _(spark, sf):
    """Suppliers of a part folded to a fingerprint of 2,048 bits."""
    from ..operators import fingerprints as FP

    li = T.table(spark, sf, "lineitem").select(F.concat(F.lit("T"), "l_partkey").alias("id"), F.pmod("l_suppkey", F.lit(2048)).alias("bit"))
    return _rounded(FP.tanimoto_words(FP.pack_bits(li, 2048), 0.3))


_GIP = "exp(-(na + nb - 2 * o) / (SELECT avg(n) FROM (SELECT count(*) * 1.0 AS n FROM inter GROUP BY src)))"


@query("gip_sizes", with_views("inter") + "SELECT src AS id, count(*) AS n, round(1.0 / (SELECT avg(n) FROM (SELECT count(*) * 1.0 AS n FROM inter GROUP BY src)), 9) AS gamma FROM inter GROUP BY 1")
def _(spark, sf):
    return K.gip_sizes(K.profiles(T.interactions(spark, sf))).withColumn("gamma", F.round("gamma", 9))


@query("gip", _set_sql("inter", "src", "dst", _GIP, 0.3))
def _(spark, sf):
    return _rounded(K.gip(K.profiles(T.interactions(spark, sf)), 0.3))


@query("knn_drugs", with_views("dall") + "SELECT src, dst, round(s, 6) AS s, rank FROM dall WHERE rank <= 5")
def _(spark, sf):
    return T.drug_neighbours(spark, sf, 5).withColumn("s", R6("s"))


@query("knn_edges", with_views("tall") + "SELECT src, dst, round(s, 6) AS s, rank FROM tall WHERE rank <= 10")
def _(spark, sf):
    return T.target_neighbours(spark, sf, 10).withColumn("s", R6("s"))


@query("strongest_k", with_views("ttop") + "SELECT a, b, round(s, 6) AS s FROM ttop")
def _(spark, sf):
    return _rounded(R.linked(T.target_neighbours(spark, sf, 5)))


@query(
    "profile_copies",
    with_views("inter", "stars") + """, e AS (SELECT src, dst FROM inter UNION ALL SELECT dst, src FROM stars) SELECT src AS id, min(src) OVER (PARTITION BY p) AS rep FROM (SELECT src, string_agg(dst, ',' ORDER BY dst) AS p FROM e GROUP BY 1)""",
)
def _(spark, sf):
    # Orders of one customer are copies of each other.
    orders = T.order_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return OV.fold_copies(checkpointed(K.profiles(T.interactions(spark, sf).unionByName(orders))))[1]


# -- sequence and text kernels ----------------------------------------------

def _grams(k):
    return with_views("seqs") + f", g AS (SELECT id, substr(seq, i, {k}) AS f, count(*) AS c FROM (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs) GROUP BY 1, 2)"


_COS = (
    "SELECT a, b, round(s, 6) AS s FROM (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) / (any_value(nx.n) * any_value(ny.n)) AS s FROM w x JOIN w y ON x.f = y.f AND x.id < y.id "
    "JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY 1, 2) WHERE s >= {at} - 1e-9"
)
_NORM = ", n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) "

for _k in (3, 4):

    @query(f"spectrum_kernel_{_k}", _grams(_k) + ", w AS (SELECT id, f, CAST(c AS DOUBLE) AS w FROM g)" + _NORM + _COS.format(at=0.8))
    def _(spark, sf, k=_k):
        return _rounded(K.spectrum_kernel(T.sequences(spark, sf), k, 0.8))


def _common_sql(k, m, d):
    """Words within m mismatches of both of two words that differ in d places, as SQL in the number of letters L."""
    from math import comb

    ways = [(i, j, c) for i in range(d + 1) for j in range(d - i + 1) for c in range(k - d + 1) if d - i + c <= m and d - j + c <= m]
    return " + ".join(f"{comb(d, i) * comb(d - i, j) * comb(k - d, c)} * (L - 2) ** {d - i - j} * (L - 1) ** {c}" for i, j, c in ways) or "0"


def _mismatch_sql(k, m, at):
    """For one mismatch all neighbours over all letters, for two the Hamming distances of all pairs of words."""
    letters = "al AS (SELECT DISTINCT unnest(string_split(seq, '')) AS l FROM seqs)"
    if m == 1:
        near = f"near AS (SELECT DISTINCT f, substr(f, 1, p - 1) || l || substr(f, p + 1) AS g FROM (SELECT DISTINCT f FROM g), (SELECT unnest(range(1, {k + 1})) AS p), al)"
        return _grams(k) + f", {letters}, {near}, w AS (SELECT id, near.g AS f, CAST(sum(c) AS DOUBLE) AS w FROM g JOIN near USING (f) GROUP BY 1, 2)" + _NORM + _COS.format(at=at)
    number = "CASE d " + " ".join(f"WHEN {d} THEN {_common_sql(k, m, d)}" for d in range(k + 1)) + " END"
    return _grams(k) + f""", {letters}, n AS (SELECT CAST(count(*) AS DOUBLE) AS L FROM al), v AS (SELECT DISTINCT f FROM g), h AS (SELECT x.f AS f, y.f AS e, hamming(x.f, y.f) AS d FROM v x, v y), h2 AS (SELECT f, e, CAST({number} AS DOUBLE) AS n FROM h, n),
    t AS (SELECT id, e, sum(c * n) AS t FROM g JOIN h2 USING (f) GROUP BY 1, 2), kk AS (SELECT t.id AS a, g.id AS b, sum(t.t * g.c) AS s FROM t JOIN g ON t.e = g.f WHERE t.id <= g.id GROUP BY 1, 2), o AS (SELECT a, s FROM kk WHERE a = b)
    SELECT kk.a, kk.b, round(kk.s / sqrt(x.s * y.s), 6) AS s FROM kk JOIN o x ON x.a = kk.a JOIN o y ON y.a = kk.b WHERE kk.a < kk.b AND kk.s / sqrt(x.s * y.s) >= {at} - 1e-9"""


for _k, _m, _at in ((3, 1, 0.85), (4, 1, 0.75), (3, 2, 0.95), (4, 2, 0.9)):

    @query("mismatch_kernel" if (_k, _m) == (3, 1) else f"mismatch_kernel_{_k}_{_m}", _mismatch_sql(_k, _m, _at))
    def _(spark, sf, k=_k, m=_m, at=_at):
        return _rounded(K.mismatch_kernel(T.sequences(spark, sf), k, m, at))


@query(
    "dice_counts",
    _grams(3) + """, t AS (SELECT id, sum(c) AS t FROM g GROUP BY 1) SELECT a, b, round(s, 6) AS s FROM (SELECT x.id AS a, y.id AS b, 2.0 * sum(least(x.c, y.c)) / (any_value(tx.t) + any_value(ty.t)) AS s
    FROM g x JOIN g y ON x.f = y.f AND x.id < y.id JOIN t tx ON tx.id = x.id JOIN t ty ON ty.id = y.id GROUP BY 1, 2) WHERE s >= 0.7 - 1e-9""",
)
def _(spark, sf):
    return _rounded(K.dice_counts(K.kmer_counts(T.sequences(spark, sf), 3), 0.7))


@query(
    "tfidf_kernel",
    _grams(4) + ", d AS (SELECT f, ln((SELECT count(DISTINCT id) FROM g) / CAST(count(*) AS DOUBLE)) AS idf FROM g GROUP BY 1), w AS (SELECT id, f, c * idf AS w FROM g JOIN d USING (f) WHERE idf > 0)"
    + _NORM + _COS.format(at=0.5),
)
def _(spark, sf):
    return _rounded(K.tfidf_kernel(T.sequences(spark, sf), 4, 0.5))


@query("alignment_scores")
def _(spark, sf):
    from ..operators.align import alignment_scores

    seq = T.sequences(spark, sf)
    return alignment_scores(K.spectrum_kernel(seq, 3, 0.85), seq).withColumn("s", R6("s"))


# Digits stand for each other, and so do vowels, at a lower cost than other letters.
_CLASSES = {(x, y): 5.0 if x == y else -2.0 for group in ("0123456789", "aeiou") for x in group for y in group}


@query("alignment_table")
def _(spark, sf):
    from ..operators.align import alignment_scores

    seq = T.sequences(spark, sf)
    return alignment_scores(K.spectrum_kernel(seq, 3, 0.85), seq, table=_CLASSES).withColumn("s", R6("s"))


@query("alignment_join")
def _(spark, sf):
    """All pairs of pages whose addresses' alignment reaches the threshold, equal addresses too, without other candidates given."""
    from ..operators.align import aligned_pairs, expand_sequences, fold_sequences

    reps, members = map(checkpointed, fold_sequences(T.sequences(spark, sf)))
    return expand_sequences(checkpointed(aligned_pairs(reps, 0.9)), reps, members).withColumn("s", R6("s"))


@query(
    "annotation_ic",
    with_views("inter") + """, cl AS (SELECT 'T'||p_partkey AS term, 'T'||p_partkey AS ancestor FROM part UNION ALL SELECT 'T'||p_partkey, p_brand FROM part UNION ALL SELECT 'T'||p_partkey, p_type FROM part),
    f AS (SELECT DISTINCT src AS id, ancestor AS t FROM inter JOIN cl ON dst = term), ic AS (SELECT t, -ln(count(*) / CAST((SELECT count(DISTINCT id) FROM f) AS DOUBLE)) AS ic FROM f GROUP BY 1),
    x AS (SELECT id, t, ic FROM f JOIN ic USING (t))
    SELECT a, b, round(m / o, 6) AS s FROM (SELECT x.id AS a, y.id AS b, max(x.ic) AS m FROM x JOIN x y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2) JOIN (SELECT id, max(ic) AS o FROM x GROUP BY 1) ON a = id""",
)
def _(spark, sf):
    p = T.table(spark, sf, "part").select(F.concat(F.lit("T"), "p_partkey").alias("term"), "p_brand", "p_type")
    closure = p.select("term", F.explode(F.array("term", "p_brand", "p_type")).alias("ancestor"))
    terms = T.interactions(spark, sf).select(F.col("src").alias("id"), F.col("dst").alias("term"))
    return _rounded(K.annotation_ic(terms, closure))


@query(
    "impute_profiles",
    with_views("known", "dsim") + """, u AS (SELECT DISTINCT src FROM inter EXCEPT SELECT src FROM known), m AS (SELECT a AS src, b AS nb, s FROM dsim UNION ALL SELECT b, a, s FROM dsim),
    near AS (SELECT * FROM m WHERE src IN (SELECT src FROM u) AND nb IN (SELECT src FROM known))
    SELECT src, dst, 1.0 AS v FROM known UNION ALL SELECT near.src, known.dst, round(sum(s) / any_value(t), 6) FROM near JOIN known ON nb = known.src JOIN (SELECT src AS k, sum(s) AS t FROM near GROUP BY 1) ON near.src = k GROUP BY 1, 2""",
)
def _(spark, sf):
    nodes = T.interactions(spark, sf).select(F.col("src").alias("id"))
    return K.impute_profiles(T.known_interactions(spark, sf), T.drug_similarity(spark, sf), nodes).withColumn("v", R6("v"))


_VP = with_views("emb") + ", vp AS (SELECT DISTINCT 'V'||l_suppkey AS a, 'V'||l_partkey AS b FROM lineitem)"


@query(
    "cosine_dense",
    _VP + """ SELECT vp.a, vp.b, round((d(x.vec, y.vec) / (sqrt(d(x.vec, x.vec)) * sqrt(d(y.vec, y.vec))) + 1) / 2, 6) AS s FROM vp JOIN emb x ON vp.a = x.id JOIN emb y ON vp.b = y.id""".replace(
        "d(x.vec, y.vec)", "list_dot_product(CAST(x.vec AS DOUBLE[]), CAST(y.vec AS DOUBLE[]))"
    ).replace("d(x.vec, x.vec)", "list_dot_product(CAST(x.vec AS DOUBLE[]), CAST(x.vec AS DOUBLE[]))").replace("d(y.vec, y.vec)", "list_dot_product(CAST(y.vec AS DOUBLE[]), CAST(y.vec AS DOUBLE[]))"),
)
def _(spark, sf):
    pairs = T.table(spark, sf, "lineitem").select(F.concat(F.lit("V"), "l_suppkey").alias("a"), F.concat(F.lit("V"), "l_partkey").alias("b")).distinct()
    return _rounded(K.cosine_dense(pairs, T.embeddings(spark, sf)))


# -- matrix normalisation ---------------------------------------------------

_CELLS = ", m AS (SELECT a AS i, b AS j, s AS v FROM tsim UNION ALL SELECT b, a, s FROM tsim) "


def _cells(spark, sf):
    return E.mirror(T.target_similarity(spark, sf), "s").select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias("v"))


def _v6(df):
    return df.select("i", "j", R6("v").alias("v"))


@query("minmax_columns", with_views("tsim") + _CELLS + "SELECT i, j, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY j) AS lo, max(v) OVER (PARTITION BY j) AS hi FROM m)")
def _(spark, sf):
    return _v6(K.minmax_columns(_cells(spark, sf)))


@query("row_normalize", with_views("tsim") + _CELLS + "SELECT i, j, round(v / (sum(v) OVER (PARTITION BY i) + 1e-12), 6) AS v FROM m")
def _(spark, sf):
    return _v6(K.row_normalize(_cells(spark, sf), drop_self=True))


@query(
    "sym_normalize_square",
    with_views("tsim") + _CELLS + """, e AS (SELECT * FROM m UNION ALL SELECT DISTINCT i, i, 1.0 FROM m), r AS (SELECT i AS k, sum(v) AS d FROM e GROUP BY 1)
    SELECT i, j, round(v / sqrt(x.d * y.d), 6) AS v FROM e JOIN r x ON i = x.k JOIN r y ON j = y.k""",
)
def _(spark, sf):
    return _v6(K.sym_normalize(_cells(spark, sf), square=True))


@query(
    "sym_normalize_rectangular",
    with_views("inter") + "SELECT i.src AS i, i.dst AS j, round(1.0 / sqrt(r.n * c.n * 1.0), 6) AS v FROM inter i JOIN (SELECT src, count(*) AS n FROM inter GROUP BY 1) r ON i.src = r.src JOIN (SELECT dst, count(*) AS n FROM inter GROUP BY 1) c ON i.dst = c.dst",
)
def _(spark, sf):
    return _v6(K.sym_normalize(E.incidence(T.interactions(spark, sf)), square=False))


def _second_similarity(spark, sf):
    return K.jaccard(K.profiles(T.supply(spark, sf)), 0.3)


_FUSE_VIEW = "SELECT a, b, o * 1.0 / (na + nb - o) AS s FROM (SELECT x.src AS a, y.src AS b, count(*) AS o FROM supply x JOIN supply y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) JOIN (SELECT src AS ka, count(*) AS na FROM supply GROUP BY 1) ON a = ka JOIN (SELECT src AS kb, count(*) AS nb FROM supply GROUP BY 1) ON b = kb WHERE o * 1.0 / (na + nb - o) >= 0.3 - 1e-9"


def _fuse_sql(rounds=2):
    parts = []
    status = "SELECT i, j, v / (2 * sum(v) OVER (PARTITION BY i)) AS v FROM {0} WHERE i <> j UNION ALL SELECT DISTINCT i, i, 0.5 FROM {0} WHERE i <> j"
    for n, v in (("1", "tsim"), ("2", "ssim")):
        parts.append(f"m{n} AS (SELECT a AS i, b AS j, s AS v FROM {v} UNION ALL SELECT b, a, s FROM {v})")
        parts.append(f"p{n}_0 AS MATERIALIZED ({status.format(f'm{n}')})")
        parts.append(f"k{n} AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM m{n}) WHERE r <= 5)")
    for r in range(rounds):
        for n, o in (("1", "2"), ("2", "1")):
            p = f"p{o}_{r}"
            parts.append(f"h{n}_{r} AS (SELECT k{n}.i, {p}.j, sum(k{n}.v * {p}.v) AS v FROM k{n} JOIN {p} ON k{n}.j = {p}.i GROUP BY 1, 2)")
            parts.append(f"t{n}_{r} AS MATERIALIZED (SELECT h.i, k{n}.i AS j, sum(h.v * k{n}.v) AS v FROM h{n}_{r} h JOIN k{n} ON h.j = k{n}.j GROUP BY 1, 2)")
            parts.append(f"p{n}_{r + 1} AS MATERIALIZED ({status.format(f't{n}_{r}')})")
    return with_views("tsim", "supply") + f", ssim AS ({_FUSE_VIEW}), " + ", ".join(parts) + (
        f" SELECT least(i, j) AS a, greatest(i, j) AS b, round(sum(v) / 4, 6) AS s FROM (SELECT * FROM p1_{rounds} UNION ALL SELECT * FROM p2_{rounds}) WHERE i <> j GROUP BY 1, 2"
    )


@query("fuse_similarities", _fuse_sql())
def _(spark, sf):
    from ..operators.fuse import fuse

    return _rounded(fuse([T.target_similarity(spark, sf), _second_similarity(spark, sf)], k=5))


@query(
    "scale_features_minmax",
    with_views("emb") + """, v AS (SELECT id, label, generate_subscripts(vec, 1) AS p, CAST(unnest(vec) AS DOUBLE) AS x FROM emb), f AS (SELECT p, min(x) AS lo, max(x) AS hi FROM v WHERE label < 8 GROUP BY 1)
    SELECT id, round(sum((x - lo) / (hi - lo)), 4) AS total FROM v JOIN f USING (p) WHERE label >= 8 GROUP BY 1""",
)
def _(spark, sf):
    from ..operators.learn import scale_features

    e = T.embeddings(spark, sf).withColumnRenamed("vec", "feature")
    scaled = scale_features(e.filter("label < 8"), [e.filter("label >= 8")], "minmax")[1]
    return scaled.select("id", F.round(F.aggregate("feature", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    "scale_features_maxabs",
    with_views("emb") + """, v AS (SELECT id, label, generate_subscripts(vec, 1) AS p, CAST(unnest(vec) AS DOUBLE) AS x FROM emb), f AS (SELECT p, max(abs(x)) AS m FROM v WHERE label < 8 GROUP BY 1)
    SELECT id, round(sum(x / m), 4) AS total FROM v JOIN f USING (p) WHERE label >= 8 GROUP BY 1""",
)
def _(spark, sf):
    from ..operators.learn import scale_features

    e = T.embeddings(spark, sf).withColumnRenamed("vec", "feature")
    scaled = scale_features(e.filter("label < 8"), [e.filter("label >= 8")], "maxabs")[1]
    return scaled.select("id", F.round(F.aggregate("feature", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# -- graph ------------------------------------------------------------------

@query(
    "augment_graph",
    with_views("inter", "tall", "dall") + """SELECT src, dst, 1.0 AS weight, 'interaction' AS etype FROM inter UNION ALL SELECT src, dst, round(s, 6), 'src_knn' FROM dall WHERE rank <= 3
    UNION ALL SELECT src, dst, round(s, 6), 'dst_knn' FROM tall WHERE rank <= 3""",
)
def _(spark, sf):
    g = G.augment_graph(T.interactions(spark, sf), T.drug_neighbours(spark, sf, 3), T.target_neighbours(spark, sf, 3))
    return g.withColumn("weight", R6("weight"))


@query("mask_fold", with_views("inter") + "SELECT src, dst FROM inter WHERE md5('0|' || src || '|' || dst) >= '2'")
def _(spark, sf):
    from ..functions.hashing import order_key

    e = T.interactions(spark, sf)
    return G.mask_fold(e, e.filter(order_key(0, "src", "dst") < "2"))


_HOPS = with_views("geo", recursive=True, extra="""bw AS (SELECT src, dst FROM geo UNION SELECT dst, src FROM geo), walk(source, id, hops) AS (SELECT 'N'||n_nationkey, 'N'||n_nationkey, 0 FROM nation
    UNION SELECT source, dst, hops + 1 FROM walk JOIN bw ON id = src WHERE hops < 9), best AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)""")


def _hops(spark, sf):
    sources = T.table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return G.hop_distance(T.geography(spark, sf), sources)


@query("hop_distance", _HOPS + "SELECT source, id, hops FROM best")
def _(spark, sf):
    return _hops(spark, sf)


_ALL_HOPS = with_views("geo", recursive=True, extra="""bw AS (SELECT src, dst FROM geo UNION SELECT dst, src FROM geo), walk(source, id, hops) AS (SELECT DISTINCT src, src, 0 FROM bw
    UNION SELECT source, dst, hops + 1 FROM walk JOIN bw ON id = src WHERE hops < 5), best AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)""")


@query("hop_distance_all", _ALL_HOPS + "SELECT source, id, hops FROM best")
def _(spark, sf):
    """Between all nodes: a tree of three levels, so no path is longer than four."""
    e = checkpointed(T.geography(spark, sf))
    return G.hop_distance(e, E.node_set(e))


@query("path_kernel", _HOPS + "SELECT source AS a, id AS b, round(0.9 * exp(-hops), 6) AS s FROM best")
def _(spark, sf):
    return _rounded(G.path_kernel(_hops(spark, sf)))


@query("biased_walks")
def _(spark, sf):
    return G.biased_walks(T.interactions(spark, sf))


@query("node_embeddings")
def _(spark, sf):
    from ..operators.learn import node_embeddings

    return node_embeddings(checkpointed(G.biased_walks(T.interactions(spark, sf))))


# Sessions as walks: the events of a user in the order of time.
_WALKS = "WITH w AS (SELECT user_id AS walk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type || json_extract_string(props, '$.k') AS node FROM events), p AS (SELECT x.node AS a, y.node AS b FROM w x JOIN w y ON x.walk = y.walk AND x.step - y.step BETWEEN 1 AND 5), c AS (SELECT a, b, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1, 2) "


def _sessions(spark, sf):
    from pyspark.sql import Window as W

    e = T.table(spark, sf, "events")
    node = F.concat("event_type", F.get_json_object("props", "$.k"))
    return e.select(F.col("user_id").alias("walk"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), node.alias("node"))


@query("cooccurrence", _WALKS + "SELECT a, b, n FROM c")
def _(spark, sf):
    return G.cooccurrence(checkpointed(_sessions(spark, sf)), 5)


@query("positive_information", _WALKS + ", o AS (SELECT a, sum(n) AS s FROM c GROUP BY 1) SELECT c.a, c.b, round(ln(n * (SELECT CAST(sum(s) AS DOUBLE) FROM o) / (x.s * y.s)), 6) AS w FROM c JOIN o x ON x.a = c.a JOIN o y ON y.a = c.b WHERE n * (SELECT CAST(sum(s) AS DOUBLE) FROM o) / (x.s * y.s) > 1")
def _(spark, sf):
    return G.positive_information(checkpointed(G.cooccurrence(checkpointed(_sessions(spark, sf)), 5))).withColumn("w", R6("w"))


@query("walk_checks", with_views("inter") + "SELECT (SELECT count(*) FROM (SELECT src FROM inter UNION SELECT dst FROM inter)) * 2 AS walks, 6 AS steps, 0 AS off_edge, 0 AS wrong_start")
def _(spark, sf):
    """Every walk has its length, starts at its node and goes along edges."""
    e = checkpointed(T.interactions(spark, sf))
    walks = checkpointed(G.biased_walks(e, num_walks=2, length=6))
    a, b = walks.select("walk", "step", F.col("node").alias("src")), walks.select("walk", (F.col("step") - 1).alias("step"), F.col("node").alias("dst"))
    off = a.join(b, ["walk", "step"]).join(E.symmetrize(e), ["src", "dst"], "left_anti").agg(F.count("*").cast("int").alias("off_edge"))
    size = walks.groupBy("walk").agg(F.count("*").alias("n"), F.max(F.when(F.col("step") == 0, F.split("walk", "#")[0] != F.col("node")).cast("int")).alias("bad"))
    size = size.agg(F.count("*").alias("walks"), F.when(F.min("n") == F.max("n"), F.max("n")).cast("int").alias("steps"), F.sum("bad").cast("int").alias("wrong_start"))
    return size.join(F.broadcast(off))

_META = with_views("inter", "dtop", "ttop") + """, d AS (SELECT a AS i, b AS k, s FROM dtop UNION ALL SELECT b, a, s FROM dtop), t AS (SELECT a AS i, b AS k, s FROM ttop UNION ALL SELECT b, a, s FROM ttop),
d2 AS (SELECT x.i, y.k, sum(x.s * y.s) AS su, max(x.s * y.s) AS mx FROM d x JOIN d y ON x.k = y.i WHERE x.i <> y.k GROUP BY 1, 2), t2 AS (SELECT x.i, y.k, sum(x.s * y.s) AS su, max(x.s * y.s) AS mx FROM t x JOIN t y ON x.k = y.i WHERE x.i <> y.k GROUP BY 1, 2),
ddt AS (SELECT d.i AS src, e.dst, sum(d.s) AS su, max(d.s) AS mx FROM d JOIN inter e ON d.k = e.src GROUP BY 1, 2) """
_META_SQL = {
    "ddt": "SELECT src, dst, round(su, 9) AS sum, round(mx, 9) AS max FROM ddt",
    "dtt": "SELECT e.src, t.k AS dst, round(sum(t.s), 9) AS sum, round(max(t.s), 9) AS max FROM inter e JOIN t ON e.dst = t.i GROUP BY 1, 2",
    "dddt": "SELECT d2.i AS src, e.dst, round(sum(su), 9) AS sum, round(max(mx), 9) AS max FROM d2 JOIN inter e ON d2.k = e.src GROUP BY 1, 2",
    "dttt": "SELECT e.src, t2.k AS dst, round(sum(su), 9) AS sum, round(max(mx), 9) AS max FROM inter e JOIN t2 ON e.dst = t2.i GROUP BY 1, 2",
    "ddtt": "SELECT ddt.src, t.k AS dst, round(sum(su * s), 9) AS sum, round(max(mx * s), 9) AS max FROM ddt JOIN t ON ddt.dst = t.i GROUP BY 1, 2",
    "dtdt": "SELECT a.src, d.dst, CAST(count(*) AS DOUBLE) AS sum, 1.0 AS max FROM inter a JOIN inter b ON a.dst = b.dst JOIN inter d ON b.src = d.src JOIN inter p ON p.src = a.src AND p.dst = d.dst GROUP BY 1, 2",
}

for _kind, _sql in _META_SQL.items():

    @query(f"meta_path_{_kind}", _META + f"SELECT src, dst, sum, max FROM ({_sql})")
    def _(spark, sf, kind=_kind):
        e = checkpointed(T.interactions(spark, sf))
        sim = lambda f: checkpointed(R.linked(f(spark, sf, 5)))
        drugs = sim(T.drug_neighbours) if kind in ("ddt", "dddt", "ddtt") else None
        targets = sim(T.target_neighbours) if kind in ("dtt", "dttt", "ddtt") else None
        out = G.meta_paths(drugs, targets, e, kinds=(kind,))[kind]
        return out.select("src", "dst", F.round("sum", 9).alias("sum"), F.round("max", 9).alias("max"))
