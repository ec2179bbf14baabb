"""Edge-table, set, statistics and ranking queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import rank as R
from ..operators import scale as S
from ..operators import stats as A
from . import tables as T
from .registry import query
from .tables import with_views

R6 = lambda c: F.round(c, 6)


# -- sets -------------------------------------------------------------------

@query("symmetrize", with_views("geo") + "SELECT src, dst FROM geo UNION SELECT dst, src FROM geo")
def _(spark, sf):
    return E.symmetrize(T.geography(spark, sf))


@query("node_set", with_views("inter") + "SELECT src AS id FROM inter UNION SELECT dst FROM inter")
def _(spark, sf):
    return E.node_set(T.interactions(spark, sf))


@query(
    "hetero_union",
    with_views("inter", "supply", "se") + """SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM
    (SELECT * FROM inter UNION ALL SELECT * FROM supply UNION ALL SELECT * FROM se)""",
)
def _(spark, sf):
    return E.hetero_union(T.interactions(spark, sf), T.supply(spark, sf), T.side_effects(spark, sf))


@query(
    "exclusive_overlaps",
    with_views("affinity") + """SELECT datasets, count(*) AS n FROM (SELECT src, string_agg(dataset, '&' ORDER BY dataset) AS datasets, count(*) AS k
    FROM (SELECT DISTINCT src || '-' || dst AS src, dataset FROM affinity) GROUP BY src) WHERE k <= 2 GROUP BY datasets""",
)
def _(spark, sf):
    return E.exclusive_overlaps(T.affinity(spark, sf).select(F.concat_ws("-", "src", "dst").alias("id"), "dataset"))


def _pairs_of(spark, sf, priority):
    """The pairs of a data set as ids."""
    return T.affinity(spark, sf).filter(F.col("dataset") == priority).select(F.concat_ws("-", "src", "dst").alias("id")).distinct()


_SETS = with_views("affinity") + "".join(f", {v} AS (SELECT DISTINCT src || '-' || dst AS id FROM affinity WHERE dataset = '{p}')" for v, p in (("a", "1-URGENT"), ("b", "5-LOW"), ("c", "2-HIGH"))) + " "
_SETS = _SETS.replace(") , a AS", "), a AS")


@query("common_ids", _SETS + "SELECT id FROM a INTERSECT SELECT id FROM b INTERSECT SELECT id FROM c")
def _(spark, sf):
    return E.common_ids(*[_pairs_of(spark, sf, p) for p in ("1-URGENT", "5-LOW", "2-HIGH")])


@query("difference", _SETS + "SELECT id FROM a EXCEPT SELECT id FROM b")
def _(spark, sf):
    return E.difference(_pairs_of(spark, sf, "1-URGENT"), _pairs_of(spark, sf, "5-LOW"))


@query("symmetric_difference", _SETS + "(SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)")
def _(spark, sf):
    return E.symmetric_difference(_pairs_of(spark, sf, "1-URGENT"), _pairs_of(spark, sf, "5-LOW"))


_PAIRS = ", pairs AS (SELECT DISTINCT src, dst FROM affinity) "


@query("stack_labels", with_views("inter") + _PAIRS + "SELECT src, dst, 1 AS label FROM inter UNION ALL SELECT src, dst, 0 FROM (SELECT * FROM pairs EXCEPT SELECT * FROM inter)")
def _(spark, sf):
    pos = T.interactions(spark, sf)
    return E.stack_labels(pos, E.anti_pairs(T.affinity(spark, sf).select("src", "dst").distinct(), pos))


@query("melt", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return E.melt(p, ["p_partkey"], ["p_size", "p_retailprice"])


# -- pair joins -------------------------------------------------------------

@query("anti_pairs", with_views("inter") + _PAIRS + "SELECT * FROM pairs EXCEPT SELECT * FROM inter")
def _(spark, sf):
    return E.anti_pairs(T.affinity(spark, sf).select("src", "dst").distinct(), T.interactions(spark, sf))


@query("label_pairs", with_views("inter") + _PAIRS + "SELECT p.src, p.dst, CASE WHEN i.src IS NULL THEN 0 ELSE 1 END AS label FROM pairs p LEFT JOIN inter i ON p.src = i.src AND p.dst = i.dst")
def _(spark, sf):
    return E.label_pairs(T.affinity(spark, sf).select("src", "dst").distinct(), T.interactions(spark, sf))


@query(
    "lookup_pair",
    with_views("dist") + """SELECT p1.p_partkey, round(d, 6) AS d FROM part p1 LEFT JOIN dist ON a = least('T'||p_partkey, 'T'||(p_partkey * 7 % 1000))
    AND b = greatest('T'||p_partkey, 'T'||(p_partkey * 7 % 1000))""",
)
def _(spark, sf):
    t = lambda c: F.concat(F.lit("T"), c)
    p = T.table(spark, sf, "part").select("p_partkey", t(F.col("p_partkey")).alias("x"), t(F.col("p_partkey") * 7 % 1000).alias("y"))
    return E.lookup_pair(p, "x", "y", T.target_distance(spark, sf), "d", "d").select("p_partkey", "d")


@query(
    "band_join",
    with_views("inter", "dist") + """SELECT src, dst, cand, d FROM inter JOIN (SELECT a, b AS cand, d FROM dist UNION ALL SELECT b, a, d FROM dist) m ON dst = m.a WHERE d > 2.5 AND d < 4.6""",
)
def _(spark, sf):
    return E.band_join(T.interactions(spark, sf), T.target_distance(spark, sf), 2.5, 4.6)


@query(
    "symbol_overlap",
    with_views("affinity") + """, syms AS (SELECT DISTINCT dst AS id, l_orderkey AS sym FROM affinity)
    SELECT DISTINCT least(x.id, z.id) AS src, greatest(x.id, z.id) AS dst FROM syms x JOIN orders ON x.sym = o_orderkey JOIN syms z ON z.sym = o_orderkey + 1 WHERE x.id <> z.id""",
)
def _(spark, sf):
    syms = T.affinity(spark, sf).select(F.col("dst").alias("id"), F.col("l_orderkey").alias("sym"))
    rows = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sym1"), (F.col("o_orderkey") + 1).alias("sym2"))
    return E.symbol_overlap(syms, rows)


@query(
    "annotate",
    with_views("inter") + """SELECT s.src, s.dst, COALESCE(p_type, '-') AS p_type FROM inter s LEFT JOIN
    (SELECT 'T'||(p_partkey // 2 * 2) AS k, arg_min(p_type, p_partkey) AS p_type FROM part WHERE p_size > 25 GROUP BY 1) ON dst = k""",
)
def _(spark, sf):
    # Two parts share a key: the first annotation counts.
    ann = T.table(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("T"), F.expr("p_partkey div 2 * 2")).alias("dst"), "p_type", "p_partkey")
    return E.annotate(T.interactions(spark, sf), ann, "dst", ["p_type"], "p_partkey").select("src", "dst", "p_type")


def _vector_pairs(spark, sf):
    li = T.table(spark, sf, "lineitem").select(F.concat(F.lit("V"), "l_suppkey").alias("src"), F.concat(F.lit("V"), "l_partkey").alias("dst")).distinct()
    return E.pair_embeddings(li, T.embeddings(spark, sf).select("id", "vec"))


_VPAIRS = with_views("emb") + ", vp AS (SELECT DISTINCT 'V'||l_suppkey AS src, 'V'||l_partkey AS dst FROM lineitem) SELECT vp.src, vp.dst, "
_VJOIN = " FROM vp JOIN emb x ON vp.src = x.id JOIN emb y ON vp.dst = y.id"


@query("pair_embeddings", _VPAIRS + "len(x.vec) + len(y.vec) AS width, round(CAST(x.vec[1] AS DOUBLE), 6) AS first, round(CAST(y.vec[len(y.vec)] AS DOUBLE), 6) AS last" + _VJOIN)
def _(spark, sf):
    v = _vector_pairs(spark, sf)
    at = lambda k: R6(F.element_at("vec", k).cast("double"))
    return v.select("src", "dst", F.size("vec").alias("width"), at(1).alias("first"), at(-1).alias("last"))


_COMBINE = {
    "Concat": "list_sum(list_transform(list_concat(x.vec, y.vec), lambda v: CAST(v AS DOUBLE)))",
    "Hadamard": "list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))",
    "AVG": "list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: (CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) / 2))",
    "WL1": "list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))",
    "WL2": "list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))",
}

for _func, _sql in _COMBINE.items():

    @query(f"combine_vectors_{_func.lower()}", _VPAIRS + f"round({_sql}, 4) AS total" + _VJOIN)
    def _(spark, sf, func=_func):
        from ..operators.graph import combine_vectors

        v = _vector_pairs(spark, sf)
        v = v.select("src", "dst", *[F.col(c).cast("array<double>").alias(c) for c in ("src_vec", "dst_vec")])
        out = combine_vectors(v, func)
        return out.select("src", "dst", F.round(F.aggregate("feature", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("slice_matrix", with_views("tsim") + ", ids AS (SELECT 'T'||p_partkey AS id FROM part WHERE p_size > 25) SELECT a, b, round(s, 6) AS s FROM tsim WHERE a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)")
def _(spark, sf):
    ids = T.table(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("T"), "p_partkey").alias("id"))
    return E.slice_matrix(T.target_similarity(spark, sf), ids).select("a", "b", R6("s").alias("s"))


@query(
    "align_matrices",
    with_views("supply", "geo") + """, m1 AS (SELECT DISTINCT src AS a, dst AS b FROM supply WHERE src LIKE '%7'), m2 AS (SELECT src AS a, dst AS b FROM geo WHERE src LIKE 'P%' OR dst LIKE 'R%'),
    ids AS (SELECT id FROM (SELECT a AS id FROM m1 UNION SELECT b FROM m1) INTERSECT SELECT id FROM (SELECT src AS id FROM supply UNION SELECT dst FROM supply UNION SELECT a FROM m2))
    SELECT a, b FROM m1 WHERE a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)""",
)
def _(spark, sf):
    m1 = T.supply(spark, sf).filter(F.col("src").endswith("7")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    g = T.geography(spark, sf).filter(F.col("src").startswith("P") | F.col("dst").startswith("R")).select("src")
    all_ids = E.node_set(T.supply(spark, sf)).unionByName(g.select(F.col("src").alias("id")))
    other = all_ids.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return E.align_matrices([m1, other])[0]


# -- sparse matrices --------------------------------------------------------

@query("incidence", with_views("inter") + "SELECT src AS i, dst AS j, 1 AS v FROM inter")
def _(spark, sf):
    return E.incidence(T.interactions(spark, sf))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("dense_incidence", "SELECT user_id AS id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY 1")
def _(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return E.dense_incidence(e, e.select(F.col("src").alias("id")), _TYPES)


@query("upper_triangle", with_views("tsim") + ", m AS (SELECT a, b, s FROM tsim UNION ALL SELECT b, a, s FROM tsim) SELECT a, b, round(s, 6) AS s FROM m WHERE a <= b")
def _(spark, sf):
    return E.upper_triangle(E.mirror(T.target_similarity(spark, sf), "s")).select("a", "b", R6("s").alias("s"))


@query("edges_from_incidence", with_views("affinity") + "SELECT DISTINCT src, dst FROM affinity WHERE y < 30")
def _(spark, sf):
    a = T.affinity(spark, sf)
    cells = a.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max((F.col("y") < 30).cast("int")).alias("v"))
    return E.edges_from_incidence(cells)


@query("undirected_edge_count", with_views("geo") + "SELECT count(*) AS n_edges FROM geo")
def _(spark, sf):
    return E.undirected_edge_count(E.symmetrize(T.geography(spark, sf)))


@query("split_by_source", "SELECT p_partkey, t AS tag FROM part, (SELECT unnest(['ring', 'red', 'small', 'widget']) AS t) WHERE contains(p_name, t)")
def _(spark, sf):
    return E.split_by_source(T.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["ring", "red", "small", "widget"]).select("p_partkey", "tag")


# -- aggregates -------------------------------------------------------------

@query("collapse_pairs", "SELECT l_suppkey, l_partkey, sum(l_quantity) AS l_quantity, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_returnflag FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.collapse_pairs(li, ["l_suppkey", "l_partkey"], "l_quantity", "sum", ["l_returnflag"], "ord")


@query("harmonize", with_views("affinity") + "SELECT src, dst, max(y) AS y FROM affinity GROUP BY 1, 2")
def _(spark, sf):
    return A.harmonize(T.affinity(spark, sf), "max")


def _events(spark, sf):
    e = T.table(spark, sf, "events")
    term = F.concat_ws("-", "event_type", F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("case"), F.concat(F.lit("D"), "user_id").alias("drug"), term.alias("term"), "value")


_EV = "WITH ev AS (SELECT event_id AS \"case\", 'D'||user_id AS drug, event_type || '-' || json_extract_string(props, '$.k') AS term, value FROM events), kept AS (SELECT * FROM ev WHERE value > 5), freq AS (SELECT term, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM kept) AS f FROM kept GROUP BY 1) "


@query("term_frequency", _EV + "SELECT term, n, round(f, 8) AS f FROM freq WHERE n > 5 AND f < 0.002")
def _(spark, sf):
    e = _events(spark, sf)
    return A.term_frequency(e.select("case", "term"), e.filter("value > 5").select("case"), 5, 0.002).withColumn("f", F.round("f", 8))


@query("drug_profile", _EV + "SELECT DISTINCT drug, ev.term, round(f, 8) AS f, 1 AS bit FROM ev JOIN freq ON ev.term = freq.term WHERE n > 5 AND f < 0.002")
def _(spark, sf):
    e = _events(spark, sf)
    freq = A.term_frequency(e.select("case", "term"), e.filter("value > 5").select("case"), 5, 0.002)
    return A.drug_profile(e.select("case", "drug"), e.select("case", "term"), freq).withColumn("f", F.round("f", 8))


@query("collect_terms", _EV + "SELECT drug, term, row_number() OVER (PARTITION BY drug ORDER BY term) AS position FROM (SELECT DISTINCT drug, term FROM ev WHERE value > 30)")
def _(spark, sf):
    return A.collect_terms(_events(spark, sf), "drug", "term", F.col("value") > 30)


@query("contingency", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    return A.contingency(T.table(spark, sf, "part"), "p_type", "p_brand")


@query("collapse_rare", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) < 30 THEN 'other' ELSE p_name END AS p_name FROM part")
def _(spark, sf):
    return A.collapse_rare(T.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 30)


@query("mean_filter", "SELECT l_suppkey, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY 1 HAVING round(avg(l_quantity), 2) > 25.5")
def _(spark, sf):
    return A.mean_filter(T.table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 25.5)


# Component of every node as the smallest id it can reach.
# Every customer with its orders is one; customers come first in the order of ids.
_COMP = with_views("stars") + ", comp AS (SELECT DISTINCT src AS id, src AS component FROM stars UNION ALL SELECT dst, src FROM stars) "


@query("connected_components", _COMP + "SELECT id, component FROM comp")
def _(spark, sf):
    from ..operators.graph import connected_components

    return connected_components(T.order_edges(spark, sf))


@query("component_sizes", _COMP + "SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    from ..operators.graph import component_sizes, connected_components

    return A.tabulate(component_sizes(connected_components(T.order_edges(spark, sf))), "size")


@query(
    "dataset_stats",
    _COMP + """SELECT ns AS n_src, nd AS n_dst, ns + nd AS n_nodes, m AS n_edges, round(200.0 * m / ((ns + nd) * (ns + nd - 1)), 2) AS density,
    round(CAST(m AS DOUBLE) / ns, 6) AS mean_degree_src, round(CAST(m AS DOUBLE) / nd, 6) AS mean_degree_dst,
    (SELECT count(DISTINCT component) FROM comp) AS n_components, (SELECT max(size) FROM (SELECT count(*) AS size FROM comp GROUP BY component)) AS largest_component
    FROM (SELECT count(DISTINCT src) AS ns, count(DISTINCT dst) AS nd, count(*) AS m FROM stars)""",
)
def _(spark, sf):
    return A.dataset_stats(T.order_edges(spark, sf))


def _typed(spark, sf):
    tag = lambda df, t: df.select(F.lit(t).alias("etype"), "src", "dst")
    return tag(T.interactions(spark, sf), "dti").unionByName(tag(T.supply(spark, sf), "supply")).unionByName(tag(T.side_effects(spark, sf), "se"))


@query(
    "hetero_counts",
    with_views("inter", "supply", "se") + "SELECT 'dti' AS etype, count(*) AS n_edges FROM inter UNION ALL SELECT 'supply', count(*) FROM supply UNION ALL SELECT 'se', count(*) FROM se",
)
def _(spark, sf):
    return A.hetero_counts(_typed(spark, sf))


def _side_networks(spark, sf):
    """Six typed networks around the interactions, with side edges restricted to their drugs and targets where one of those is meant."""
    dti = T.interactions(spark, sf)
    drugs, targets = dti.select(F.col("src").alias("id")).distinct(), dti.select(F.col("dst").alias("id")).distinct()
    orders = T.order_edges(spark, sf)
    nation = T.geography(spark, sf).filter(F.col("src").startswith("D"))
    brand = T.table(spark, sf, "part").select(F.concat(F.lit("T"), "p_partkey").alias("src"), "p_brand")
    nets = {
        "dti": (dti, None), "drug_se": (T.side_effects(spark, sf), "src"), "drug_order": (orders, "src"), "drug_nation": (nation, "src"),
        "target_supplier": (T.supply(spark, sf), "src"), "target_brand": (brand.select("src", F.col("p_brand").alias("dst")), "src"),
    }
    return A.restricted({k: (e, side, targets if k.startswith("target") else drugs) for k, (e, side) in nets.items()})


_SIX = """six AS (SELECT 'dti' AS etype, src, dst FROM inter UNION ALL SELECT 'drug_se', src, dst FROM se WHERE src IN (SELECT src FROM inter) UNION ALL SELECT 'drug_order', src, dst FROM stars WHERE src IN (SELECT src FROM inter)
    UNION ALL SELECT 'drug_nation', src, dst FROM geo WHERE src LIKE 'D%' AND src IN (SELECT src FROM inter) UNION ALL SELECT 'target_supplier', src, dst FROM supply WHERE src IN (SELECT dst FROM inter)
    UNION ALL SELECT 'target_brand', 'T'||p_partkey, p_brand FROM part WHERE 'T'||p_partkey IN (SELECT dst FROM inter))"""


@query("hetero_edges", with_views("inter", "se", "stars", "geo", "supply", extra=_SIX) + "SELECT etype, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM (SELECT DISTINCT * FROM six) GROUP BY 1")
def _(spark, sf):
    e = _side_networks(spark, sf)
    return e.groupBy("etype").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


@query(
    "hetero_stats",
    # What the least id reaches is one component; on these data that is all there is.
    with_views("inter", "se", "stars", "geo", "supply", recursive=True, extra=_SIX + """, bw AS (SELECT src, dst FROM six UNION SELECT dst, src FROM six), ids AS (SELECT DISTINCT src AS id FROM bw),
    reach(id) AS (SELECT min(id) FROM ids UNION SELECT bw.dst FROM reach JOIN bw ON reach.id = bw.src), n AS (SELECT substr(id, 1, 1) AS t, count(*) AS n FROM ids GROUP BY 1), m AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM six))""")
    + "SELECT (SELECT count(*) FROM ids) AS n_nodes, m AS n_edges, CASE WHEN (SELECT count(*) FROM reach) = (SELECT count(*) FROM ids) THEN 1 END AS n_components, round(m / ((SELECT product(CAST(n AS DOUBLE)) FROM n) - m), 12) AS sparsity FROM m",
)
def _(spark, sf):
    e = S.checkpointed(_side_networks(spark, sf))
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return A.hetero_stats(e, ids.select(F.substring("id", 1, 1).alias("ntype"), "id")).withColumn("sparsity", F.round("sparsity", 12))


@query("degrees", with_views("inter") + "SELECT 'src' AS side, src AS id, count(*) AS degree FROM inter GROUP BY 2 UNION ALL SELECT 'dst', dst, count(*) FROM inter GROUP BY 2")
def _(spark, sf):
    return A.degrees(T.interactions(spark, sf))


@query("tabulate_degrees", with_views("inter") + "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM inter GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    return A.tabulate(A.degrees(T.interactions(spark, sf)).filter("side = 'src'"), "degree")


@query("histogram", with_views("tsim") + "SELECT CAST(least(floor((s - 0.05) * 10 / (0.25 - 0.05)) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM (SELECT round(s, 6) AS s FROM tsim) WHERE s <= 0.25 GROUP BY 1")
def _(spark, sf):
    return A.histogram(T.target_similarity(spark, sf).select(R6("s").alias("s")), "s", 10, 0.05, 0.25)


@query(
    "histogram_scaled",
    """SELECT CAST(least(floor((p_retailprice - lo) / (hi - lo) * 8) + 1, 8) AS INTEGER) AS bin, count(*) AS n
    FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY 1""",
)
def _(spark, sf):
    return A.histogram(T.table(spark, sf, "part"), "p_retailprice", 8, scale=True)


@query(
    "band_shares",
    with_views("dist") + """SELECT round(avg(CASE WHEN d > 0 AND d < 2.5 THEN 100.0 ELSE 0 END), 6) AS low, round(avg(CASE WHEN d > 2.5 AND d < 5 THEN 100.0 ELSE 0 END), 6) AS mid,
    round(avg(CASE WHEN d > 5 AND d < 20 THEN 100.0 ELSE 0 END), 6) AS high,
    round(avg(CASE WHEN (d > 0 AND d < 2.5) OR (d > 2.5 AND d < 5) OR (d > 5 AND d < 20) THEN 0 ELSE 100.0 END), 6) AS rest FROM dist""",
)
def _(spark, sf):
    return A.band_shares(T.target_distance(spark, sf), "d")


@query("target_multiplicity", with_views("inter") + "SELECT CASE WHEN d >= 3 THEN '3+' ELSE CAST(d AS VARCHAR) END AS targets, count(*) AS n_drugs FROM (SELECT src, count(*) AS d FROM inter GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    return A.target_multiplicity(T.interactions(spark, sf))


@query(
    "cotarget_distances",
    with_views("inter", "dist") + """SELECT x.src, a, b, d, t.n AS targets, CASE WHEN t.n >= 3 THEN 2 ELSE 1 END AS times FROM dist JOIN inter x ON x.dst = a JOIN inter y ON y.dst = b AND y.src = x.src
    JOIN (SELECT src, count(*) AS n FROM inter GROUP BY 1) t ON t.src = x.src""",
)
def _(spark, sf):
    return A.cotarget_distances(S.checkpointed(T.interactions(spark, sf)), T.target_distance(spark, sf))


@query("summary_over_folds", "SELECT l_returnflag, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std, round(var_pop(l_discount), 6) AS l_discount_var FROM lineitem GROUP BY 1")
def _(spark, sf):
    out = A.summary_over_folds(T.table(spark, sf, "lineitem"), "l_returnflag", ["l_discount"])
    return out.select("l_returnflag", *[R6(c).alias(c) for c in out.columns[1:]])


@query(
    "augmented_stats",
    with_views("affinity") + """, x AS (SELECT dataset AS family, src AS i, dst AS j, max(CASE WHEN y >= 50 THEN 1 ELSE 0 END) AS v FROM affinity
    WHERE src IN (SELECT 'D'||c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1, 2, 3)
    SELECT family, count(DISTINCT i) AS n_rows, count(DISTINCT CASE WHEN v <> 0 THEN j END) AS n_cols, CAST(sum(v) AS BIGINT) AS n_edges FROM x GROUP BY 1""",
)
def _(spark, sf):
    a = T.affinity(spark, sf)
    cells = a.groupBy(F.col("dataset").alias("family"), F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max((F.col("y") >= 50).cast("int")).alias("v"))
    ref = T.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("D"), "c_custkey").alias("id"))
    return A.augmented_stats(cells, ref)


_MATRICES = """, m AS (SELECT a, b, s FROM tsim UNION ALL SELECT b, a, s FROM tsim), n AS (SELECT 'whole' AS name, * FROM m UNION ALL SELECT DISTINCT 'whole', a, a, 1.0 FROM m UNION ALL SELECT 'no diagonal', * FROM m UNION ALL SELECT 'upper', a, b, s FROM tsim
    UNION ALL SELECT 'incidence', src, dst, 1.0 FROM inter UNION ALL SELECT 'not one', * FROM m UNION ALL SELECT DISTINCT 'not one', a, a, 0.5 FROM m)"""


@query(
    "matrix_checks",
    with_views("tsim", "inter") + _MATRICES + """, k AS (SELECT n.*, t.s AS back FROM n LEFT JOIN n t ON t.name = n.name AND t.a = n.b AND t.b = n.a), o AS (SELECT name, a AS id, 1 AS x, 0 AS y FROM n UNION ALL SELECT name, b, 0, 1 FROM n),
    q AS (SELECT name, bool_and(x = 1 AND y = 1) AS square FROM (SELECT name, id, max(x) AS x, max(y) AS y FROM o GROUP BY 1, 2) GROUP BY 1)
    SELECT k.name, any_value(square) AS square, bool_and(coalesce(abs(s - back) < 1e-9, false)) AS symmetric, count(DISTINCT a) = count(CASE WHEN a = b AND s = 1 THEN 1 END) AS unit_diagonal FROM k JOIN q ON q.name = k.name GROUP BY k.name""",
)
def _(spark, sf):
    s = S.checkpointed(T.target_similarity(spark, sf))
    both = E.mirror(s, "s")
    diag = lambda v: E.node_set(s.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(v).alias("s"))
    inter = T.interactions(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("s"))
    matrices = {"whole": both.unionByName(diag(1.0)), "no diagonal": both, "upper": s, "incidence": inter, "not one": both.unionByName(diag(0.5))}
    out = None
    for name, m in matrices.items():
        row = A.matrix_checks(m).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "node_loss",
    with_views("inter") + """, kept AS (SELECT * FROM inter WHERE dst IN (SELECT 'T'||p_partkey FROM part WHERE p_size > 40))
    SELECT 'edges' AS what, (SELECT count(*) FROM inter) - (SELECT count(*) FROM kept) AS lost UNION ALL
    SELECT 'src', (SELECT count(DISTINCT src) FROM inter) - (SELECT count(DISTINCT src) FROM kept) UNION ALL
    SELECT 'dst', (SELECT count(DISTINCT dst) FROM inter) - (SELECT count(DISTINCT dst) FROM kept)""",
)
def _(spark, sf):
    before = T.interactions(spark, sf)
    u = T.table(spark, sf, "part").filter("p_size > 40").select(F.concat(F.lit("T"), "p_partkey").alias("dst"))
    return A.node_loss(before, before.join(u, "dst", "left_semi"))


# -- ranking and indexing ---------------------------------------------------

@query(
    "best_per_group",
    "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'A') WHERE r = 1 AND l_quantity <= 2",
)
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    order = ["l_quantity", "l_orderkey", "l_linenumber"]
    return R.best_per_group(li, ["l_partkey"], order, F.col("l_returnflag") == "A", F.col("l_quantity") <= 2).drop("l_returnflag")


@query("first_per_key", "SELECT l_suppkey, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS l_partkey FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return R.first_per_key(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey")


@query("top_runs", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_runs(o, "o_orderpriority", "o_totalprice", 5, "o_orderkey")


@query("top_entities", with_views("inter") + "SELECT src, count(*) AS degree FROM inter GROUP BY 1 ORDER BY degree DESC, src LIMIT 30")
def _(spark, sf):
    return R.top_entities(T.interactions(spark, sf))


@query("dense_index", with_views("inter") + "SELECT src, row_number() OVER (ORDER BY src) - 1 AS idx FROM (SELECT DISTINCT src FROM inter)")
def _(spark, sf):
    return S.dense_index(T.interactions(spark, sf), "src")


@query(
    "linear_index",
    with_views("inter") + """, r AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i FROM (SELECT DISTINCT src FROM inter)), c AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS j FROM (SELECT DISTINCT dst FROM inter))
    SELECT inter.src, inter.dst, 1 + i + j * (SELECT count(*) FROM r) AS linear FROM inter JOIN r ON inter.src = r.src JOIN c ON inter.dst = c.dst""",
)
def _(spark, sf):
    e = S.checkpointed(T.interactions(spark, sf))
    return R.linear_index(e, e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id"))).select("src", "dst", "linear")


@query(
    "rank_novel",
    with_views("pred") + "SELECT fold, src, dst, round(score, 9) AS score, row_number() OVER (PARTITION BY fold ORDER BY score DESC, md5('|' || src || '|' || dst)) AS rank FROM pred WHERE pred = 1 AND label = 0",
)
def _(spark, sf):
    return R.rank_novel(T.predictions(spark, sf)).withColumn("score", F.round("score", 9))


@query("order_by_median", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1 ORDER BY 2")
def _(spark, sf):
    return R.order_by_median(T.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
