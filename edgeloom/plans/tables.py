"""Interaction-network views of the given tables, in Spark and as shared SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def affinity(spark, sf) -> DataFrame:
    """(src drug, dst target, y): customers as drugs, parts as targets, quantity as affinity."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.join(o, "l_orderkey").select(
        F.concat(F.lit("D"), F.col("o_custkey")).alias("src"), F.concat(F.lit("T"), F.col("l_partkey")).alias("dst"),
        F.col("l_quantity").alias("y"), F.col("o_orderpriority").alias("dataset"), "l_orderkey", "l_linenumber",
    )


def interactions(spark, sf) -> DataFrame:
    return affinity(spark, sf).filter(F.col("y") < 30).select("src", "dst").distinct()


def order_edges(spark, sf) -> DataFrame:
    """(src customer, dst order): a star, and so a component, for each customer."""
    return table(spark, sf, "orders").select(F.concat(F.lit("D"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst"))


def known_interactions(spark, sf) -> DataFrame:
    """Interactions of nine drugs in ten; the others stand for new drugs."""
    from ..functions.hashing import order_key

    return interactions(spark, sf).filter(order_key("new", "src") >= "1a")


def side_effects(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("D"), F.col("user_id")).alias("src"),
        F.concat(F.lit("S"), F.get_json_object("props", "$.k")).alias("dst"),
    ).distinct()


def supply(spark, sf) -> DataFrame:
    """(src target, dst supplier): a dense bipartite side network."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("T"), F.col("l_partkey")).alias("src"), F.concat(F.lit("P"), F.col("l_suppkey")).alias("dst")).distinct()


def geography(spark, sf) -> DataFrame:
    """Tree of suppliers and customers under nations under regions, as edges."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("dst"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("D"), F.col("c_custkey")).alias("src"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("dst"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("dst"))
    return s.unionByName(c).unionByName(n)


def sequences(spark, sf) -> DataFrame:
    """Whole page addresses as sequences."""
    return table(spark, sf, "pages").select(F.concat(F.lit("Q"), F.col("page_id")).alias("id"), F.col("url").alias("seq"))


def drug_features(spark, sf) -> DataFrame:
    """(id, f, w): nation, segment and a constant of every customer."""
    c = table(spark, sf, "customer")
    f = F.explode(F.array(F.concat(F.lit("nation"), "c_nationkey"), "c_mktsegment", F.lit("one")))
    return c.select(F.concat(F.lit("D"), "c_custkey").alias("id"), f.alias("f"), F.lit(1.0).alias("w"))


def target_features(spark, sf) -> DataFrame:
    """(id, f, w): brand, type, size and a constant of every part."""
    p = table(spark, sf, "part")
    f = F.explode(F.array("p_brand", "p_type", F.concat(F.lit("size"), "p_size"), F.lit("one")))
    return p.select(F.concat(F.lit("T"), "p_partkey").alias("id"), f.alias("f"), F.lit(1.0).alias("w"))


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vec"), "label")


def predictions(spark, sf) -> DataFrame:
    """(fold, src, dst, score, pred, label): document quality as label, relative length as score."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    top = d.agg(F.max("n_chars").alias("_m"))
    x = d.join(lab, "doc_id").join(F.broadcast(top))
    score = F.col("n_chars") / F.col("_m")
    return x.select(
        (F.col("doc_id") % 10).cast("int").alias("fold"), F.col("source").alias("src"), F.col("doc_id").cast("string").alias("dst"),
        score.alias("score"), (F.col("n_chars") >= 1000).cast("int").alias("pred"), F.col("quality").alias("label"),
    )


def _ranked_neighbours(own, feature):
    return (
        f"SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM (SELECT x.id AS src, y.id AS dst, coalesce(o, 0) * 1.0 / (x.n + y.n - coalesce(o, 0)) AS s "
        f"FROM (SELECT {own} AS id, count(*) AS n FROM inter GROUP BY 1) x JOIN (SELECT {own} AS id, count(*) AS n FROM inter GROUP BY 1) y ON x.id <> y.id "
        f"LEFT JOIN (SELECT p.{own} AS a, q.{own} AS b, count(*) AS o FROM inter p JOIN inter q ON p.{feature} = q.{feature} GROUP BY 1, 2) ON a = x.id AND b = y.id)"
    )


# The same views for the SQL side; `with_views("inter", …)` adds what each needs.
_VIEWS = {
    "affinity": "SELECT 'D'||o_custkey AS src, 'T'||l_partkey AS dst, l_quantity AS y, o_orderpriority AS dataset, "
    "l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "inter": "SELECT DISTINCT src, dst FROM affinity WHERE y < 30",
    "stars": "SELECT 'D'||o_custkey AS src, 'O'||o_orderkey AS dst FROM orders",
    "known": "SELECT src, dst FROM inter WHERE md5('new|' || src) >= '1a'",
    "se": "SELECT DISTINCT 'D'||user_id AS src, 'S'||json_extract_string(props, '$.k') AS dst FROM events",
    "supply": "SELECT DISTINCT 'T'||l_partkey AS src, 'P'||l_suppkey AS dst FROM lineitem",
    "geo": "SELECT 'P'||s_suppkey AS src, 'N'||s_nationkey AS dst FROM supplier UNION ALL "
    "SELECT 'D'||c_custkey, 'N'||c_nationkey FROM customer UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey FROM nation",
    "seqs": "SELECT 'Q'||page_id AS id, url AS seq FROM pages",
    "emb": "SELECT 'V'||vec_id AS id, embedding AS vec, label FROM embeddings",
    "pred": "SELECT CAST(d.doc_id % 10 AS INTEGER) AS fold, d.source AS src, CAST(d.doc_id AS VARCHAR) AS dst, "
    "d.n_chars / (SELECT CAST(max(n_chars) AS DOUBLE) FROM documents) AS score, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred, "
    "l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    # Jaccard similarity of targets by shared drugs, and a distance made from it.
    "tsim": "SELECT a, b, o * 1.0 / (na + nb - o) AS s FROM (SELECT x.dst AS a, y.dst AS b, count(*) AS o FROM inter x JOIN inter y "
    "ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2) p JOIN (SELECT dst AS ka, count(*) AS na FROM inter GROUP BY 1) ON a = ka "
    "JOIN (SELECT dst AS kb, count(*) AS nb FROM inter GROUP BY 1) ON b = kb WHERE o * 1.0 / (na + nb - o) >= 0.05 - 1e-9",
    "dist": "SELECT a, b, round(8 - 60 * s, 6) AS d FROM tsim",
    "dsim": "SELECT a, b, o * 1.0 / (na + nb - o) AS s FROM (SELECT x.src AS a, y.src AS b, count(*) AS o FROM inter x JOIN inter y "
    "ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) p JOIN (SELECT src AS ka, count(*) AS na FROM inter GROUP BY 1) ON a = ka "
    "JOIN (SELECT src AS kb, count(*) AS nb FROM inter GROUP BY 1) ON b = kb WHERE o * 1.0 / (na + nb - o) >= 0.05 - 1e-9",
    # All neighbours of a row in order, those that share nothing included.
    "tall": _ranked_neighbours("dst", "src"),
    "dall": _ranked_neighbours("src", "dst"),
    # The five strongest links per row.
    "ttop": "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, s FROM tall WHERE rank <= 5",
    "dtop": "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, s FROM dall WHERE rank <= 5",
    # Labelled pairs dealt to ten folds for two seeds.
    "lab": "SELECT src, dst, max(CASE WHEN y < 30 THEN 1 ELSE 0 END) AS label FROM affinity GROUP BY 1, 2",
    "folds": "SELECT seed, src, dst, label, CAST((row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || src || '|' || dst), src, dst) - 1) % 10 AS INTEGER) AS fold "
    "FROM lab, (SELECT unnest([0, 1]) AS seed)",
}
_NEEDS = {
    "inter": ["affinity"], "known": ["affinity", "inter"], "tsim": ["affinity", "inter"], "dist": ["affinity", "inter", "tsim"], "dsim": ["affinity", "inter"],
    "tall": ["affinity", "inter"], "dall": ["affinity", "inter"], "ttop": ["affinity", "inter", "tall"], "dtop": ["affinity", "inter", "dall"], "lab": ["affinity"], "folds": ["affinity", "lab"],
}


def with_views(*names: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` clause that defines the named views and what they build on."""
    order: list[str] = []
    for n in names:
        order += [m for m in [*_NEEDS.get(n, []), n] if m not in order]
    clauses = [f"{n} AS ({_VIEWS[n]})" for n in order]
    if extra:
        clauses.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(clauses) + " "


def target_similarity(spark, sf) -> DataFrame:
    from ..operators.kernels import jaccard, profiles

    return jaccard(profiles(interactions(spark, sf), "dst", "src"), 0.05)


def drug_similarity(spark, sf) -> DataFrame:
    from ..operators.kernels import jaccard, profiles

    return jaccard(profiles(interactions(spark, sf)), 0.05)


def target_neighbours(spark, sf, k) -> DataFrame:
    from ..operators.kernels import profiles
    from ..operators.overlap import knn

    return knn(profiles(interactions(spark, sf), "dst", "src"), k)


def drug_neighbours(spark, sf, k) -> DataFrame:
    from ..operators.kernels import profiles
    from ..operators.overlap import knn

    return knn(profiles(interactions(spark, sf)), k)


def target_distance(spark, sf) -> DataFrame:
    """Stand-in for the given structure distances: 8 − 60·s for alike targets."""
    return target_similarity(spark, sf).select("a", "b", F.round(F.lit(8.0) - F.lit(60.0) * F.col("s"), 6).alias("d"))


def labelled_pairs(spark, sf) -> DataFrame:
    """All pairs: 1 if they interact (some affinity below 30), else 0."""
    a = affinity(spark, sf)
    return a.groupBy("src", "dst").agg(F.max((F.col("y") < 30).cast("int")).alias("label"))


def labelled_folds(spark, sf, n: int = 10, seeds=(0, 1)) -> DataFrame:
    from functools import reduce

    from ..operators.splits import kfold

    pairs = labelled_pairs(spark, sf)
    return reduce(DataFrame.unionByName, [kfold(pairs, n, s).withColumn("seed", F.lit(s)) for s in seeds])
