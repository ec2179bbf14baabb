"""Ranking, top-k and indexing.

A ``row_number() <= k`` filter lets Spark keep only k rows per group before the
shuffle, so a hot group never travels whole. All orderings end with the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .edges import mirror
from .scale import cut_points, dense_index, range_bucket, ranked_by_value, running_sum, salted_join


def top_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def best_per_group(df: DataFrame, keys, order, pre: Column | None = None, post: Column | None = None) -> DataFrame:
    """Best row per key among those passing ``pre``; kept if it also passes ``post``."""
    best = top_per_group(df.filter(pre) if pre is not None else df, keys, order, 1)
    return best.filter(post) if post is not None else best


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def knn_edges(sim: DataFrame, k: int, value: str = "s") -> DataFrame:
    """k most similar others per node as edges (src, dst, s)."""
    both = mirror(sim.filter(F.col("a") != F.col("b")), value)
    w = W.partitionBy("a").orderBy(F.desc(value), "b")
    top = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("a").alias("src"), F.col("b").alias("dst"), value, "rank")


def strongest_k(sim: DataFrame, k: int = 5, value: str = "s") -> DataFrame:
    """Symmetric graph of the k strongest links per row."""
    return linked(knn_edges(sim, k, value), value)


def linked(top: DataFrame, value: str = "s") -> DataFrame:
    """Neighbour lists (src, dst) as unordered pairs."""
    return top.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), value).distinct()


def top_runs(metric: DataFrame, group: str, by: str, n: int, tie: str = "run") -> DataFrame:
    return top_per_group(metric, [group], [F.desc(by), F.asc(tie)], n)


def top_entities(edges: DataFrame, col: str = "src", n: int = 30) -> DataFrame:
    """Ids of highest degree: a top-k report."""
    return edges.groupBy(col).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), col).limit(n)


def linear_index(pairs: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Column-major 1-based position ``1 + i + n_rows·j`` of a pair in the full matrix."""
    i = dense_index(rows.select(F.col("id").alias("src")), "src", "i")
    j = dense_index(cols.select(F.col("id").alias("dst")), "dst", "j")
    n = i.count()
    return pairs.join(i, "src").join(j, "dst").withColumn("linear", F.lit(1) + F.col("i") + F.lit(n) * F.col("j"))


def rank_novel(pred: DataFrame, cuts=None) -> DataFrame:
    """Predicted but unknown pairs of each fold, ranked by descending score.

    Ties follow the md5 order of the pair.
    """
    novel = pred.filter((F.col("pred") == 1) & (F.col("label") == 0)).drop("pred", "label")
    return ranked_by_value(novel, ["fold"], "score", order_key("", "src", "dst"), cuts=cuts)


def group_median(df: DataFrame, group, value: str) -> DataFrame:
    """Exact median per group from value counts; no group is collected."""
    group = [group] if isinstance(group, str) else list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    cuts = cut_points(df, value)
    upto = running_sum(counts, group, [value], range_bucket(F.col(value), cuts), {"_upto": F.col("_n")})
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    lo, hi = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    x = salted_join(upto, totals, group)
    hit_lo = (F.col("_upto") >= lo) & (F.col("_upto") - F.col("_n") < lo)
    hit_hi = (F.col("_upto") >= hi) & (F.col("_upto") - F.col("_n") < hi)
    mid = (F.max(F.when(hit_lo, F.col(value))) + F.max(F.when(hit_hi, F.col(value)))) / 2
    return x.filter(hit_lo | hit_hi).groupBy(*group).agg(mid.alias("median"))


def order_by_median(df: DataFrame, group: str, value: str) -> DataFrame:
    return group_median(df, group, value).orderBy("median", group)
