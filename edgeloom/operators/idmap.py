"""Identifier mapping.

Maps are tables ``(k, v[, ord])``. They are reduced to one value per key by an
aggregate that combines on the map side, then joined with the hot ids of the data
salted; whether the reduced map is broadcast is left to Spark, which checks its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import salted_join


def reduce_map(idmap: DataFrame, keep: str = "first", k: str = "k", v: str = "v", ord: str = "ord") -> DataFrame:
    """One value per key: the first or the last by ``ord`` (ties by the value)."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    order = F.struct(ord, v) if ord in idmap.columns else F.col(v)
    return idmap.filter(F.col(k).isNotNull()).groupBy(k).agg(pick(v, order).alias(v))


def map_ids(df: DataFrame, col: str, idmap: DataFrame, keep: str = "first", out: str | None = None) -> DataFrame:
    """Left lookup of ``col`` in a map; ids without an entry become NULL."""
    m = reduce_map(idmap, keep).select(F.col("k").alias("_k"), F.col("v").alias("_v"))
    mapped = salted_join(df.withColumn("_k", F.col(col).cast(dict(m.dtypes)["_k"])), m, ["_k"], "left")
    return mapped.withColumn(out or col, F.col("_v")).drop("_k", "_v")


def compose_maps(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Multi-hop map: values of one are keys of the next.

    ``first`` may list several values per key; of those that reach the end the
    last one by ``ord`` wins.
    """
    hop = first.select("k", F.col("v").alias("_h"), *([F.col("ord")] if "ord" in first.columns else [F.col("v").alias("ord")]))
    for m in rest:
        r = reduce_map(m, "last").select(F.col("k").alias("_h"), F.col("v").alias("_n"))
        hop = hop.join(r, "_h").select("k", F.col("_n").alias("_h"), "ord")
    return hop.groupBy("k").agg(F.max_by("_h", F.struct("ord", "_h")).alias("v"))


def map_cascade(df: DataFrame, col: str, maps, out: str) -> DataFrame:
    """Value of the first map in the list that knows the id."""
    names = []
    for i, m in enumerate(maps):
        names.append(f"_c{i}")
        df = map_ids(df, col, m, keep="last", out=names[-1])
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def map_two_keys(df: DataFrame, k1: str, k2: str, idmap: DataFrame, out: str, mode: str = "coalesce") -> DataFrame:
    """Map two alternative ids of a row.

    ``coalesce`` takes the second and falls back to the first. ``reference`` takes
    the second even when it is NULL.
    """
    both = map_ids(map_ids(df, k1, idmap, out="_v1"), k2, idmap, out="_v2")
    value = F.col("_v2") if mode == "reference" else F.coalesce("_v2", "_v1")
    return both.withColumn(out, value).drop("_v1", "_v2")


def restrict(df: DataFrame, col: str, universe: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in the universe."""
    u = universe.select(F.col(key).alias(col)).filter(F.col(col).isNotNull()).distinct()
    return salted_join(df, u, [col], "left_semi")


def match_names(names: DataFrame, dictionary: DataFrame, cleaned, case: str = "case", name: str = "name") -> DataFrame:
    """Match a name as it stands, else its cleaned form; distinct (case, name, id).

    ``dictionary`` is (name, id); ``cleaned`` is the cleaning rule as a column of ``name``.
    """
    d = reduce_map(dictionary.select(F.col("name").alias("k"), F.col("id").alias("v")), "last")
    exact = d.select(F.col("k").alias("_k1"), F.col("v").alias("_v1"))
    loose = d.select(F.col("k").alias("_k2"), F.col("v").alias("_v2"))
    x = names.select(case, name).distinct().withColumn("_clean", cleaned)
    x = x.join(exact, F.col(name) == F.col("_k1"), "left").join(loose, F.col("_clean") == F.col("_k2"), "left")
    hit = F.when(F.col("_v1").isNotNull(), F.col(name)).otherwise(F.col("_clean"))
    x = x.select(case, hit.alias(name), F.coalesce("_v1", "_v2").alias("id"))
    return x.filter(F.col("id").isNotNull()).distinct()
