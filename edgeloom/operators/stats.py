"""Aggregates: collapsing measurements, report terms, data-set and matrix statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import undirected
from .graph import component_sizes, connected_components
from .rank import group_median
from .scale import ranked, salted_join

_HOW = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def collapse_pairs(df: DataFrame, keys, value: str, how: str = "sum", first=(), order: str | None = None) -> DataFrame:
    """One row per pair: the value reduced by ``how``, other columns of the first row by ``order``.

    ``how`` is sum, avg, max, min or median.
    """
    picks = [F.min_by(c, order).alias(c) for c in first]
    if how == "median":
        out = group_median(df, list(keys), value).withColumnRenamed("median", value)
        return out.join(df.groupBy(*keys).agg(*picks), list(keys)) if picks else out
    return df.groupBy(*keys).agg(_HOW[how](value).alias(value), *picks)


def harmonize(df: DataFrame, how: str = "max") -> DataFrame:
    """Repeated measurements of a (src, dst) pair reduced to one."""
    return collapse_pairs(df, ["src", "dst"], "y", how)


# -- report terms -----------------------------------------------------------

def term_frequency(events: DataFrame, cases: DataFrame, min_n: int = 5, max_f: float = 0.001) -> DataFrame:
    """Terms of kept cases with count above ``min_n`` and relative frequency below ``max_f``.

    Events are (case, term). The denominator counts every term that holds a non-digit.
    """
    kept = events.join(cases.select("case").distinct(), "case", "left_semi").filter(F.col("term").rlike(r"\D"))
    counts = kept.groupBy("term").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    freq = counts.join(F.broadcast(total)).withColumn("f", F.col("n") / F.col("_total"))
    return freq.filter((F.col("n") > min_n) & (F.col("f") < max_f)).select("term", "n", "f")


def drug_profile(case_drug: DataFrame, case_term: DataFrame, freq: DataFrame) -> DataFrame:
    """(drug, term, f, bit): terms reported in any case of the drug, with their global frequency."""
    # Terms without a frequency are left out before the wide join.
    terms = salted_join(case_term.select("case", "term").distinct(), freq.select("term", "f"), ["term"])
    pairs = salted_join(case_drug.select("case", "drug").distinct(), terms, ["case"])
    cells = pairs.select("drug", "term", "f").distinct()
    return cells.select("drug", "term", "f", (F.col("f") > 0).cast("int").alias("bit"))


def collect_terms(df: DataFrame, key: str, term: str, where: Column) -> DataFrame:
    """Distinct terms per id in order: (key, term, position from 1). A list of any length, one term a row."""
    kept = df.filter(where & F.col(term).isNotNull()).select(key, term).distinct()
    return ranked(kept, [key], [term], F.ascii(F.col(term)), "position")


# -- categories -------------------------------------------------------------

def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def collapse_rare(df: DataFrame, col: str, min_n: int = 10, other: str = "other") -> DataFrame:
    """Categories seen fewer than ``min_n`` times become ``other``."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_n).select(col, F.lit(True).alias("_keep"))
    return salted_join(df, counts, [col], "left").withColumn(col, F.when(F.col("_keep"), F.col(col)).otherwise(F.lit(other))).drop("_keep")


def mean_filter(df: DataFrame, key: str, value: str, gt: float = 70.0) -> DataFrame:
    """Group means rounded to 2 digits, those above the limit."""
    return df.groupBy(key).agg(F.round(F.avg(value), 2).alias("mean")).filter(F.col("mean") > gt)


def tabulate(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None, scale: bool = False) -> DataFrame:
    """Equal-width bins 1…n over [lo, hi]; the top edge falls into the last bin.

    ``scale`` moves the values to [0, 1] first by their minimum and maximum.
    """
    x = df.filter(F.col(col).isNotNull())
    if scale or lo is None or hi is None:
        span = x.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        x = x.join(F.broadcast(span))
        if scale:
            width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
            x = x.withColumn("_v", (F.col(col) - F.col("_lo")) / width).withColumn("_lo", F.lit(0.0)).withColumn("_hi", F.lit(1.0))
        else:
            x = x.withColumn("_v", F.col(col))
    else:
        x = x.select(F.col(col).alias("_v"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    x = x.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    pos = F.floor((F.col("_v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))) + 1
    return x.select(F.least(F.coalesce(pos, F.lit(1)), F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def band_shares(df: DataFrame, value: str) -> DataFrame:
    """Percent of values in (0, 2.5), (2.5, 5), (5, 20) and the rest, limits included in the rest."""
    v = F.col(value)
    bands = [("low", 0.0, 2.5), ("mid", 2.5, 5.0), ("high", 5.0, 20.0)]
    inside = {n: (v > a) & (v < b) for n, a, b in bands}
    share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 6)
    rest = ~reduce(lambda p, q: p | q, inside.values())
    return df.filter(v.isNotNull()).agg(*[share(c).alias(n) for n, c in inside.items()], share(rest).alias("rest"))


# -- data sets and networks -------------------------------------------------

def degrees(edges: DataFrame) -> DataFrame:
    """Degree per node and side; edges are distinct pairs."""
    ends = F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.side", "e.id").agg(F.count("*").alias("degree"))


def density_stats(edges: DataFrame) -> DataFrame:
    """Nodes per side, edges, density in percent and mean degrees of a bipartite table."""
    n = edges.agg(F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"), F.count("*").alias("n_edges"))
    total = F.col("n_src") + F.col("n_dst")
    return n.select(
        "n_src", "n_dst", total.alias("n_nodes"), "n_edges",
        F.round(F.lit(200.0) * F.col("n_edges") / (total * (total - 1)), 2).alias("density"),
        F.round(F.col("n_edges") / F.col("n_src"), 6).alias("mean_degree_src"),
        F.round(F.col("n_edges") / F.col("n_dst"), 6).alias("mean_degree_dst"),
    )


def dataset_stats(edges: DataFrame) -> DataFrame:
    """``density_stats`` and the number and largest size of connected components."""
    sizes = component_sizes(connected_components(edges))
    comp = sizes.agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"))
    return density_stats(edges).join(F.broadcast(comp))


def hetero_counts(edges: DataFrame) -> DataFrame:
    """Undirected edges per type of a typed table (etype, src, dst)."""
    return (
        edges.select("etype", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        .groupBy("etype").agg(F.count("*").alias("n_edges"))
    )


def restricted(networks: dict) -> DataFrame:
    """Typed union (etype, src, dst) of {etype: (edges, side, ids)}: an edge stays if its ``side`` is listed (all stay where that is None)."""
    out = None
    for etype, (edges, side, ids) in networks.items():
        kept = edges if side is None else edges.join(ids.select(F.col("id").alias(side)), side, "left_semi")
        rows = kept.select(F.lit(etype).alias("etype"), "src", "dst").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def hetero_stats(edges: DataFrame, node_types: DataFrame) -> DataFrame:
    """Union-graph edges, components and E / (Πn − E) over the node counts per type.

    ``node_types`` is (ntype, id).
    """
    union = undirected(edges.select("src", "dst"))
    comp = component_sizes(connected_components(union)).agg(F.count("*").alias("n_components"))
    counts = node_types.distinct().groupBy("ntype").agg(F.count("*").cast("double").alias("n"))
    prod = counts.agg(F.sum("n").cast("long").alias("n_nodes"), F.exp(F.sum(F.log("n"))).alias("_p"))
    m = union.agg(F.count("*").alias("n_edges"))
    out = m.join(F.broadcast(prod)).join(F.broadcast(comp))
    return out.select("n_nodes", "n_edges", "n_components", (F.col("n_edges") / (F.col("_p") - F.col("n_edges"))).alias("sparsity"))


def target_multiplicity(edges: DataFrame) -> DataFrame:
    """Number of drugs with 1, 2 and 3 or more targets."""
    deg = edges.groupBy("src").agg(F.count("*").alias("_d"))
    group = F.when(F.col("_d") >= 3, "3+").otherwise(F.col("_d").cast("string"))
    return deg.groupBy(group.alias("targets")).agg(F.count("*").alias("n_drugs"))


def cotarget_distances(edges: DataFrame, distance: DataFrame) -> DataFrame:
    """Listed distances between targets of one drug: (src, a, b, d, targets, times).

    Works from the listed pairs: the endpoint with fewer drugs is expanded and the
    other one is checked, so no drug's targets are paired with each other.
    ``times`` is 2 for drugs of three or more targets (both orders), else 1.
    """
    deg = edges.groupBy("dst").agg(F.count("*").alias("_n"))
    p = distance.join(deg.select(F.col("dst").alias("a"), F.col("_n").alias("_na")), "a")
    p = p.join(deg.select(F.col("dst").alias("b"), F.col("_n").alias("_nb")), "b")
    few = F.when(F.col("_na") <= F.col("_nb"), F.col("a")).otherwise(F.col("b"))
    many = F.when(F.col("_na") <= F.col("_nb"), F.col("b")).otherwise(F.col("a"))
    p = p.select("a", "b", "d", few.alias("_few"), many.alias("_many"))
    e = edges.select("src", "dst")
    hits = p.join(e.withColumnRenamed("dst", "_few"), "_few").join(e.withColumnRenamed("dst", "_many"), ["src", "_many"], "left_semi")
    own = edges.groupBy("src").agg(F.count("*").alias("targets"))
    out = hits.select("src", "a", "b", "d").join(own, "src")
    return out.withColumn("times", F.when(F.col("targets") >= 3, 2).otherwise(1))


def summary_over_folds(metric: DataFrame, group: str, values) -> DataFrame:
    """Mean, population standard deviation and variance per metric."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("var", F.var_pop))]
    return metric.groupBy(group).agg(*aggs)


def augmented_stats(cells: DataFrame, reference: DataFrame, count_zero: bool = True) -> DataFrame:
    """Per matrix family (family, i, j, v): rows and columns with a reference row, non-zero cells.

    Columns without any non-zero cell are not counted as nodes when ``count_zero`` is set.
    """
    x = cells.join(reference.select(F.col("id").alias("i")).distinct(), "i", "left_semi")
    full = x.groupBy("family").agg(F.count_distinct("i").alias("n_rows"), F.count_distinct("j").alias("_cols"), F.count("*").alias("_cells"))
    live = x.filter(F.col("v") != 0).groupBy("family").agg(F.count_distinct("j").alias("_live"), F.count("*").alias("_nz"))
    out = full.join(live, "family", "left")
    pick = lambda a, b: F.coalesce(a, F.lit(0)) if count_zero else F.col(b)
    return out.select("family", "n_rows", pick("_live", "_cols").alias("n_cols"), pick("_nz", "_cells").alias("n_edges"))


def matrix_checks(cells: DataFrame) -> DataFrame:
    """Whether a labelled matrix (a, b, s) is square, symmetric and has a unit diagonal."""
    back = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("s").alias("_t"))
    m = cells.join(back, ["a", "b"], "left")
    ids_a, ids_b = cells.select(F.col("a").alias("id")).distinct(), cells.select(F.col("b").alias("id")).distinct()
    odd = ids_a.subtract(ids_b).unionByName(ids_b.subtract(ids_a)).agg((F.count("*") == 0).alias("square"))
    on_diag = F.col("a") == F.col("b")
    checks = m.agg(
        F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("s") - F.col("_t")) < 1e-9, F.lit(False))), F.lit(True)).alias("symmetric"),
        F.coalesce(F.bool_and(F.when(on_diag, F.col("s") == 1.0)), F.lit(True)).alias("_unit"),
        F.count(F.when(on_diag, 1)).alias("_diag"), F.count_distinct("a").alias("_n"),
    )
    return checks.join(F.broadcast(odd)).select("square", "symmetric", (F.col("_unit") & (F.col("_diag") == F.col("_n"))).alias("unit_diagonal"))


def node_loss(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges and nodes per side that a mapping or restriction lost."""
    parts = []
    for what, cols in (("edges", ["src", "dst"]), ("src", ["src"]), ("dst", ["dst"])):
        b, a = before.select(*cols).distinct(), after.select(*cols).distinct()
        parts.append(b.join(a, cols, "left_anti").agg(F.lit(what).alias("what"), F.count("*").alias("lost")))
    return reduce(DataFrame.unionByName, parts)
