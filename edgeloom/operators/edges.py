"""Edge tables ``(src, dst)`` and pair tables: set operations, joins, sparse matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import checkpointed, salted_join, task_count

TASK_ROWS = 1 << 20  # rows that one task tells apart


# -- set operations ---------------------------------------------------------

def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, smaller id first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def hetero_union(*tables: DataFrame) -> DataFrame:
    """Undirected union graph over edge types."""
    return undirected(reduce(DataFrame.unionByName, [t.select("src", "dst") for t in tables]))


def exclusive_overlaps(memberships: DataFrame, max_size: int = 2) -> DataFrame:
    """Number of ids found in exactly the named data sets; ``memberships`` is (id, dataset)."""
    combos = memberships.distinct().groupBy("id").agg(F.array_sort(F.collect_list("dataset")).alias("ds"))
    combos = combos.filter(F.size("ds") <= max_size).select(F.array_join("ds", "&").alias("datasets"))
    return combos.groupBy("datasets").agg(F.count("*").alias("n"))


def common_ids(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def stack_labels(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.select("src", "dst", F.lit(1).alias("label")).unionByName(neg.select("src", "dst", F.lit(0).alias("label")))


def melt(df: DataFrame, ids, values, variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


# -- pair joins -------------------------------------------------------------

def anti_pairs(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidate pairs that do not interact."""
    return candidates.join(positives.select("src", "dst"), ["src", "dst"], "left_anti")


def label_pairs(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidate pairs with label 1 if they interact, else 0."""
    known = positives.select("src", "dst").distinct().withColumn("_hit", F.lit(1))
    return candidates.join(known, ["src", "dst"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def lookup_pair(df: DataFrame, a: str, b: str, sim: DataFrame, value: str, out: str) -> DataFrame:
    """Value of an unordered pair in a table (a < b); NULL if it is not listed."""
    s = sim.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col(value).alias(out))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return df.join(s, (lo == F.col("_a")) & (hi == F.col("_b")), "left").drop("_a", "_b")


def mirror(sim: DataFrame, value: str) -> DataFrame:
    """Both orientations of a pair table (a < b)."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return sim.select(F.explode(both).alias("_p"), value).select("_p.a", "_p.b", value)


def band_join(pairs: DataFrame, distance: DataFrame, lo: float, hi: float) -> DataFrame:
    """For each (src, dst) the ids at a distance from dst inside the open interval.

    The band is applied before the join, so only wanted neighbours are shuffled.
    """
    near = mirror(distance.filter((F.col("d") > lo) & (F.col("d") < hi)), "d")
    return salted_join(pairs, near.select(F.col("a").alias("dst"), F.col("b").alias("cand"), "d"), ["dst"]).select("src", "dst", "cand", "d")


def symbol_overlap(symbols: DataFrame, interactions: DataFrame) -> DataFrame:
    """Entities linked through their symbols; symbols (id, sym), interactions (sym1, sym2).

    Symbols are resolved one side at a time; no pair of entities is tested that no
    interaction row names.
    """
    deal = lambda df, n, *by: df.repartition(task_count(df.sparkSession, n, TASK_ROWS), *by).distinct()
    syms, rows = symbols.select("id", "sym"), interactions.select("sym1", "sym2")
    n_syms = syms.count()
    syms, rows = checkpointed(deal(syms, n_syms, "id", "sym")), checkpointed(deal(rows, rows.count(), "sym1", "sym2"))
    # How many rows the joins make: tasks grow with them, so that what one task tells apart does not.
    by_sym = syms.select("sym").repartition(task_count(syms.sparkSession, n_syms, TASK_ROWS), "sym")
    named = lambda c, n: by_sym.groupBy(F.col("sym").alias(c)).agg(F.count("*").alias(n))
    sizes = rows.join(named("sym1", "_n"), "sym1").join(named("sym2", "_m"), "sym2", "left")
    n_left, n_hits = sizes.agg(F.sum(F.col("_n").cast("double")), F.sum(F.col("_n").cast("double") * F.col("_m"))).first()
    left = rows.join(syms.select(F.col("sym").alias("sym1"), F.col("id").alias("p")), "sym1").select("p", "sym2")
    left = deal(left, n_left or 0, "p", "sym2")
    hits = left.join(syms.select(F.col("sym").alias("sym2"), F.col("id").alias("q")), "sym2").filter(F.col("p") != F.col("q"))
    hits = hits.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"))
    return deal(hits, n_hits or 0, "src", "dst")


def annotate(df: DataFrame, annotation: DataFrame, on, cols, order: str, fill: str = "-") -> DataFrame:
    """Left join of the first annotation per key; missing values become ``fill``."""
    on = [on] if isinstance(on, str) else list(on)
    first = annotation.groupBy(*on).agg(*[F.min_by(c, order).alias(c) for c in cols])
    return salted_join(df, first, on, "left").na.fill(fill, subset=list(cols))


def pair_embeddings(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """Both endpoint vectors and their concatenation; emb is (id, vec)."""
    s = emb.select(F.col("id").alias("src"), F.col("vec").alias("src_vec"))
    d = emb.select(F.col("id").alias("dst"), F.col("vec").alias("dst_vec"))
    return salted_join(salted_join(edges, s, ["src"]), d, ["dst"]).withColumn("vec", F.concat("src_vec", "dst_vec"))


def slice_matrix(cells: DataFrame, ids: DataFrame, rows: str = "a", cols: str = "b") -> DataFrame:
    """Cells whose row and column are both listed."""
    for side in (rows, cols):
        cells = salted_join(cells, ids.select(F.col("id").alias(side)).distinct(), [side], "left_semi")
    return cells


def align_matrices(matrices, edges_ids: DataFrame | None = None) -> list[DataFrame]:
    """Every matrix restricted to the ids that all of them (and the edges) know."""
    sets = [m.select(F.explode(F.array("a", "b")).alias("id")).distinct() for m in matrices]
    if edges_ids is not None:
        sets.append(edges_ids.select("id").distinct())
    shared = common_ids(*sets)
    return [slice_matrix(m, shared) for m in matrices]


# -- sparse matrices --------------------------------------------------------

def incidence(edges: DataFrame) -> DataFrame:
    """0/1 matrix in sparse form: one cell per distinct pair."""
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).distinct().withColumn("v", F.lit(1))


def dense_incidence(edges: DataFrame, rows: DataFrame, columns) -> DataFrame:
    """Explicit 0/1 columns for export; ``columns`` is the given, ordered column list."""
    wide = edges.groupBy(F.col("src").alias("id")).pivot("dst", list(columns)).agg(F.max(F.lit(1)))
    return rows.select("id").distinct().join(wide, "id", "left").na.fill(0)


def upper_triangle(sim: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Cells on and above the diagonal, by id or by a given position table (id, pos)."""
    if order is None:
        return sim.filter(F.col("a") <= F.col("b"))
    pa = order.select(F.col("id").alias("a"), F.col("pos").alias("_pa"))
    pb = order.select(F.col("id").alias("b"), F.col("pos").alias("_pb"))
    return sim.join(pa, "a").join(pb, "b").filter(F.col("_pa") <= F.col("_pb")).drop("_pa", "_pb")


def edges_from_incidence(cells: DataFrame) -> DataFrame:
    """Non-zero cells as edges."""
    return cells.filter(F.col("v") != 0).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def undirected_edge_count(edges: DataFrame) -> DataFrame:
    """(sum of the symmetric matrix − diagonal) / 2 + diagonal, from both directions."""
    weight = F.when(F.col("src") == F.col("dst"), 2).otherwise(1)
    return edges.agg((F.sum(weight) / 2).cast("long").alias("n_edges"))


def split_by_source(df: DataFrame, col: str, tags) -> DataFrame:
    """A copy of the row for every tag its text contains; ``tags`` is a short literal list."""
    hits = F.filter(F.array(*[F.lit(t) for t in tags]), lambda t: F.contains(F.col(col), t))
    return df.withColumn("tag", F.explode(hits))
