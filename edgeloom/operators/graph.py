"""Graph operators: components, hop distances, random walks, meta-path scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import symmetrize, undirected
from .scale import checkpointed, dense_index, salted_join
from .walks import biased_walks  # noqa: F401

LISTED = 1024  # rows of a matrix product that travel as one list
TASK_PATHS = 1 << 21  # paths that one task adds up


def augment_graph(edges: DataFrame, src_near: DataFrame, dst_near: DataFrame) -> DataFrame:
    """Interactions plus the nearest neighbours (src, dst, s) on both sides, as (src, dst, weight, etype)."""
    part = lambda e, w, t: e.select("src", "dst", w.cast("double").alias("weight"), F.lit(t).alias("etype"))
    return (
        part(edges, F.lit(1.0), "interaction")
        .unionByName(part(src_near, F.col("s"), "src_knn"))
        .unionByName(part(dst_near, F.col("s"), "dst_knn"))
    )


def mask_fold(edges: DataFrame, test: DataFrame) -> DataFrame:
    """Interactions without those of the test fold."""
    return edges.join(test.select("src", "dst"), ["src", "dst"], "left_anti")


# -- components -------------------------------------------------------------

def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) where the component is named by its smallest id.

    Alternates two star contractions: every neighbour above a node is linked to the
    node's smallest neighbour, then the same below. Each round is a minimum per node
    and a join back; a hub's edges are salted. Rounds grow with the logarithm of the
    longest path.
    """
    e = checkpointed(undirected(edges))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    links = e.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("lo"), F.col("dst").alias("hi"))

    def large_star(x, n):
        both = x.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(x.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        up = both.filter(F.col("v") > F.col("u"))
        return salted_join(up, low, ["u"], rows=n).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()

    def small_star(x, n):
        low = x.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        down = salted_join(x.select(F.col("hi").alias("u"), F.col("lo").alias("v")), low, ["u"], rows=n)
        linked = down.filter(F.col("v") != F.col("m")).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        return linked.unionByName(low.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()

    mark, n = None, e.count()
    while True:  # edges only move to smaller ids, so an unchanged set comes
        links = checkpointed(small_star(large_star(links, n), n))
        # Edge set unchanged ⇔ same size and same hash sums.
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == mark:
            break
        mark, n = now, max(n, now[0])
    root = links.select(F.col("hi").alias("id"), F.col("lo").alias("_root"))
    return nodes.join(root, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


# -- distances --------------------------------------------------------------

def hop_distance(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest hop counts (source, id, hops) from given sources to all they reach, or up to ``max_hops``.

    Sources that have no edge are left out. Sixty-four sources share a long: a node's word has the bits of those that
    reach it in this step, so a step is one join of words with edges and one ``bit_or``. Edges lead both ways, hence a
    neighbour of a node at h hops is at h − 1, h or h + 1: a step takes off the bits of the last two steps and
    needs no table of all that was seen.
    """
    both = checkpointed(symmetrize(edges))
    n_edges = both.count()
    names = dense_index(sources.select("id").join(both.select(F.col("src").alias("id")), "id", "left_semi"), "id", "_i")
    names = names.select(F.col("id").alias("source"), F.shiftright("_i", 6).alias("word"), F.pmod("_i", F.lit(64)).cast("int").alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    last = checkpointed(names.select(F.col("source").alias("id"), "word", mask.alias("mask")))
    known, steps = last, [last.withColumn("hops", F.lit(0))]
    none, hop = F.lit(0).cast("long"), 0
    while hop != max_hops:
        hop += 1
        reached = salted_join(both, last.withColumnRenamed("id", "src"), ["src"], rows=n_edges)
        marks = reached.select(F.col("dst").alias("id"), "word", "mask", none.alias("_known"))
        marks = marks.unionByName(known.select("id", "word", none.alias("mask"), F.col("mask").alias("_known")))
        fresh = marks.groupBy("id", "word").agg(F.bit_or("mask").bitwiseAND(F.bitwise_not(F.bit_or("_known"))).alias("mask"))
        before, last = last, checkpointed(fresh.filter("mask <> 0"))
        known = before.unionByName(last)
        if not last.head(1):
            break
        steps.append(last.withColumn("hops", F.lit(hop)))
    found = reduce(DataFrame.unionByName, steps)
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("mask", b) == 1)
    return found.withColumn("bit", F.explode(places)).join(names, ["word", "bit"]).select("source", "id", "hops")


def path_kernel(hops: DataFrame, scale: float = 0.9) -> DataFrame:
    """0.9·exp(−hops); a node to itself gives 0.9, pairs that ``hops`` does not list are absent (0).

    Give distances without a bound, so that only unreachable pairs are absent.
    """
    return hops.select(F.col("source").alias("a"), F.col("id").alias("b"), (F.lit(scale) * F.exp(-F.col("hops"))).alias("s"))


# -- meta-paths -------------------------------------------------------------

def _product(left: DataFrame, right: DataFrame, lv, rv) -> DataFrame:
    """Sum and max over k of left[i,k]·right[k,j]; inputs (i, k, …) and (k, j, …).

    A path is not shuffled by itself: the right rows of a k travel to i as lists of about ``LISTED``, and i adds up what
    it unpacks. Where an i has more than ``TASK_PATHS`` paths, its j are dealt to several tasks.
    """
    left = checkpointed(left.select("i", "k", lv[0].alias("_l0"), lv[1].alias("_l1")))
    n_left = left.count()
    right = right.select("k", "j", rv[0].alias("_r0"), rv[1].alias("_r1")).filter(F.col("k").isNotNull())
    sizes = checkpointed(right.groupBy("k").agg(F.count("*").alias("_n")))
    per = salted_join(left, sizes, ["k"], rows=n_left).groupBy("i").agg(F.sum("_n").alias("_paths"))
    per = checkpointed(per.select("i", F.ceil(F.col("_paths") / TASK_PATHS).cast("int").alias("_of"), "_paths"))
    total = per.agg(F.sum("_paths")).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PATHS))
    part = F.pmod(F.xxhash64("j"), F.ceil(F.col("_n") / LISTED)).alias("_part")
    lists = right.join(sizes, "k").groupBy("k", part).agg(F.collect_list(F.struct("j", "_r0", "_r1")).alias("_x"))
    # The table of hot i has at most (all paths) / TASK_PATHS rows.
    hot = F.broadcast(per.filter("_of > 1").select("i", "_of"))
    own = left.join(hot, left["i"].eqNullSafe(hot["i"]), "left").select(left["i"], "k", "_l0", "_l1", F.coalesce("_of", F.lit(1)).alias("_of"))
    met = salted_join(own, lists.drop("_part"), ["k"], rows=n_left).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    mine = F.when(F.col("_of") == 1, F.col("_x")).otherwise(F.filter("_x", lambda e: F.pmod(F.xxhash64(e["j"]), F.col("_of")) == F.col("_at")))
    met = met.select("i", "_at", "_l0", "_l1", mine.alias("_x"))
    met = met.select("i", "_at", "_l0", "_l1", *[F.col(f"_x.{c}").alias(c) for c in ("j", "_r0", "_r1")]).repartition(tasks, "i", "_at")
    paths = met.select("i", "_l0", "_l1", "_at", F.explode(F.arrays_zip("j", "_r0", "_r1")).alias("_x")).groupBy("i", "_at", F.col("_x.j").alias("j"))
    return paths.agg(F.sum(F.col("_l0") * F.col("_x._r0")).alias("sum"), F.max(F.col("_l1") * F.col("_x._r1")).alias("max")).drop("_at")


def _square(sim: DataFrame) -> DataFrame:
    """Symmetric pair table (a < b, s) as (i, k, s) in both orders, no diagonal."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return sim.select(F.explode(both).alias("p"), "s").select(F.col("p.a").alias("i"), F.col("p.b").alias("k"), "s")


def two_hop(sim: DataFrame) -> DataFrame:
    """Sum and max of two-step products between different nodes: (i, k, sum, max)."""
    x = _square(sim)
    y = x.select(F.col("i").alias("k"), F.col("k").alias("j"), F.col("s").alias("s2"))
    out = _product(x, y, (F.col("s"), F.col("s")), (F.col("s2"), F.col("s2")))
    return out.filter(F.col("i") != F.col("j")).select("i", F.col("j").alias("k"), "sum", "max")


def cooccurrence(walks: DataFrame, window: int) -> DataFrame:
    """(a, b, n): how often b follows or precedes a within ``window`` steps of a walk (walk, step, node).

    Steps are dealt to spans of ``window``; a step meets those of its span and of the next
    by an equi-join on (walk, span). Pairs are counted in one order and mirrored then.
    """
    span = F.floor(F.col("step") / window)
    x = walks.select("walk", "step", F.col("node").alias("a"), span.alias("_span"))
    y = walks.select("walk", F.col("step").alias("_later"), F.col("node").alias("b"), F.explode(F.array(span, span - 1)).alias("_span"))
    # Spark sizes the exploded steps by their packed table: without the hint it would broadcast what is many times larger.
    met = x.join(y.hint("merge"), ["walk", "_span"]).filter((F.col("_later") > F.col("step")) & (F.col("_later") <= F.col("step") + window))
    met = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "n")
    return both.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def positive_information(counts: DataFrame) -> DataFrame:
    """(a, b, w): w = max(0, ln(n·N / (n_a·n_b))) of symmetric counts (a, b, n); zeros are left out."""
    own = counts.groupBy("a").agg(F.sum("n").cast("double").alias("na"))
    total = own.agg(F.sum("na").alias("_N"))
    x = salted_join(salted_join(counts, own, ["a"]), own.select(F.col("a").alias("b"), F.col("na").alias("nb")), ["b"]).join(F.broadcast(total))
    w = F.log(F.col("n") * F.col("_N") / (F.col("na") * F.col("nb")))
    return x.select("a", "b", w.alias("w")).filter(F.col("w") > 0)


def meta_paths(src_sim: DataFrame, dst_sim: DataFrame, edges: DataFrame, kinds=("ddt", "dtt", "dddt", "dttt", "ddtt", "dtdt")) -> dict[str, DataFrame]:
    """Sum and max of path products per (src, dst) for each path shape.

    Similarities are sparse pair tables (for instance ``strongest_k``), so every
    product stays sparse; ``dtdt`` is scored for the edges themselves.
    """
    r = edges.select("src", "dst").distinct()
    rk = r.select(F.col("src").alias("k"), F.col("dst").alias("j"))
    one = (F.lit(1.0), F.lit(1.0))
    rename = lambda df: df.select(F.col("i").alias("src"), F.col("j").alias("dst"), "sum", "max")
    out: dict[str, DataFrame] = {}
    left = r.select(F.col("src").alias("i"), F.col("dst").alias("k"))
    if "ddt" in kinds or "ddtt" in kinds:
        s = _square(src_sim)
        ddt = _product(s, rk, (F.col("s"), F.col("s")), one)
        if "ddt" in kinds:
            out["ddt"] = rename(ddt)
    if "dtt" in kinds:
        t = _square(dst_sim).select(F.col("i").alias("k"), F.col("k").alias("j"), "s")
        out["dtt"] = rename(_product(left, t, one, (F.col("s"), F.col("s"))))
    if "dddt" in kinds:
        s2 = two_hop(src_sim).withColumnRenamed("sum", "s_sum").withColumnRenamed("max", "s_max")
        out["dddt"] = rename(_product(s2, rk, (F.col("s_sum"), F.col("s_max")), one))
    if "dttt" in kinds:
        t2 = two_hop(dst_sim).select(F.col("i").alias("k"), F.col("k").alias("j"), F.col("sum").alias("s_sum"), F.col("max").alias("s_max"))
        out["dttt"] = rename(_product(left, t2, one, (F.col("s_sum"), F.col("s_max"))))
    if "ddtt" in kinds:
        t = _square(dst_sim).select(F.col("i").alias("k"), F.col("k").alias("j"), "s")
        mid = ddt.select("i", F.col("j").alias("k"), F.col("sum").alias("m_sum"), F.col("max").alias("m_max"))
        out["ddtt"] = rename(_product(mid, t, (F.col("m_sum"), F.col("m_max")), (F.col("s"), F.col("s"))))
    if "dtdt" in kinds:
        out["dtdt"] = dtdt_on_edges(r)
    return out


def common_counts(edges: DataFrame, pairs: DataFrame, node: str, other: str) -> DataFrame:
    """Number of shared partners of given same-side pairs (a, b): (a, b, common).

    The partners of the endpoint with fewer of them are listed and looked up at the
    other one, so a hub's partners are listed only against another hub.
    """
    deg = edges.groupBy(F.col(node).alias("_id")).agg(F.count("*").alias("_n"))
    p = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        p = p.join(deg.select(F.col("_id").alias(side), F.col("_n").alias("_n" + side)), side)
    first = F.col("_na") <= F.col("_nb")
    p = checkpointed(p.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("_few"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("_many")))
    listed = salted_join(p, edges.select(F.col(node).alias("_few"), F.col(other).alias("_x")), ["_few"], rows=p.count())
    known = listed.join(edges.select(F.col(node).alias("_many"), F.col(other).alias("_x")), ["_many", "_x"], "left_semi")
    return known.groupBy("a", "b").agg(F.count("*").alias("common"))


def dtdt_on_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src–dst–src–dst paths between given pairs: their number as sum, 1 as max.

    The endpoint with fewer partners takes the first step; what is left is the number
    of partners that two nodes of one side share, computed once per such pair.
    """
    r = edges.select("src", "dst").distinct()
    p = pairs.select("src", "dst").distinct()
    p = p.join(r.groupBy("src").agg(F.count("*").alias("_ns")), "src").join(r.groupBy("dst").agg(F.count("*").alias("_nt")), "dst")
    from_src = F.col("_ns") <= F.col("_nt")
    step_s = p.filter(from_src).select("src", F.col("dst").alias("b")).join(r.select("src", F.col("dst").alias("a")), "src")
    step_t = p.filter(~from_src).select(F.col("src").alias("a"), "dst").join(r.select(F.col("src").alias("b"), "dst"), "dst")
    via_dst = step_s.join(common_counts(r, step_s, "dst", "src"), ["a", "b"]).select("src", F.col("b").alias("dst"), "common")
    via_src = step_t.join(common_counts(r, step_t, "src", "dst"), ["a", "b"]).select(F.col("a").alias("src"), "dst", "common")
    paths = via_dst.unionByName(via_src).groupBy("src", "dst")
    return paths.agg(F.sum("common").cast("double").alias("sum"), F.lit(1.0).alias("max"))


def edge_squares(edges: DataFrame) -> DataFrame:
    """Number of four-cycles through each edge: (src, dst, squares); edges in none are absent.

    A four-cycle is found from its node of highest degree u, as two two-step paths
    u–v–w to the same w. A step leads through v only from nodes of higher degree, so the
    paths number at most the sum over edges of the smaller degree: hubs are ends of
    paths, never their middle.
    """
    e = edges.select("src", "dst").distinct()
    e = e.join(e.groupBy("src").agg(F.count("*").alias("ds")), "src").join(e.groupBy("dst").agg(F.count("*").alias("dt")), "dst")
    e = checkpointed(e)
    parts = []
    for u, du, v, dv, top in (("src", "ds", "dst", "dt", F.col("ds") >= F.col("dt")), ("dst", "dt", "src", "ds", F.col("dt") > F.col("ds"))):
        first = e.filter(top).select(F.col(v).alias("v"), F.col(u).alias("u"), F.col(du).alias("du"))
        second = e.select(F.col(v).alias("v"), F.col(u).alias("w"), F.col(du).alias("dw"))
        lower = (F.col("dw") < F.col("du")) | ((F.col("dw") == F.col("du")) & (F.col("w") < F.col("u")))
        paths = checkpointed(first.join(second, "v").filter(lower).select("u", "v", "w"))
        shared = paths.groupBy("u", "w").agg((F.count("*") - 1).alias("c")).filter(F.col("c") > 0)
        ends = F.explode(F.array("u", "w")).alias(u)
        parts.append(paths.join(shared, ["u", "w"]).select(ends, F.col("v").alias(v), "c").select("src", "dst", "c"))
    return parts[0].unionByName(parts[1]).groupBy("src", "dst").agg(F.sum("c").alias("squares"))


def dtdt_on_edges(edges: DataFrame) -> DataFrame:
    """src–dst–src–dst paths between the ends of every edge: their number as sum, 1 as max.

    Such a path closes a four-cycle with the edge, or repeats it: the number is
    squares + degree of src + degree of dst − 1.
    """
    r = edges.select("src", "dst").distinct()
    x = r.join(r.groupBy("src").agg(F.count("*").alias("_s")), "src").join(r.groupBy("dst").agg(F.count("*").alias("_t")), "dst")
    x = x.join(edge_squares(r), ["src", "dst"], "left")
    n = F.coalesce("squares", F.lit(0)) + F.col("_s") + F.col("_t") - 1
    return x.select("src", "dst", n.cast("double").alias("sum"), F.lit(1.0).alias("max"))


def combine_vectors(pairs: DataFrame, func: str, a: str = "src_vec", b: str = "dst_vec", out: str = "feature") -> DataFrame:
    """Concat, Hadamard, AVG, WL1 (|a−b|) or WL2 ((a−b)²) of two vectors."""
    zips = {
        "Hadamard": lambda x, y: x * y,
        "AVG": lambda x, y: (x + y) / 2,
        "WL1": lambda x, y: F.abs(x - y),
        "WL2": lambda x, y: (x - y) * (x - y),
    }
    value = F.concat(a, b) if func == "Concat" else F.zip_with(F.col(a), F.col(b), zips[func])
    return pairs.withColumn(out, value)
