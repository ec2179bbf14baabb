"""Similarity kernels over sparse profiles, sequences, text and term annotations.

Kernels return pairs ``(a, b, s)`` with ``a < b`` and ``s >= min_sim``; the
diagonal is implied. Where many profiles are equal, give a kernel the rows that
``overlap.fold_copies`` returns: the pairs then run over representatives, with the
membership table alongside.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import overlap as ov
from .scale import checkpointed, salted_join, task_count

TASK_KMERS = 1 << 20  # k-mers that one task counts
SHARED = 4  # terms that two ids share in the mean above which blocks of ids meet
MANY = 4096  # meetings of a term's rows in two blocks from which on they are written at once

def profiles(edges: DataFrame, id: str = "src", feature: str = "dst") -> DataFrame:
    """Distinct edges as unit-weight rows."""
    return edges.select(F.col(id).alias("id"), F.col(feature).alias("f")).distinct().withColumn("w", F.lit(1).cast("long"))


def _finish(pairs: DataFrame, value, min_sim: float) -> DataFrame:
    out = pairs.withColumn("s", value)
    return out.filter(F.col("s") >= min_sim - ov.SLACK).select("a", "b", "s")


def jaccard(rows: DataFrame, min_sim: float) -> DataFrame:
    """|A∩B| / |A∪B| of feature sets; also the Tanimoto coefficient of bit vectors."""
    p = ov.overlaps(rows, ov.jaccard_at(min_sim))
    return _finish(p, F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")), min_sim)


tanimoto_bits = jaccard


def cosine_binary(rows: DataFrame, min_sim: float) -> DataFrame:
    p = ov.overlaps(rows, ov.cosine_sets_at(min_sim))
    return _finish(p, F.col("overlap") / F.sqrt(F.col("na") * F.col("nb")), min_sim)


def dice_counts(counts: DataFrame, min_sim: float) -> DataFrame:
    """2·Σmin(x, y) / (Σx + Σy) of count vectors (id, f, c)."""
    rows = counts.select("id", "f", F.sqrt(F.col("c").cast("double")).alias("w"))
    p = ov.overlaps(rows, ov.dice_counts_at(min_sim))
    return _finish(p, F.lit(2.0) * F.col("overlap") / (F.col("na") + F.col("nb")), min_sim)


def unit_rows(rows: DataFrame) -> DataFrame:
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("_n"))
    return salted_join(rows, norm.filter(F.col("_n") > 0), ["id"]).select("id", "f", (F.col("w") / F.col("_n")).alias("w"))


def cosine_weighted(rows: DataFrame, min_sim: float) -> DataFrame:
    p = ov.overlaps(unit_rows(rows), ov.cosine_at(min_sim))
    return _finish(p, F.col("overlap"), min_sim)


# -- sequences and text -----------------------------------------------------

def kmer_counts(seq: DataFrame, k: int, id: str = "id", col: str = "seq", ways: int = 1) -> DataFrame:
    """Counts (id, f, c) of all k-mers of the whole sequence.

    The sequences are dealt by id, into tasks that grow with their letters: counts by id need no further shuffle.
    ``ways`` is the number of rows that the caller makes of a k-mer.
    """
    starts = F.sequence(F.lit(1), F.length(col) - (k - 1))
    long_enough = seq.filter(F.length(col) >= k).select(F.col(id), F.col(col))
    letters = long_enough.agg(F.sum(F.length(col).cast("double"))).first()[0] or 0.0
    long_enough = long_enough.repartition(task_count(seq.sparkSession, letters * ways, TASK_KMERS), id)
    grams = long_enough.select(F.col(id).alias("id"), F.explode(F.transform(starts, lambda i: F.substring(F.col(col), i, F.lit(k)))).alias("f"))
    return grams.groupBy("id", "f").agg(F.count("*").alias("c"))


def spectrum_kernel(seq: DataFrame, k: int, min_sim: float) -> DataFrame:
    """Cosine-normalised dot product of k-mer counts."""
    return cosine_weighted(kmer_counts(seq, k).select("id", "f", F.col("c").alias("w")), min_sim)


def common_neighbours(k: int, m: int, letters: int, d: int) -> int:
    """Number of words of length k within m mismatches of both of two words that differ in d places."""
    total = 0
    for i in range(d + 1):  # differing places where it is like the first word, j like the second, the rest like neither
        for j in range(d - i + 1):
            for c in range(k - d + 1):  # places where the words agree and it does not
                if d - i + c <= m and d - j + c <= m:
                    total += comb(d, i) * comb(d - i, j) * (letters - 2) ** (d - i - j) * comb(k - d, c) * (letters - 1) ** c
    return total


def blank_weights(k: int, m: int, letters: int) -> list[int]:
    """Weight of matches with j places blanked, such that their weighted sum counts common neighbours.

    Words that differ in d places agree under comb(k - d, j - d) of the ways to blank j places: the weights solve
    sum over j of weight_j * comb(k - d, j - d) = common_neighbours(d), for every d.
    """
    n = [common_neighbours(k, m, letters, d) for d in range(k + 1)]
    return [sum(n[d] * (-1) ** (d - j) * comb(k - j, d - j) for d in range(j, k + 1)) for j in range(k + 1)]


def count_letters(seq: DataFrame, col: str = "seq") -> int:
    return seq.select(F.explode(F.split(col, "")).alias("l")).filter("l <> ''").agg(F.count_distinct("l")).first()[0]


def blanked_rows(counts: DataFrame, k: int, weights: list[int]) -> DataFrame:
    """(id, f, w): k-mer counts (id, f, c) with every choice of places blanked; w is the count times the root of the weight."""
    ways = [[i for i in range(k) if not bits >> i & 1] for bits in range(1 << k)]
    word = lambda at: F.concat_ws("", *[F.substring("f", i + 1, 1) if i in at else F.lit("\0") for i in range(k)])
    ways = [(at, float(np.sqrt(weights[k - len(at)]))) for at in ways if weights[k - len(at)]]
    made = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}:"), word(at)).alias("f"), F.lit(w).alias("w")) for n, (at, w) in enumerate(ways)]))
    return counts.select("id", "c", made.alias("_x")).groupBy("id", F.col("_x.f").alias("f")).agg(F.sum(F.col("c") * F.col("_x.w")).alias("w"))


def neighbour_rows(counts: DataFrame, seq: DataFrame, k: int, m: int, col: str = "seq") -> DataFrame:
    """(id, f, w): counts of all words within m mismatches of the k-mers, for alphabets of a few letters."""
    letters = F.array(*[F.lit(r[0]) for r in seq.select(F.explode(F.split(col, "")).alias("l")).filter("l <> ''").distinct().collect()])
    near = counts.select("f").distinct().withColumn("g", F.col("f"))
    for _ in range(m):
        change = lambda i: F.transform(letters, lambda a: F.concat(F.substring("g", F.lit(1), i - 1), a, F.substring("g", i + 1, F.lit(k))))
        near = near.select("f", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), change))).alias("g")).distinct()
    return counts.join(near, "f").groupBy("id", F.col("g").alias("f")).agg(F.sum("c").alias("w"))


def mismatch_kernel(seq: DataFrame, k: int, m: int, min_sim: float) -> DataFrame:
    """Cosine-normalised count of common words within ``m`` mismatches of the k-mers of both sequences, over all their letters.

    No neighbouring word is made: k-mers with places blanked are the features, 2^k of a k-mer at most whatever the
    alphabet, and inclusion and exclusion gives their weights. Where an alphabet is so small that a weight is negative,
    its few neighbours are listed instead.
    """
    counts, letters = kmer_counts(seq, k, ways=1 << k), count_letters(seq)
    if letters < 2:  # every k-mer is the same word
        return spectrum_kernel(seq, k, min_sim)
    weights = blank_weights(k, m, letters)
    rows = blanked_rows(counts, k, weights) if min(weights) >= 0 else neighbour_rows(counts, seq, k, m)
    return cosine_weighted(rows, min_sim)


def tfidf_rows(counts: DataFrame) -> DataFrame:
    """Weights tf · ln(N / df) of counts (id, f, c); features in every document weigh 0."""
    n = counts.agg(F.count_distinct("id").alias("_N"))
    df = counts.groupBy("f").agg(F.count("*").alias("_df")).join(F.broadcast(n))
    idf = df.select("f", F.log(F.col("_N") / F.col("_df")).alias("_idf")).filter(F.col("_idf") > 0)
    return salted_join(counts, idf, ["f"]).select("id", "f", (F.col("c") * F.col("_idf")).alias("w"))


def tfidf_kernel(seq: DataFrame, k: int, min_sim: float) -> DataFrame:
    """TF-IDF cosine over sub-string tokens of structure strings."""
    return cosine_weighted(tfidf_rows(kmer_counts(seq, k)), min_sim)


# -- interaction profiles ---------------------------------------------------

def gip(rows: DataFrame, min_sim: float) -> DataFrame:
    """exp(−γ‖x−y‖²) of interaction profiles that share a partner; γ = 1 / mean ‖x‖².

    Profiles without a shared partner have the closed form exp(−γ(|x|+|y|)).
    """
    import math

    gamma = 1.0 / rows.groupBy("id").count().agg(F.avg("count")).first()[0]
    p = ov.overlaps(rows, ov.within_distance(-math.log(min_sim) / gamma))
    distance = F.col("na") + F.col("nb") - 2 * F.col("overlap")
    return _finish(p, F.exp(-F.lit(gamma) * distance), min_sim)


def gip_sizes(rows: DataFrame) -> DataFrame:
    """(id, n, gamma) of interaction profiles: two that share no partner are exp(−γ(n₁ + n₂)) alike, which ``gip`` does not list."""
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    return sizes.join(F.broadcast(sizes.agg((1.0 / F.avg("n")).alias("gamma"))))


def impute_profiles(edges: DataFrame, sim: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus, for nodes without any, the similarity-weighted mean of their neighbours."""
    unseen = nodes.select(F.col("id").alias("src")).distinct().join(edges.select("src").distinct(), "src", "left_anti")
    both = sim.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "s")
    near = both.select(F.col("p.a").alias("src"), F.col("p.b").alias("n"), "s").join(unseen, "src", "left_semi")
    known = edges.select(F.col("src").alias("n"), "dst").distinct()
    near = near.join(known.select("n").distinct(), "n", "left_semi")
    total = near.groupBy("src").agg(F.sum("s").alias("_t"))
    filled = salted_join(near, known, ["n"]).groupBy("src", "dst").agg(F.sum("s").alias("_s")).join(total, "src")
    filled = filled.select("src", "dst", (F.col("_s") / F.col("_t")).alias("v"))
    return edges.select("src", "dst").distinct().withColumn("v", F.lit(1.0)).unionByName(filled)


def annotation_ic(terms: DataFrame, closure: DataFrame, min_ic: float | None = None) -> DataFrame:
    """Largest information content of a shared term, divided by the row's largest.

    ``terms`` is (id, term), ``closure`` (term, ancestor) including the term itself.
    All terms are paired, or those with at least ``min_ic`` if that is given. The ids of a term meet in
    blocks; where ids share many terms, blocks of ids meet instead, so that no shared term is a row.
    The result is directed: (a, b, s) for both orders.
    """
    full = checkpointed(salted_join(terms, closure, ["term"]).select("id", F.col("ancestor").alias("t")).distinct())
    n = full.agg(F.count_distinct("id").alias("_N"))
    ic = full.groupBy("t").agg(F.count("*").alias("_df")).join(F.broadcast(n))
    ic = ic.select("t", (-F.log(F.col("_df") / F.col("_N"))).alias("ic"), "_df")
    ic = ic if min_ic is None else ic.filter(F.col("ic") >= min_ic)
    x = checkpointed(salted_join(full, ic, ["t"]))
    met, ids = x.agg(F.sum(F.col("_df").cast("double")), F.count_distinct("id")).first()
    met = met or 0.0
    if met > SHARED * float(ids) * ids:
        return _largest_in_blocks(x)
    x = checkpointed(x.join(x.groupBy("id").agg(F.max("ic").alias("_own")), "id"))
    # Partners travel to a as lists with the content of the term; a finds its largest there, so no pair is shuffled by itself.
    left = ov.posting_blocks(x.select(F.col("id").alias("a"), F.col("t").alias("f"), "ic", "_own", "_df"), "_df", ("_p", "_q"))
    lists = ov.posting_lists(x.select(F.col("id").alias("b"), F.col("t").alias("f"), "_df"), "_df", ("_q", "_p"), ["b"])
    pairs = left.join(lists, ["f", "_p", "_q"]).select("a", "ic", "_own", F.filter(F.col("_l.b"), lambda b: b != F.col("a")).alias("_l")).filter(F.size("_l") > 0)
    pairs = pairs.repartition(task_count(x.sparkSession, met, ov.TASK_MEETINGS), "a").select("a", "ic", "_own", F.explode("_l").alias("b"))
    best = pairs.groupBy("a", "b").agg(F.max("ic").alias("ic"), F.first("_own").alias("_own"))
    # An id whose terms tell nothing, as all have them, has no largest to divide by.
    return best.select("a", "b", F.when(F.col("_own") != 0, F.col("ic") / F.col("_own")).otherwise(F.lit(float("nan"))).alias("s"))


def _largest_shared(xs, ys) -> np.ndarray:
    """Largest weight of a common feature for all pairs of rows of two blocks, -inf where none is; a feature weighs the same everywhere."""
    (i, f, u), (j, g, _) = ov.flat(xs), ov.flat(ys)
    best = np.full((len(xs["lens"]), len(ys["lens"])), -np.inf)
    x, y = np.lexsort((f, u)), np.argsort(g, kind="stable")
    i, f, u, j, g = i[x], f[x], u[x], j[y], g[y]
    start = np.searchsorted(g, f)
    n = np.searchsorted(g, f, side="right") - start
    # Of features that many rows of both sides have, all meet at once, the heaviest last.
    first = np.flatnonzero(np.diff(f, prepend=-1))
    held = np.diff(first, append=len(f))
    many = held * n[first] >= MANY
    for at, rows in zip(first[many], held[many]):
        best[np.ix_(i[at : at + rows], j[start[at] : start[at] + n[at]])] = u[at]
    few = np.flatnonzero(np.repeat(~many, held) & (n > 0))
    flat, upto = best.reshape(-1), np.cumsum(n[few])
    for part in np.split(few, np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, ov.MET)[1:])):
        m = n[part]
        entry = np.repeat(start[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
        np.maximum.at(flat, np.repeat(i[part], m) * best.shape[1] + j[entry], np.repeat(u[part], m))
    return best


def _largest_in_blocks(x: DataFrame) -> DataFrame:
    """What ``annotation_ic`` gives of (id, t, ic), by blocks of ids that meet: nothing is shuffled per pair."""
    packed, blocks = ov.packed_blocks(x.select("id", F.col("t").alias("f"), F.col("ic").alias("w")))
    kind = dict(x.dtypes)["id"]

    def pairs(best, xs, ys, same):
        own = np.maximum.reduceat(xs["ws"], np.concatenate([[0], np.cumsum(xs["lens"])[:-1]]))
        step = max(1, ov.PAIRS // best.shape[1])
        for lo in range(0, len(best), step):
            r, c = np.nonzero(best[lo : lo + step] > -np.inf)
            r += lo
            if same:
                r, c = r[r != c], c[r != c]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(own[r] != 0, best[r, c] / own[r], np.nan)
            yield pa.RecordBatch.from_arrays([xs["id"].take(pa.array(r)), ys["id"].take(pa.array(c)), pa.array(s)], names=["a", "b", "s"])

    def meet(batches):
        for b in batches:
            for k in range(b.num_rows):
                xs, ys = ({c: b.column(f"{c}_{s}")[k].values for c in ("id", "lens", "fs", "ws")} for s in "xy")
                for side in (xs, ys):
                    side.update({c: side[c].to_numpy(zero_copy_only=False) for c in ("lens", "fs", "ws")})
                same = b.column("_b_x")[k] == b.column("_b_y")[k]
                best = _largest_shared(xs, ys)
                yield from pairs(best, xs, ys, same)
                if not same:
                    yield from pairs(np.ascontiguousarray(best.T), ys, xs, same)

    return ov.block_meetings(packed, blocks).mapInArrow(meet, f"a {kind}, b {kind}, s double")


# -- dense vectors ----------------------------------------------------------

def cosine_dense(pairs: DataFrame, emb: DataFrame, normalize: bool = True) -> DataFrame:
    """Cosine of the vectors of given pairs (a, b), moved to [0, 1] if asked."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    e = emb.select("id", "vec", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("n"))
    x = pairs.join(e.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("n").alias("na")), "a")
    x = x.join(e.select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("n").alias("nb")), "b")
    cos = F.when((F.col("na") > 0) & (F.col("nb") > 0), dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))).otherwise(0.0)
    return x.select("a", "b", ((cos + 1) / 2 if normalize else cos).alias("s"))


# -- normalisation of sparse matrices (i, j, v) -----------------------------

def minmax_columns(cells: DataFrame) -> DataFrame:
    """Per-column min-max; a constant column becomes 0."""
    span = cells.groupBy("j").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return salted_join(cells, span, ["j"]).select("i", "j", scaled.alias("v"))


def row_normalize(cells: DataFrame, drop_self: bool = False) -> DataFrame:
    """Divide by the row sum + 1e-12, without the diagonal if asked."""
    x = cells.filter(F.col("i") != F.col("j")) if drop_self else cells
    sums = x.groupBy("i").agg(F.sum("v").alias("_s"))
    return salted_join(x, sums, ["i"]).select("i", "j", (F.col("v") / (F.col("_s") + F.lit(1e-12))).alias("v"))


def sym_normalize(cells: DataFrame, square: bool) -> DataFrame:
    """D^-½ (A + I) D^-½ for square matrices, Dr^-½ A Dc^-½ for rectangular ones."""
    x = cells
    if square:
        ids = cells.select(F.explode(F.array("i", "j")).alias("i")).distinct()
        eye = ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
        x = cells.select("i", "j", F.col("v").cast("double").alias("v")).unionByName(eye).groupBy("i", "j").agg(F.sum("v").alias("v"))
    r = x.groupBy("i").agg(F.sum("v").alias("_r"))
    c = r.select(F.col("i").alias("j"), F.col("_r").alias("_c")) if square else x.groupBy("j").agg(F.sum("v").alias("_c"))
    scale = F.when((F.col("_r") > 0) & (F.col("_c") > 0), 1 / F.sqrt(F.col("_r") * F.col("_c"))).otherwise(0.0)
    return salted_join(salted_join(x, r, ["i"]), c, ["j"]).select("i", "j", (F.col("v") * scale).alias("v"))
