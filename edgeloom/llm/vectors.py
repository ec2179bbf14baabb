"""Near-duplicates of embeddings by sorted projection passes.

A pass hashes every vector by the signs of random projections, orders the vectors by the concatenated signs and compares
each with a bounded window of those that follow. Verified pairs (cosine in double precision) are united across passes.
A pair of angle a shares each sign with probability 1 - a/pi, so it is met in a pass if it shares about log2(rows /
window) signs; the number of passes follows from that, such that a pair just at the threshold is met with probability
``RECALL``. A window gives the links of a spanning forest, not its pairs.

The direct links are then counted inside the components, all of them. Components of up to ``BLOCK`` vectors are compared
whole. Larger ones are covered by balls: random centres take all vectors within half the threshold's angle, so any two
vectors of a ball are linked without being compared. Balls and what is left are dealt to blocks; two blocks are decided
by their centres and radii where the triangle inequality allows it, else compared as matrices. Links are counted, never
listed.

Cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities link with nothing; vectors of different
lengths do not link; equal vectors are compared once and count as often as they occur; repeated rows are vectors of
their own; a null vec_id links like any other and is never the smallest id (the component of nulls alone is null, and
they are kept); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stored

THRESHOLD, WINDOW, RECALL, SIGNS, SEED = 0.9, 1024, 0.999, 62, 17
BLOCK = 2048  # vectors compared with each other at once
ROUNDS = 6  # random centres of a large component, one after the other
MARGIN = 1e-6  # radians: closer decisions are left to the comparison


def passes(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold is met with probability ``recall``."""
    shared = max(1.0, math.log2(max(rows, 1) / window)) + 1
    met = (1 - math.acos(threshold) / math.pi) ** shared
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def directions(dims: int, no: int) -> np.ndarray:
    return np.random.default_rng([SEED, no, dims]).standard_normal((dims, SIGNS))


def matrix(col) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_keys(no: int):
    """(dims, key, gid, vec) for a pass: the signs along random directions as one number."""

    def run(batches):
        for b in batches:
            dims = b["dims"].to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                signs = unit(matrix(part["vec"])) @ directions(int(d), no) > 0
                key = signs @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([part["dims"], pa.array(key), part["gid"], part["vec"]], names=["dims", "key", "gid", "vec"])

    return run


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place linked with each of n places, over any number of links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def window_links(threshold: float, window: int, step: int = 256):
    """Links of spanning forests among the neighbours of a sorted partition."""

    def out(gid, vec):
        x = unit(matrix(vec))
        for at in range(0, len(x), step):
            own, near = x[at : at + step], x[at : at + step + window]
            i, j = np.nonzero(own @ near.T >= threshold)
            use = (j > i) & (j <= i + window)
            i, j = i[use], j[use]
            if len(i):
                label = labels_of(i, j, len(near))
                node = np.flatnonzero(label != np.arange(len(near)))
                yield pa.RecordBatch.from_arrays([pa.array(gid[at + label[node]]), pa.array(gid[at + node])], names=["src", "dst"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b.select(["dims", "gid", "vec"])])
            rest = t if rest is None else pa.concat_tables([rest, t])
            dims = rest["dims"].to_numpy()
            new = np.flatnonzero(dims[1:] != dims[:-1]) + 1
            for s, e in zip([0, *new.tolist()], new.tolist()):
                yield from out(rest["gid"].to_numpy()[s:e], rest["vec"].slice(s, e - s))
            rest = rest.slice(int(new[-1])) if len(new) else rest
            if rest.num_rows >= 8 * window:  # the last ones meet the next batch again
                yield from out(rest["gid"].to_numpy(), rest["vec"])
                rest = rest.slice(rest.num_rows - window)
        if rest is not None:
            yield from out(rest["gid"].to_numpy(), rest["vec"])

    return run


def distinct_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(gid, vec, dims, least, n): the different vectors that can link, their smallest id and how many rows have them."""
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter(ok)
    groups = valid.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return stored(groups.select(F.monotonically_increasing_id().alias("gid"), "vec", F.size("vec").alias("dims"), "least", "n"))


def found_links(vectors: DataFrame, rows: int, threshold: float, window: int, recall: float) -> list[DataFrame]:
    """Links of all passes, a table for each."""
    tables, data = [], vectors.select("dims", "gid", "vec")
    parts = max(1, rows // (16 * window))
    for no in range(passes(rows, threshold, window, recall)):
        keyed = data.mapInArrow(sign_keys(no), "dims int, key long, gid long, vec array<double>")
        ordered = keyed.repartitionByRange(parts, "dims", "key").sortWithinPartitions("dims", "key")
        tables.append(stored(ordered.mapInArrow(window_links(threshold, window), "src long, dst long")))
    return tables


# -- links inside components --------------------------------------------------

def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a))) / F.sqrt(dot(F.col(b), F.col(b)))


def balls(members: DataFrame, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """Members (root, gid, n, vec) of large components with their ball: (…, ball, centre, angle); ball is null for what no centre took."""
    done, left = None, members
    for no in range(rounds):
        pick = F.struct(F.xxhash64("gid", F.lit(no)).alias("_h"), F.col("gid").alias("ball"), F.col("vec").alias("centre"))
        centres = stored(left.groupBy(F.col("root").alias("_root")).agg(F.min(pick).alias("_c")).select("_root", "_c.ball", "_c.centre"))
        met = left.join(centres, F.col("root") == F.col("_root")).drop("_root")
        met = stored(met.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine("vec", "centre"))))))
        inside = F.col("angle") <= math.acos(threshold) / 2 - MARGIN
        inside = inside | (F.col("gid") == F.col("ball"))
        taken = met.filter(inside)
        done = taken if done is None else done.unionByName(taken)
        left = met.filter(~inside).drop("ball", "centre", "angle")
        if not left.head(1):
            return done
    rest = left.withColumn("ball", F.lit(None).cast("long")).withColumn("centre", F.lit(None).cast("array<double>")).withColumn("angle", F.lit(math.pi))
    return done.unionByName(rest)


def _block_counts(threshold: float):
    """(gid, links) of every row of the block pairs of a partition sorted by (pair, side): links with the other side, or among itself."""

    def out(t: pa.Table):
        x, n, gid, side = unit(matrix(t["vec"])), t["n"].to_numpy(), t["gid"].to_numpy(), t["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(b):
            total = np.zeros(len(x), np.int64)
            for s in range(0, len(a), 1024):
                one = a[s : s + 1024]
                hit = x[one] @ x[b].T >= threshold
                total[one] = hit @ n[b]
                total[b] += n[one] @ hit
        else:
            total = np.concatenate([(x[s : s + 1024] @ x.T >= threshold) @ n for s in range(0, len(x), 1024)]) - n * ((x * x).sum(axis=1) >= threshold)
        keep = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(gid[keep]), pa.array(total[keep].astype(np.int64))], names=["gid", "links"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            one, two = rest["one"].to_numpy(), rest["two"].to_numpy()
            new = [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist()]
            for s, e in zip(new, new[1:]):
                yield from out(rest.slice(s, e - s))
            rest = rest.slice(new[-1])
        if rest is not None and rest.num_rows:
            yield from out(rest)

    return run


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """(gid, links) for rows (one, two, side, gid, n, vec): ``one`` and ``two`` name the blocks that are compared."""
    ordered = rows.select("one", "two", "side", "gid", "n", "vec").repartition("one", "two").sortWithinPartitions("one", "two", "side")
    return ordered.mapInArrow(_block_counts(threshold), "gid long, links long")


def _large_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(gid, links) of members (root, gid, n, vec) of components beyond a block, in parts to be summed up."""
    limit = math.acos(threshold)
    found = stored(balls(members, threshold))
    sizes = found.groupBy("root", "ball").agg(F.count("*").alias("_size"))
    sizes = stored(sizes.select(F.col("root").alias("_root"), F.col("ball").alias("_ball"), F.ceil(F.col("_size") / block).alias("_parts")))
    dealt = found.join(sizes, (F.col("root") == F.col("_root")) & F.col("ball").eqNullSafe(F.col("_ball"))).withColumn("_part", F.pmod(F.xxhash64("gid", F.lit("part")), F.col("_parts")))
    dealt = stored(dealt.withColumn("block", F.xxhash64("root", "ball", "_part")).select("root", "block", "gid", "n", "vec", "centre", "angle"))
    blocks = stored(dealt.groupBy("root", "block").agg(F.sum("n").alias("size"), F.max("angle").alias("radius"), F.min("centre").alias("centre")))
    pairs = blocks.alias("x").join(blocks.alias("y"), (F.col("x.root") == F.col("y.root")) & (F.col("x.block") <= F.col("y.block")))
    pairs = pairs.select(F.col("x.block").alias("one"), F.col("y.block").alias("two"), F.col("x.size").alias("size_one"), F.col("y.size").alias("size_two"), F.col("x.radius").alias("r1"), F.col("y.radius").alias("r2"), F.col("x.centre").alias("c1"), F.col("y.centre").alias("c2"))
    apart = F.when(F.col("c1").isNull() | F.col("c2").isNull(), None).when(F.col("one") == F.col("two"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine("c1", "c2")))))
    pairs = stored(pairs.withColumn("_d", apart).withColumn("_all", F.coalesce(F.col("_d") + F.col("r1") + F.col("r2") <= limit - MARGIN, F.lit(False))).withColumn("_none", F.coalesce(F.col("_d") - F.col("r1") - F.col("r2") > limit + MARGIN, F.lit(False))).drop("c1", "c2", "_d"))
    linked = pairs.filter("_all").select(F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("block"), F.col("size_one").alias("of")))).otherwise(F.array(F.struct(F.col("one").alias("block"), F.col("size_two").alias("of")), F.struct(F.col("two").alias("block"), F.col("size_one").alias("of"))))).alias("x"), (F.col("one") == F.col("two")).alias("own"))
    whole = stored(linked.groupBy(F.col("x.block").alias("_block")).agg(F.sum("x.of").alias("_of"), F.max("own").alias("_own")))
    sure = dealt.join(whole, F.col("block") == F.col("_block")).select("gid", (F.col("_of") - F.when(F.col("_own"), F.col("n")).otherwise(0)).alias("links"))
    open_ = pairs.filter("not _all and not _none").select("one", "two")
    sides = open_.select(F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("_block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("_block")), F.struct(F.lit(1).alias("side"), F.col("two").alias("_block"))))).alias("s"), "one", "two").select("one", "two", "s.side", "s._block")
    return sure.unionByName(_compared(dealt.join(sides, F.col("block") == F.col("_block")), threshold))


def near_vectors(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vectors = distinct_vectors(rows, key, vec)
    tables = found_links(vectors, vectors.count(), threshold, window, recall)
    edges = tables[0]
    for t in tables[1:]:
        edges = edges.unionByName(t)
    linked = stored(connected_components(stored(edges.distinct())).select(F.col("id").alias("_gid"), F.col("component").alias("root")))
    members = stored(vectors.join(linked, F.col("gid") == F.col("_gid")).select("root", "gid", "least", "n", "vec"))
    totals = stored(members.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_size"), F.min("least").alias("component_id")))
    sized = stored(members.join(totals, F.col("root") == F.col("_root")).drop("_root"))
    small = sized.filter(F.col("_size") <= block)
    counts = _compared(small.select(F.col("root").alias("one"), F.col("root").alias("two"), F.lit(0).alias("side"), "gid", "n", "vec"), threshold)
    large = sized.filter(F.col("_size") > block).select("root", "gid", "n", "vec")
    if large.head(1):
        counts = counts.unionByName(_large_links(large, threshold, block))
    counts = counts.groupBy(F.col("gid").alias("_gid")).agg(F.sum("links").alias("_links"))
    named = vectors.join(sized.select(F.col("gid").alias("_g"), "component_id"), F.col("gid") == F.col("_g"), "left").drop("_g")
    named = named.join(counts, F.col("gid") == F.col("_gid"), "left")
    named = stored(named.select(F.col("vec").alias("_vec"), F.coalesce("component_id", "least").alias("_component"), (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.lit(True).alias("_met")))
    out = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("_own")).join(named, F.col("_own") == F.col("_vec"), "left")
    component = F.when(F.col("_met"), F.col("_component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
