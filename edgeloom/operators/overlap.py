"""Exact all-pairs overlap above a threshold, without visiting every pair.

The input is a sparse matrix ``(id, f, w)``. Two rows reach a threshold only if
they share one of their rarest features: walk a row's features from the rarest to
the most frequent; once the weight that is left is too small to reach the
threshold alone, the rest need not be indexed. Hub features come last, so they
are indexed only where a row holds little else. Candidates carry the overlap that
the index already saw; an upper bound drops most, and only the survivors fetch
their missing features.

Where nearly all rows share even their rarest features, an index only lists all
pairs many times over. Such rows meet in blocks instead, as products of matrices
(``block_overlaps``), and only pairs that reach the threshold leave a block.

Rows with equal features are folded into one representative first
(``fold_copies``), so a large group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import checkpointed, dense_index, running_sum, salted_join

SLACK = 1e-9
POSTING = 2048  # rows of a feature that meet each other under one key
BLOCK = 4096  # rows of a side of a block of pairs
COLUMNS = 1024  # columns of a block that are multiplied at once
ENTRIES = 1 << 20  # features of all rows of a block, about
PAIRS = 1 << 16  # pairs that are given or finished at once
ENTRY = 256  # multiplications that cost as much as two entries of a column meeting in a block
LOOK = 128  # multiplications that cost as much as the room and the look that a pair of rows takes in a block
PASS = 512  # multiplications that cost as much as looking at a pair once more
MET = 1 << 22  # meetings of entries that are added up at once
LOOKUP = 2048  # multiplications that cost as much as looking up one feature of a pair
INDEXED = 1 << 20  # rows above which the plan is chosen by the index of some of the ids
WIDEST = 4096  # most features of a row that travels whole
MEETING = 4096  # multiplications that cost as much as two rows meeting under a feature
TASK_MEETINGS = 1 << 21  # meetings that one task adds up
CAPS = (1024, 65_536, None)  # most rows of the features that nearest neighbours are looked for with, round by round


@dataclass(frozen=True)
class Threshold:
    """What a pair needs, with sizes ``n`` being the sum of squared weights.

    ``as_smaller(n)`` and ``as_larger(n)``: least overlap a row must reach with any
    partner when it is the smaller / larger of the two; ``sizes`` tells whether two
    sizes (smaller, larger) can match; ``pair`` is the overlap the pair must reach;
    ``product`` says whether the overlap is a sum of products, else of minima of
    squared weights.
    """

    as_smaller: Callable[[Column], Column]
    as_larger: Callable[[Column], Column]
    sizes: Callable[[Column, Column], Column]
    pair: Callable[[Column, Column], Column]
    reach: Callable[[np.ndarray, np.ndarray], np.ndarray]
    product: bool = True
    unit_weights: bool = True


def jaccard_at(t: float) -> Threshold:
    return Threshold(
        lambda n: n * (2 * t / (1 + t)), lambda n: n * t, lambda x, y: x >= y * t - SLACK,
        lambda x, y: (x + y) * (t / (1 + t)), lambda x, y: (x + y) * (t / (1 + t)),
    )


def cosine_sets_at(t: float) -> Threshold:
    return Threshold(
        lambda n: n * t, lambda n: n * (t * t), lambda x, y: x >= y * (t * t) - SLACK,
        lambda x, y: F.sqrt(x * y) * t, lambda x, y: np.sqrt(x * y) * t,
    )


def dice_counts_at(t: float) -> Threshold:
    """Weights are square roots of counts, so ``n`` is the total count."""
    return Threshold(
        lambda n: n * t, lambda n: n * (t / (2 - t)), lambda x, y: x >= y * (t / (2 - t)) - SLACK,
        lambda x, y: (x + y) * (t / 2), lambda x, y: (x + y) * (t / 2), product=False,
    )


def cosine_at(t: float) -> Threshold:
    """Any weights; no size tells the pair apart, so both sides use the norm bound.

    The overlap is the dot product and a pair needs ``t·‖x‖·‖y‖``; rows must be
    scaled to unit length.
    """
    return Threshold(
        lambda n: n * (t * t), lambda n: n * (t * t), lambda x, y: F.lit(True), lambda x, y: F.lit(t),
        lambda x, y: np.full(np.broadcast(x, y).shape, t), unit_weights=False,
    )


def within_distance(d: float) -> Threshold:
    """Sets that differ in at most ``d`` elements and share at least one."""
    return Threshold(
        lambda n: F.greatest(F.lit(1.0), n - d / 2), lambda n: F.greatest(F.lit(1.0), n - d),
        lambda x, y: x >= y - d - SLACK, lambda x, y: F.greatest(F.lit(1.0), (x + y - d) / 2),
        lambda x, y: np.maximum(1.0, (x + y - d) / 2),
    )


def fold_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives' rows and the membership table (id, rep).

    Two ids are copies if their feature/weight sets agree; the sets are compared by
    their size and three independent 64-bit sums, which combine on the map side.
    """
    h1, h2, h3 = F.xxhash64("f", "w"), F.xxhash64("w", "f", F.lit(17)), F.xxhash64(F.lit(91), "f", "w")
    marks = rows.groupBy("id").agg(
        F.count("*").alias("c0"), F.bit_xor(h1).alias("c1"), F.bit_xor(h2).alias("c2"), F.bit_xor(h3).alias("c3")
    )
    reps = marks.groupBy("c0", "c1", "c2", "c3").agg(F.min("id").alias("rep"))
    members = marks.join(reps, ["c0", "c1", "c2", "c3"]).select("id", "rep")
    kept = rows.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    return kept, members


def index_rows(rows: DataFrame, need: Threshold, cold: int = 64, warm: int = 4096, n_rows: int | None = None, freq: DataFrame | None = None) -> DataFrame:
    """Rows with their size and index marks.

    A row may stop once less than its need is left. Rare features are indexed a
    little further, because they add few candidates and sharpen the bound: always
    below ``cold`` rows, down to half the need below ``warm`` rows (powers of two).
    ``freq`` gives the frequencies (f, _df) if ``rows`` are only some ids.
    """
    freq = rows.groupBy("f").agg(F.count("*").alias("_df")) if freq is None else freq
    sized = rows.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("n"))
    x = salted_join(salted_join(rows, freq, ["f"], rows=n_rows), sized, ["id"], rows=n_rows)
    # Rarest first; 256 hash buckets inside each power of two of the frequency.
    level = F.floor(F.log2(F.col("_df"))).cast("int") * 256 + F.pmod(F.xxhash64("f"), F.lit(256)).cast("int")
    x = x.withColumn("_w2", (F.col("w") * F.col("w")).cast("double"))
    x = running_sum(x, ["id"], ["f"], level, {"_upto": F.col("_w2")})
    left = F.col("n") - F.col("_upto") + F.col("_w2")
    share = F.when(F.col("_df") < cold, 0.0).when(F.col("_df") < warm, 0.5).otherwise(1.0)
    return x.select(
        "id", "f", "w", "n", "_w2", "_df",
        (left >= need.as_smaller(F.col("n")) * share - SLACK).alias("short"),
        (left >= need.as_larger(F.col("n")) * share - SLACK).alias("long"),
    )


def posting_blocks(rows: DataFrame, df: str, names: tuple[str, str], size: int | None = None) -> DataFrame:
    """Rows of one side of a join on ``f``, dealt so that no key holds more than about ``size`` rows of a side.

    A feature of ``df`` rows has ceil(df / size) blocks a side; a row goes to one of its own side and to all of the
    other's. ``names`` are the columns of the own and of the other side's block: join on ``f`` and both.
    """
    n = F.ceil(F.col(df) / F.lit(size or POSTING)).cast("int")
    return rows.withColumn(names[0], F.pmod(F.xxhash64(rows.columns[0]), n).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), n - 1)))


def posting_lists(rows: DataFrame, df: str, names: tuple[str, str], columns: list[str]) -> DataFrame:
    """The same deal with the rows of a feature's block as one list ``_l`` of ``columns``: (f, own block, other block, _l)."""
    n = F.ceil(F.col(df) / F.lit(POSTING)).cast("int")
    lists = rows.groupBy("f", F.pmod(F.xxhash64(rows.columns[0]), n).cast("int").alias(names[0]), n.alias("_n")).agg(F.collect_list(F.struct(*columns)).alias("_l"))
    return lists.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def flat(side):
    """Entries (row, feature, weight) of a block, by row."""
    return np.repeat(np.arange(len(side["lens"])), side["lens"]), side["fs"], side["ws"]


def _common(xs, ys, product: bool):
    """Entries (row, column, weight) of two blocks in the columns that both have, and a factor per column.

    The products of the weights times the factor add up to the overlaps. Columns that hold most come first.
    """
    (i, f, u), (j, g, v) = flat(xs), flat(ys)
    both = np.intersect1d(f, g)
    at, to = np.isin(f, both), np.isin(g, both)
    i, f, u, j, g, v = i[at], np.searchsorted(both, f[at]), u[at], j[to], np.searchsorted(both, g[to]), v[to]
    if product or not len(both):
        step = np.ones(len(both))
    else:
        # The lesser of two weights is the sum of the steps up to it that both reach: a column is a feature and a step.
        squares = np.concatenate([u * u, v * v])
        if np.abs(squares - np.rint(squares)).max() < SLACK:
            squares = np.rint(squares)
        levels, last = np.unique(np.concatenate([f, g]) + 1j * squares, return_inverse=True)
        fresh = np.diff(levels.real, prepend=-1) > 0
        step = np.where(fresh, levels.imag, np.diff(levels.imag, prepend=0))
        n = last + 1 - np.flatnonzero(fresh)[levels.real[last].astype(np.intp)]
        column = np.repeat(last, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        row, mine = np.repeat(np.concatenate([i, j]), n), np.repeat(np.arange(len(n)) < len(i), n)
        i, f, j, g = row[mine], column[mine], row[~mine], column[~mine]
        u, v = np.ones(len(i)), np.ones(len(j))
    held = np.bincount(f, step[f] * u * u, len(step)) + np.bincount(g, step[g] * v * v, len(step))
    order = np.argsort(-held, kind="stable")
    place = np.argsort(order)
    x, y = np.argsort(place[f], kind="stable"), np.argsort(place[g], kind="stable")
    return (i[x], place[f[x]], u[x]), (j[y], place[g[y]], v[y]), step[order]


def _late(pairs, left, right, step, width):
    """Overlaps of given (rows, rows) in the columns of left and right, entry by entry."""
    (i, f, u), (j, g, v) = left, right
    by = np.argsort(i, kind="stable")
    starts, key = np.searchsorted(i[by], np.arange(i.max(initial=-1) + 2)), j * width + g
    to = np.argsort(key, kind="stable")
    key, v, out = key[to], v[to], np.zeros(len(pairs[0]))
    for lo in range(0, len(out) if len(key) else 0, PAIRS):
        r, c = pairs[0][lo : lo + PAIRS], pairs[1][lo : lo + PAIRS]
        r = np.minimum(r, len(starts) - 1)  # rows behind the last one with an entry have none
        n = starts[np.minimum(r + 1, len(starts) - 1)] - starts[r]
        entry = by[np.repeat(starts[r] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        want = np.repeat(c, n) * width + f[entry]
        found = np.minimum(np.searchsorted(key, want, side="right") - 1, len(key) - 1)
        value = np.where((found >= 0) & (key[found] == want), u[entry] * step[f[entry]] * v[found], 0.0)
        out[lo : lo + PAIRS] = np.bincount(np.repeat(np.arange(len(r)), n), value, len(r))
    return out


def _meet_entries(total, left, right, counts, starts):
    """Add the products of entries that share a column; ``starts`` is where the right entries of a left one's column begin."""
    (i, f, u), (j, v), flat = left, right, total.reshape(-1)
    n = counts[f]
    upto = np.cumsum(n)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, MET)[1:])
    for part in np.split(np.arange(len(i)), cuts):
        m = n[part]
        entry = np.repeat(starts[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
        np.add.at(flat, np.repeat(i[part], m) * total.shape[1] + j[entry], (np.repeat(u[part], m) * v[entry]).astype(total.dtype))


def _block_pairs(xs, ys, need: Threshold):
    """(rows of xs, rows of ys, overlaps) of all pairs that reach the threshold.

    Columns are multiplied until what is left lets so few pairs reach it that these are finished entry by entry.
    """
    (i, f, u), (j, g, v), step = _common(xs, ys, need.product)
    width, nx, ny = len(step), xs["n"], ys["n"]
    none = np.zeros(0, np.intp)
    if not width:
        return none, none, np.zeros(0)
    whole = all(np.array_equal(c, np.rint(c)) for c in (u, v, step))
    kind = np.float32 if whole and max(nx.max(), ny.max()) < 1 << 24 else np.float64  # sums of whole numbers stay exact
    total = np.zeros((len(nx), len(ny)), kind)
    rx, ry = np.bincount(i, step[f] * u * u, len(nx)), np.bincount(j, step[g] * v * v, len(ny))

    def alive(rx, ry):
        """Pairs that could reach the threshold, as what is left adds at most the product of the rows' roots."""
        out = [(none, none)]
        for lo in range(0, len(nx), 256):
            part, a, b = total[lo : lo + 256], nx[lo : lo + 256, None], ny[None, :]
            least = need.reach(np.minimum(a, b), np.maximum(a, b)) - SLACK
            r, c = np.nonzero(part + np.sqrt(rx[lo : lo + 256, None] * ry[None, :]) >= least)
            out.append((r + lo, c))
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])

    # A run of columns is one product of matrices, or, where few rows of both sides share a column, their meetings.
    counts_x, counts_y = np.bincount(f, minlength=width), np.bincount(g, minlength=width)
    runs = np.arange(0, width, COLUMNS)
    met = np.add.reduceat(counts_x.astype("float64") * counts_y, runs)
    dense = total.size * np.minimum(COLUMNS, width - runs).astype("float64")
    cost = np.minimum(dense, met * ENTRY)
    pairs, at, to = None, 0, 0
    for run, lo in enumerate(runs):
        n = min(COLUMNS, width - lo)
        to_x, to_y = np.searchsorted(f, lo + n), np.searchsorted(g, lo + n)
        if cost[run] < dense[run]:
            _meet_entries(total, (i[at:to_x], f[at:to_x], u[at:to_x] * step[f[at:to_x]]), (j, v), counts_y, np.searchsorted(g, f[at:to_x]))
        else:
            left, right = np.zeros((len(nx), n), kind), np.zeros((len(ny), n), kind)
            left[i[at:to_x], f[at:to_x] - lo] = u[at:to_x] * step[f[at:to_x]]
            right[j[to:to_y], g[to:to_y] - lo] = v[to:to_y]
            total += left @ right.T
        rx -= np.bincount(i[at:to_x], step[f[at:to_x]] * u[at:to_x] ** 2, len(nx))
        ry -= np.bincount(j[to:to_y], step[g[to:to_y]] * v[to:to_y] ** 2, len(ny))
        at, to = to_x, to_y
        ahead = cost[run + 1 :].sum()
        if ahead > total.size * PASS:
            # Rounding may leave the rest a little too small.
            found = alive(np.maximum(rx, 0.0) + SLACK * nx, np.maximum(ry, 0.0) + SLACK * ny)
            if len(found[0]) * (len(f) - at) / len(nx) * LOOKUP <= ahead:
                pairs = found
                break
    if pairs is None:
        pairs = np.nonzero(total) if np.count_nonzero(total) * 4 < total.size else alive(np.zeros(len(nx)), np.zeros(len(ny)))
    value = total[pairs].astype("float64")
    if at < len(f):
        value = value + _late(pairs, (i[at:], f[at:], u[at:]), (j[to:], g[to:], v[to:]), step, width)
    a, b = nx[pairs[0]], ny[pairs[1]]
    kept = (value > 0) & (value >= need.reach(np.minimum(a, b), np.maximum(a, b)) - SLACK)
    return pairs[0][kept], pairs[1][kept], value[kept]


def packed_blocks(rows: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """One row per block of consecutive ids: (_b, id, lens, n, fs, ws), features as numbers; and the number of blocks.

    The rows are shuffled once, as numbers.
    """
    ids, features = checkpointed(dense_index(rows, "id", "i")), checkpointed(dense_index(rows, "f", "_f"))
    n, entries = ids.count(), rows.count()
    size = size or max(256, min(BLOCK, n // 16, ENTRIES * n // max(entries, 1)))
    block = F.floor(F.col("i") / size).cast("int")
    x = rows.join(features, "f", "left").join(ids, "id")
    x = x.select(block.alias("_b"), (F.col("i") % size).cast("int").alias("_at"), F.col("_f").cast("int").alias("_f"), F.col("w").cast("double").alias("w"))
    names = ids.select(block.alias("_o"), (F.col("i") % size).cast("int").alias("_at"), F.col("id").alias("_id"))
    kind = dict(rows.dtypes)["id"]

    def pack(key, entries, names):
        names, entries = names.sort_values("_at"), entries.sort_values(["_at", "_f"])
        at, w = entries["_at"].to_numpy(), entries["w"].to_numpy()
        listed = entries["_f"].notna().to_numpy()  # a null feature counts as size only
        return pd.DataFrame({
            "_b": [key[0]], "id": [names["_id"].to_list()], "lens": [np.bincount(at[listed], minlength=len(names)).astype("int32")],
            "n": [np.bincount(at, w * w, len(names))], "fs": [entries["_f"].to_numpy()[listed].astype("int32")], "ws": [w[listed]],
        })

    out = x.groupBy("_b").cogroup(names.groupBy("_o")).applyInPandas(
        pack, f"_b int, id array<{kind}>, lens array<int>, n array<double>, fs array<int>, ws array<double>"
    )
    return checkpointed(out), -(-n // size)


def block_meetings(packed: DataFrame, blocks: int) -> DataFrame:
    """All pairs of packed blocks, each once, and every block with itself: the columns of one end in _x, of the other in _y."""
    side = lambda s: packed.select(*[F.col(c).alias(f"{c}_{s}") for c in packed.columns])
    # Every block meets those up to half the circle behind it, so all have as much to do.
    apart = F.pmod(F.col("_b_y") - F.col("_b_x"), F.lit(max(blocks, 1)))
    due = (apart * 2 < blocks) | ((apart * 2 == blocks) & (F.col("_b_x") < F.col("_b_y")))
    return side("x").hint("shuffle_replicate_nl").join(side("y"), due)


def block_overlaps(rows: DataFrame, need: Threshold, size: int | None = None) -> DataFrame:
    """What ``overlaps`` gives, of all pairs: packed blocks of rows meet, each pair of blocks as one product of matrices.

    The blocks are read from their table for every meeting, so no copy of a row is shuffled, and nothing is gathered per pair.
    """
    packed, blocks = packed_blocks(rows, size)
    met = block_meetings(packed, blocks)

    def meet(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                xs, ys = ({c: row[f"{c}_{s}"] for c in packed_columns} for s in ("xy" if row["_b_x"] <= row["_b_y"] else "yx"))
                r, c, value = _block_pairs(xs, ys, need)
                if xs["_b"] == ys["_b"]:
                    r, c, value = r[r < c], c[r < c], value[r < c]
                for lo in range(0, len(r), PAIRS):
                    p, q = r[lo : lo + PAIRS], c[lo : lo + PAIRS]
                    yield pd.DataFrame({"a": xs["id"][p], "b": ys["id"][q], "overlap": value[lo : lo + PAIRS], "na": xs["n"][p], "nb": ys["n"][q]})

    packed_columns, kind = packed.columns, dict(rows.dtypes)["id"]
    return met.mapInPandas(meet, f"a {kind}, b {kind}, overlap double, na double, nb double")


def meetings(x: DataFrame) -> tuple[float, int]:
    """How many meetings of two rows under a feature the index lists, and the number of features."""
    by = x.groupBy("f").agg(F.sum(F.col("short").cast("long")).alias("s"), F.sum(F.col("long").cast("long")).alias("l"))
    met, width = by.agg(F.sum(F.col("s").cast("double") * F.col("l")), F.count("*")).first()
    return met or 0.0, width


def meets_in_blocks(x: DataFrame) -> bool:
    """Whether the index lists so many pairs that blocks cost less: every pair is looked at, and columns are multiplied or their entries met."""
    met, width = meetings(x)
    n, longest = x.groupBy("id").agg(F.count("*").alias("c")).agg(F.count("*"), F.max("c")).first()
    full = x.groupBy("f").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")) / 2).first()[0] or 0.0
    pairs = n * n / 2
    return bool(n) and longest <= WIDEST and met * MEETING >= min(pairs * width, pairs * LOOK + full * ENTRY)


def overlaps(rows: DataFrame, need: Threshold) -> DataFrame:
    """Pairs (a < b) that reach the threshold: (a, b, overlap, na, nb)."""
    rows = checkpointed(rows)
    term = (lambda p, q: p * q) if need.product else (lambda p, q: F.least(p * p, q * q))
    n_rows = rows.count()
    if n_rows > INDEXED:
        # The marks of all rows are several shuffles of the table: some ids tell which plan costs less, and only that.
        freq = checkpointed(rows.groupBy("f").agg(F.count("*").alias("_df")))
        some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n_rows // INDEXED + 1)) == 0)
        if meets_in_blocks(checkpointed(index_rows(some, need, n_rows=n_rows, freq=freq))):
            return block_overlaps(rows, need)
    # The marked rows and the candidates are read more than once below: write each once.
    x = checkpointed(index_rows(rows, need, n_rows=n_rows))
    if n_rows <= INDEXED and meets_in_blocks(x):
        return block_overlaps(rows, need)
    rest = x.groupBy("id").agg(
        F.sum(F.when(~F.col("short"), F.col("_w2")).otherwise(0.0)).alias("rs"),
        F.sum(F.when(~F.col("long"), F.col("_w2")).otherwise(0.0)).alias("rl"),
    )
    x = salted_join(x.drop("_w2"), rest, ["id"], rows=n_rows)
    small = x.filter("short").select(F.col("id").alias("x"), "f", F.col("w").alias("wx"), F.col("n").alias("nx"), F.col("rs").alias("rx"), F.col("_df").alias("_dx"))
    large = x.filter("long").select(F.col("id").alias("y"), "f", F.col("w").alias("wy"), F.col("n").alias("ny"), F.col("rl").alias("ry"), F.col("_df").alias("_dy"))
    # Partners travel to x as lists, and x adds up what it unpacks: no meeting is shuffled by itself. Tasks grow with the meetings.
    small, large = posting_blocks(small, "_dx", ("_p", "_q")), posting_lists(large, "_dy", ("_q", "_p"), ["y", "wy", "ny", "ry"])
    if need.unit_weights:
        ordered = lambda y, ny: (F.col("nx") < ny) | ((F.col("nx") == ny) & (F.col("x") < y))
        bound = F.greatest("rx", "ry")
    else:
        ordered = lambda y, ny: F.col("x") < y
        bound = F.sqrt(F.greatest(F.col("rx") * F.col("ny"), F.col("ry") * F.col("nx")))
    wanted = need.pair(F.col("nx"), F.col("ny")) - SLACK
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(meetings(x)[0]) // TASK_MEETINGS))
    fits = F.filter("_l", lambda e: ordered(e["y"], e["ny"]) & need.sizes(F.col("nx"), e["ny"]))
    seen = small.join(large, ["f", "_p", "_q"]).select("x", "wx", "nx", "rx", fits.alias("_l")).filter(F.size("_l") > 0)
    seen = seen.select("x", "wx", "nx", "rx", *[F.col(f"_l.{c}").alias(c) for c in ("y", "wy", "ny", "ry")]).repartition(tasks, "x")
    seen = seen.select("x", "wx", "nx", "rx", F.explode(F.arrays_zip("y", "wy", "ny", "ry")).alias("_e")).select("x", "wx", "nx", "rx", "_e.*")
    seen = seen.groupBy("x", "y").agg(
        F.sum(term(F.col("wx"), F.col("wy"))).alias("seen"), *[F.first(c).alias(c) for c in ("nx", "ny", "rx", "ry")]
    )
    alive = checkpointed(seen.filter(F.col("seen") + bound >= wanted))

    # Survivors whose rows have features outside the index fetch what it did not pair.
    unseen = (F.col("rx") > SLACK) | (F.col("ry") > SLACK)
    fx = x.select(F.col("id").alias("x"), "f", F.col("w").alias("wx"), F.col("short").alias("ix"))
    fy = x.select(F.col("id").alias("y"), "f", F.col("w").alias("wy"), F.col("long").alias("iy"))
    done = alive.filter(~unseen).select("x", "y", F.col("seen").alias("overlap"), "nx", "ny")
    if alive.filter(unseen).isEmpty():
        return _in_order(done.filter(F.col("overlap") >= wanted))
    late = alive.filter(unseen).join(fx, "x").join(fy, ["y", "f"], "left")
    extra = F.when(F.col("wy").isNotNull() & ~(F.col("ix") & F.col("iy")), term(F.col("wx"), F.col("wy")))
    late = late.groupBy("x", "y").agg(
        (F.first("seen") + F.coalesce(F.sum(extra), F.lit(0))).alias("overlap"), F.first("nx").alias("nx"), F.first("ny").alias("ny")
    )
    return _in_order(done.unionByName(late).filter(F.col("overlap") >= wanted))


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y, overlap, nx, ny) with the lesser id first."""
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return pairs.select(
        pick("x", "y").alias("a"), pick("y", "x").alias("b"), "overlap", pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb")
    )


def nearest(rows: DataFrame, k: int, caps=CAPS) -> DataFrame:
    """(src, dst, s): the k nearest by the Jaccard coefficient among those that share a feature; ties go to the smaller id.

    Round by round ids meet the rows that share one of their features of up to ``cap`` rows. What the more frequent
    features add is looked up only for pairs that could still be among the k best. Rows that share only frequent
    features reach at most (their number) / (the id's size): an id whose k-th best is above that is done, the others
    go on with the next cap. So a hub's rows meet each other only where nothing rarer settles an id.
    """
    ids = checkpointed(dense_index(rows, "id", "i"))
    freq = rows.groupBy("f").agg(F.count("*").alias("_df"))
    x = checkpointed(rows.select("id", "f").join(freq, "f").join(ids, "id").select("i", "f", "_df"))
    most = x.agg(F.max("_df")).first()[0] or 0
    out, todo = None, None
    for cap in caps:
        last = cap is None or cap >= most
        cap = most if last else cap
        hot = x.filter(F.col("_df") > cap).select("i", "f")
        size = x.groupBy("i").agg(F.count("*").alias("n"), F.sum((F.col("_df") > cap).cast("int")).alias("h"))
        cold = checkpointed(x.filter(F.col("_df") <= cap).join(size, "i"))
        mine = (cold if todo is None else cold.join(todo, "i", "left_semi")).select(F.col("i").alias("x"), "f", "n", F.col("h").alias("hx"), "_df")
        theirs = cold.select(F.col("i").alias("y"), "f", F.col("n").alias("m"), F.col("h").alias("hy"), F.col("_df").alias("_dy"))
        met = posting_blocks(mine, "_df", ("_p", "_q")).join(posting_blocks(theirs, "_dy", ("_q", "_p")), ["f", "_p", "_q"]).filter(F.col("x") != F.col("y"))
        # Dealt by x once: the counts and the order of an id's candidates need no further shuffle.
        pair = ["x", "y", "n", "m"] + ([] if last else ["hx", "hy"])
        seen = met.select(*pair).repartition("x").groupBy(*pair).agg(F.count("*").alias("o"))
        jaccard = lambda o: o / (F.col("n") + F.col("m") - o)
        best = W.partitionBy("x").orderBy(F.desc("s"), "y")
        if not last:
            more = F.least("hx", "hy")
            kth = F.max(F.when(F.col("_r") == k, F.col("s"))).over(W.partitionBy("x"))
            bounded = seen.withColumn("s", jaccard(F.col("o"))).withColumn("_r", F.row_number().over(best)).withColumn("_kth", F.coalesce(kth, F.lit(0.0)))
            alive = checkpointed(bounded.filter(jaccard(F.col("o") + more) >= F.col("_kth") - SLACK).drop("s", "_r", "_kth"))
            late = alive.filter(more > 0).select("x", "y").join(hot.withColumnRenamed("i", "x"), "x").join(hot.withColumnRenamed("i", "y"), ["y", "f"], "left_semi")
            late = late.groupBy("x", "y").agg(F.count("*").alias("_late"))
            seen = alive.join(late, ["x", "y"], "left").withColumn("o", F.col("o") + F.coalesce("_late", F.lit(0)))
        found = seen.withColumn("s", jaccard(F.col("o"))).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select("x", "y", "s", "_r")
        if last:
            out = found if out is None else out.unionByName(found)
            break
        found = checkpointed(found)
        state = size.join(found.filter(F.col("_r") == k).select(F.col("x").alias("i"), F.col("s").alias("_kth")), "i", "left")
        state = state if todo is None else state.join(todo, "i", "left_semi")
        done = (F.col("h") == 0) | (F.coalesce("_kth", F.lit(0.0)) > F.col("h") / F.col("n") + SLACK)
        state = checkpointed(state.select("i", done.alias("_done")))
        found = found.join(state.filter("_done").select(F.col("i").alias("x")), "x", "left_semi")
        out = found if out is None else out.unionByName(found)
        todo = state.filter("not _done").select("i")
        if not todo.head(1):
            break
    named = out.join(ids.select(F.col("i").alias("x"), F.col("id").alias("src")), "x").join(ids.select(F.col("i").alias("y"), F.col("id").alias("dst")), "y")
    return named.select("src", "dst", "s")


def expand_knn(sim: DataFrame, members: DataFrame, k: int, value: str = "s", same: float = 1.0, both: bool = True) -> DataFrame:
    """k nearest others per id from similarities (a, b) of representatives, each pair given once or, if not ``both``, for a alone.

    Copies are nearest with value ``same``; ties go to the smaller id. Only the
    first k + 1 members of a group of copies can be anyone's nearest, so groups are
    never expanded against each other.
    """
    by_id = W.partitionBy("rep").orderBy("id")
    heads = members.withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k + 1).select("rep", "id")
    ways = [F.struct("a", "b")] + [F.struct(F.col("b").alias("a"), F.col("a").alias("b"))] * both
    both = sim.select(F.explode(F.array(*ways)).alias("p"), value)
    near = W.partitionBy("rep").orderBy(F.desc(value), "other")
    near_reps = both.select(F.col("p.a").alias("rep"), F.col("p.b").alias("other"), value)
    near_reps = near_reps.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1).drop("_r")
    foreign = near_reps.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("dst")), "other").select("rep", "dst", value)
    own = heads.select("rep", F.col("id").alias("dst"), F.lit(same).alias(value))
    best = W.partitionBy("rep").orderBy(F.desc(value), "dst")
    pool = own.unionByName(foreign).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    mine = W.partitionBy("src").orderBy(F.desc(value), "dst")
    out = members.select(F.col("id").alias("src"), "rep").join(pool, "rep").filter(F.col("src") != F.col("dst"))
    out = out.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return out.select("src", "dst", value, "rank")


def knn(rows: DataFrame, k: int, caps=CAPS) -> DataFrame:
    """Exactly k nearest others (src, dst, s, rank) of every id by the Jaccard coefficient; ties go to the smaller id.

    Ids with fewer than k that share a feature are filled up with the smallest ids that share nothing, with value 0:
    2 k + 1 smallest ids are enough to fill any of them.
    """
    rows = checkpointed(rows.select("id", "f", "w"))
    reps, members = fold_copies(rows)
    near = nearest(checkpointed(reps), k + 1, caps)
    found = checkpointed(expand_knn(near.select(F.col("src").alias("a"), F.col("dst").alias("b"), "s"), members, k, both=False).select("src", "dst", "s"))
    ids = rows.select(F.col("id").alias("src")).distinct()
    have = found.groupBy(F.col("src").alias("_src")).agg(F.count("*").alias("_c"))
    short = ids.join(have, F.col("src") == F.col("_src"), "left").filter(F.coalesce("_c", F.lit(0)) < k).select("src")
    least = ids.orderBy("src").limit(2 * k + 1).agg(F.collect_list("src").alias("_l"))
    blank = short.join(F.broadcast(least)).select("src", F.explode("_l").alias("dst")).filter(F.col("src") != F.col("dst"))
    blank = blank.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("s", F.lit(0.0))
    best = W.partitionBy("src").orderBy(F.desc("s"), "dst")
    return found.unionByName(blank).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
