"""Negative sampling and cross-validation splits.

All picks follow md5 orders of (seed, ids). Non-partners are never enumerated
against all partners: a drug with d partners walks a pseudo-random permutation of
the targets, and among its first (ratio + 1)·d positions at least ratio·d are
non-partners. The candidates are therefore linear in the number of edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import digest_bucket, digest_int, order_key
from .edges import band_join, mirror, stack_labels
from .scale import checkpointed, dense_index, ranked, ranked_by_value, running_sum, salted_join

DRAWS = 1024  # that one row deals
TASK_DRAWS = 1 << 20  # that one task makes


def _draw(seed, n: Column, *parts: Column) -> Column:
    """An even pseudo-random number below n, from a digest of the parts."""
    return F.pmod(digest_int(order_key(seed, *parts), 1, 13), n)


def _draws(want: Column, free: Column, n: int) -> Column:
    """Draws among n targets that nearly always hold ``want`` different ones of ``free``: the mean and three deviations."""
    mean = F.lit(float(n)) * -F.log1p(-want / free)
    return F.ceil(mean + 3 * F.sqrt(F.greatest(mean - want, F.lit(0.0))) + 2).cast("long")


def negatives_per_drug(pos: DataFrame, targets: DataFrame, ratio: int = 1, seed: int = 0) -> DataFrame:
    """min(#non-partners, ratio·#partners) random non-partners of each drug: (src, dst).

    ``pos`` holds distinct edges, ``targets`` the column ``dst`` of all targets. A drug
    of d partners reads the sequence of draws i = 0, 1, …, each an even choice among
    the targets by a digest of (seed, drug, i), and keeps the first ratio·d different
    non-partners. Rounds make draws for the drugs that still lack some. Where that many
    are half of the targets or more, the drug takes its non-partners in md5 order
    instead: there are then at most 2 (ratio + 1) targets for each of its edges.
    """
    pos = checkpointed(pos.select("src", "dst"))
    index = checkpointed(dense_index(targets, "dst"))
    n = index.count()
    deg = pos.groupBy("src").agg(F.count("*").alias("deg")).withColumn("want", F.least(F.col("deg") * ratio, F.lit(n) - F.col("deg")))
    deg = checkpointed(deg.filter(F.col("want") > 0).withColumn("many", (F.col("deg") * (ratio + 1) * 2) >= n))
    pick = lambda x, order: ranked(x, ["src"], [order, "dst"], digest_bucket(F.col(order)) if order == "_k" else F.col("_b"), "r").filter(F.col("r") <= F.col("want"))

    full = deg.filter("many").select("src", "want", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("idx"))
    full = full.join(index, "idx").join(pos, ["src", "dst"], "left_anti").withColumn("_k", order_key(seed, "src", "dst"))
    out = pick(full, "_k").select("src", "dst")

    # Draws are numbered; those of a round follow on those before. The first round makes about as many as will do, the next
    # ones an eighth of that. Targets are numbers until the picks are named, and a draw is shuffled once to meet its repeats.
    taken = pos.join(index, "dst").select("src", "idx")
    short = checkpointed(deg.filter(~F.col("many") & F.col("src").isNotNull()).select("src", "want", F.lit(0).cast("long").alias("lo"), _draws(F.col("want"), F.lit(n) - F.col("deg"), n).alias("step")))
    kept, chosen = None, None
    while total := short.agg(F.sum("step")).first()[0]:
        tasks = max(int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DRAWS))
        parts = F.ceil(F.col("step") / DRAWS)
        dealt = short.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).repartition(tasks, "src", "_at")
        spot = F.sequence(F.col("_at") * DRAWS, F.least((F.col("_at") + 1) * DRAWS, "step") - 1)
        drawn = dealt.select("src", "lo", F.explode(spot).alias("i")).select("src", (F.col("i") + F.col("lo")).alias("i"))
        drawn = drawn.select("src", _draw(seed, F.lit(n), F.col("src"), F.col("i").cast("string")).alias("idx"), "i")
        mine = taken if kept is None else taken.join(short, "src", "left_semi")
        pool = drawn.unionByName(mine.withColumn("i", F.lit(-1).cast("long")))
        pool = pool if kept is None else pool.unionByName(kept)
        first = checkpointed(pool.groupBy("src", "idx").agg(F.min("i").alias("i")).filter("i >= 0"))
        found = first.groupBy("src").agg(F.count("*").alias("_c"))
        state = checkpointed(short.join(found, "src", "left").withColumn("_ready", F.coalesce("_c", F.lit(0)) >= F.col("want")).drop("_c"))
        ready = first.join(state.filter("_ready").select("src", "want"), "src").withColumn("_b", F.floor(F.col("i") * 16 / F.col("want")))
        ready = pick(ready.withColumnRenamed("idx", "dst"), "i").select("src", F.col("dst").alias("idx"))
        chosen = ready if chosen is None else chosen.unionByName(ready)
        short = state.filter("not _ready").select("src", "want", (F.col("lo") + F.col("step")).alias("lo"), F.ceil((F.col("step") + 7) / 8).alias("step"))
        short = checkpointed(short)
        kept = first.join(short, "src", "left_semi")
    return out if chosen is None else out.unionByName(chosen.join(index, "idx").select("src", "dst"))


def all_negatives(candidates: DataFrame, pos: DataFrame) -> DataFrame:
    """Every candidate pair that is not an interaction."""
    return candidates.join(pos.select("src", "dst"), ["src", "dst"], "left_anti")


def negatives_global(pos: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """n random unseen pairs of all drugs × targets (default: as many as edges; all unseen ones if fewer).

    Draw j = 0, 1, … chooses a drug and a target by digests of (seed, j); the first n
    different unseen pairs are kept. Rounds of draws go on until there are enough.
    """
    pos = checkpointed(pos.select("src", "dst").distinct())
    src, dst = checkpointed(dense_index(pos, "src", "i")), checkpointed(dense_index(pos, "dst", "j"))
    n_src, n_dst, m = src.count(), dst.count(), pos.count()
    n = min(m if n is None else n, n_src * n_dst - m)
    if n <= 0:
        return pos.limit(0)
    if 2 * (n + m) >= n_src * n_dst:  # at most two pairs of the product for each that is given or wanted
        all_ = src.select("src").join(dst.select("dst")).join(pos, ["src", "dst"], "left_anti").withColumn("_k", order_key(seed, "src", "dst"))
        return ranked(all_, [], ["_k", "src", "dst"], digest_bucket(F.col("_k"), 3), "r").filter(F.col("r") <= n).select("src", "dst")
    first, rnd = None, 0
    while first is None or first.count() < n:
        js = pos.sparkSession.range(2 * n * rnd, 2 * n * (rnd + 1)).withColumnRenamed("id", "pick")
        at = F.col("pick").cast("string")
        x = js.select("pick", _draw(f"{seed}s", F.lit(n_src), at).alias("i"), _draw(f"{seed}t", F.lit(n_dst), at).alias("j"))
        x = x.join(src, "i").join(dst, "j").join(pos, ["src", "dst"], "left_anti").select("src", "dst", "pick")
        x = x if first is None else x.unionByName(first)
        first = checkpointed(x.groupBy("src", "dst").agg(F.min("pick").alias("pick")))
        rnd += 1
    bucket = F.expr(f"CAST(pick div {max(1, 2 * n * rnd // 4096)}L AS INT)")
    return ranked(first, [], ["pick"], bucket, "r").filter(F.col("r") <= n).select("src", "dst")


def negatives_by_distance(pos: DataFrame, distance: DataFrame, lo: float, hi: float, seed: int = 0) -> DataFrame:
    """For each positive an unused non-partner of its drug with lo < d < hi to its target.

    Equals the greedy pass over a drug's targets in md5 order where each takes its
    first free candidate in md5 order. Computed as rounds of proposals: every target
    without a candidate proposes to its next one; a candidate keeps the proposal
    with the smallest key. The other targets of a drug of d partners hold at most d - 1
    candidates, so none needs more than its first d. Drugs whose targets all hold one
    leave the rounds, which go on until none is left. Rows are (src, dst positive, neg).
    """
    pos = checkpointed(pos.select("src", "dst"))
    cand = band_join(pos, distance, lo, hi)
    cand = cand.join(pos.select("src", F.col("dst").alias("cand")), ["src", "cand"], "left_anti")
    cand = cand.withColumn("_k", order_key(seed, "src", "dst", "cand")).withColumn("prio", order_key(seed, "src", "dst"))
    cand = checkpointed(cand.select("src", "dst", "cand", "prio", "_k"))
    cand = ranked(cand, ["src", "dst"], ["_k", "cand"], digest_bucket(F.col("_k")), "r").drop("_k")
    degree = pos.groupBy("src").agg(F.count("*").alias("_d"))
    cand = checkpointed(salted_join(cand, degree, ["src"]).filter(F.col("r") <= F.col("_d")).drop("_d"))
    # State: the next candidate number per positive of the drugs still at work.
    state = checkpointed(cand.select("src", "dst").distinct().withColumn("r", F.lit(1).cast("long")))
    done = None
    while True:
        bids = state.join(cand, ["src", "dst", "r"])
        best = bids.groupBy("src", "cand").agg(F.min(F.struct("prio", "dst")).alias("w"))
        judged = bids.join(best, ["src", "cand"]).withColumn("won", F.col("dst") == F.col("w.dst"))
        judged = checkpointed(judged.select("src", "dst", "r", "cand", "won"))
        open_ = judged.filter(~F.col("won")).select("src").distinct()
        settled = judged.join(open_, "src", "left_anti").select("src", "dst", F.col("cand").alias("neg"))
        done = settled if done is None else checkpointed(done.unionByName(settled))
        # Losers move on; those past their last candidate drop out of the join above.
        state = judged.join(open_, "src", "left_semi").select("src", "dst", F.when(F.col("won"), F.col("r")).otherwise(F.col("r") + 1).alias("r"))
        if judged.filter(~F.col("won")).isEmpty():
            return done


def negatives_nearest(pos: DataFrame, distance: DataFrame) -> DataFrame:
    """Nearest non-partner of the drug for each positive (may repeat): (src, dst, neg, d)."""
    near = mirror(distance, "d").select(F.col("a").alias("dst"), F.col("b").alias("neg"), "d")
    x = pos.select("src", "dst").join(near, "dst")
    x = x.join(pos.select("src", F.col("dst").alias("neg")), ["src", "neg"], "left_anti")
    best = x.groupBy("src", "dst").agg(F.min(F.struct("d", "neg")).alias("m"))
    return best.select("src", "dst", F.col("m.neg").alias("neg"), F.col("m.d").alias("d"))


def holdout_final(pos: DataFrame, min_targets: int = 2, min_mult: int = 5, seed: int = 0) -> DataFrame:
    """One positive per drug to a final fold, without emptying a target: (src, dst).

    Drugs of more than ``min_targets`` targets offer their target of the highest
    multiplicity, if above ``min_mult``. A target gives drugs away in md5 order while
    its multiplicity stays at ``min_mult`` or more; drugs it turns down offer again
    with the lowered multiplicities, until no drug has an offer left.
    """
    pos = checkpointed(pos.select("src", "dst").distinct())
    eligible = pos.groupBy("src").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_targets).select("src")
    waiting = checkpointed(pos.join(eligible, "src", "left_semi"))
    mult = checkpointed(pos.groupBy("dst").agg(F.count("*").alias("mult")))
    taken = None
    while True:  # each round takes a drug of every target that has offers
        offers = waiting.join(mult.filter(F.col("mult") > min_mult), "dst")
        offers = offers.groupBy("src").agg(F.min(F.struct((-F.col("mult")).alias("m"), "dst")).alias("b"))
        offers = offers.select("src", F.col("b.dst").alias("dst"), (-F.col("b.m")).alias("mult"))
        offers = checkpointed(offers.withColumn("_k", order_key(seed, "src", "dst")))
        if offers.isEmpty():
            break
        got = ranked(offers, ["dst"], ["_k", "src"], digest_bucket(F.col("_k")), "r")
        got = checkpointed(got.filter(F.col("r") <= F.col("mult") - min_mult).select("src", "dst"))
        taken = got if taken is None else taken.unionByName(got)
        gone = got.groupBy("dst").agg(F.count("*").alias("_g"))
        mult = checkpointed(mult.join(gone, "dst", "left").select("dst", (F.col("mult") - F.coalesce("_g", F.lit(0))).alias("mult")))
        waiting = checkpointed(waiting.join(got.select("src"), "src", "left_anti"))
    return taken if taken is not None else pos.limit(0)


def final_negatives(pos: DataFrame, distance: DataFrame, lo: float = 2.5, hi: float = 5.0, n: int | None = None, seed: int = 0) -> DataFrame:
    """One non-partner per drug within the band of a target of its, ``n`` of them in md5 order: (src, dst)."""
    near = band_join(pos.select("src", "dst"), distance, lo, hi).select("src", F.col("cand").alias("dst"))
    near = near.join(pos.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("_k", order_key(seed, "src", "dst"))
    one = near.groupBy("src").agg(F.min(F.struct("_k", "dst")).alias("b")).select("src", "b.dst", F.col("b._k").alias("_k"))
    if n is None:
        return one.drop("_k")
    return ranked(one, [], ["_k", "src"], digest_bucket(F.col("_k"), 3), "_r").filter(F.col("_r") <= n).drop("_k", "_r")


# -- folds ------------------------------------------------------------------

def folds_sp(pairs: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """Pairs dealt to folds round-robin, drug by drug in md5 order (warm–warm).

    One running number over all drugs keeps the folds equal in size: the number of
    pairs of earlier drugs plus the pair's place within its drug.
    """
    x = pairs.withColumn("_k", order_key(seed, "src", "dst"))
    x = ranked(x, ["src"], ["_k", "dst"], digest_bucket(F.col("_k")), "_r")
    start = _drug_starts(pairs, seed)
    return salted_join(x, start, ["src"]).withColumn("fold", ((F.col("_start") + F.col("_r") - 1) % n).cast("int")).drop("_k", "_r", "_start")


def _drug_starts(pairs: DataFrame, seed) -> DataFrame:
    """Number of pairs of the drugs that come before a drug in md5 order."""
    deg = pairs.groupBy("src").agg(F.count("*").alias("_d")).withColumn("_s", order_key(seed, "src"))
    upto = running_sum(deg, [], ["_s", "src"], digest_bucket(F.col("_s"), 3), {"_upto": F.col("_d")})
    return upto.select("src", (F.col("_upto") - F.col("_d")).alias("_start"))


def folds_by_entity(pairs: DataFrame, entity: str, n: int = 10, seed: int = 0) -> DataFrame:
    """All pairs of an entity to one fold; entities dealt in order of decreasing pair count.

    Entities of equal count are dealt in md5 order.
    """
    deg = pairs.groupBy(entity).agg(F.count("*").alias("_d"))
    rank = ranked_by_value(deg, [], "_d", order_key(seed, entity), "_r")
    return salted_join(pairs, rank.select(entity, ((F.col("_r") - 1) % n).cast("int").alias("fold")), [entity])


def folds_sd(pairs: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    return folds_by_entity(pairs, "src", n, seed)


def folds_st(pairs: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    return folds_by_entity(pairs, "dst", n, seed)


def fold_spread(folds: DataFrame, entity: str) -> DataFrame:
    """Number of folds that an entity occurs in, and one of them."""
    return folds.groupBy(entity).agg(F.count_distinct("fold").alias("n_folds"), F.min("fold").alias("fold"))


def _any_offer(offers: DataFrame, crucial: DataFrame, taken: DataFrame, e: str, p: str) -> DataFrame:
    """A replacement for some crucial entities (need, home), and for none only if no offer (fold, src, dst) fits any.

    An offer fits an entity in another fold whose partner it is not paired with yet. Partners are numbered in each
    fold: an entity with n partners finds one that is not among them in the first n + 1 of a fold, if there is any.
    """
    one = offers.groupBy("fold", p).agg(F.min(e).alias(e)).withColumn("_k", order_key("any", "fold", p))
    one = checkpointed(ranked(one, ["fold"], ["_k", p], digest_bucket(F.col("_k")), "r"))
    known = taken.groupBy(F.col(e).alias("need")).agg(F.count("*").alias("_n"))
    folds = offers.select("fold").distinct()
    asks = crucial.join(known, "need", "left").join(folds, F.col("fold") != F.col("home"))
    asks = asks.select("need", "fold", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(0)) + 1)).alias("r"))
    fits = asks.join(one, ["fold", "r"]).join(taken.select(F.col(e).alias("need"), p), ["need", p], "left_anti")
    # One for each entity, and none twice from the same spare entity or to the same pair.
    fits = fits.groupBy("need").agg(F.min_by(F.struct("fold", e, p), "r").alias("o")).select("need", "o.*")
    fits = fits.groupBy(e).agg(F.min_by(F.struct("fold", p, "need"), "need").alias("o")).select(e, "o.*")
    new = {e: F.col("need"), p: F.col(p)}
    return fits.select("fold", F.col("src").alias("old_src"), F.col("dst").alias("old_dst"), new["src"].alias("src"), new["dst"].alias("dst"))


def repair_folds(folds: DataFrame, positives: DataFrame, mode: str = "Sp", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Replace negatives so that no target (Sp, Sd) or drug (St) sits in one fold only.

    A *crucial* entity occurs in exactly one fold, a *spare* one in three or more. For
    each crucial entity a negative of another fold with a spare entity gives its place
    to (partner, crucial entity, 0). The partner must be spare in Sp and occur in a
    single fold in Sd and St. Replacements that would be true positives or repeat a pair
    are not made. Rounds stop when nothing is crucial or no replacement is possible any
    more; the second result lists what remains crucial (everything, if there is a single
    fold). A repair makes no entity crucial, so the rounds end.

    In each round negatives are offered to crucial entities one to one, by equal
    rank in md5 order among those of the same fold, shifted by the round. A round without
    a repair is followed by one that looks at all offers (``_any_offer``).
    """
    e, p = ("src", "dst") if mode == "St" else ("dst", "src")
    current = checkpointed(folds.select("fold", "src", "dst", "label"))
    known = positives.select("src", "dst").distinct()
    n_folds = current.agg(F.count_distinct("fold")).first()[0]
    rnd = -1
    while n_folds > 1:
        rnd += 1
        spread = checkpointed(fold_spread(current, e))
        crucial = spread.filter(F.col("n_folds") == 1).select(F.col(e).alias("need"), F.col("fold").alias("home"))
        n_crucial = crucial.count()
        if n_crucial == 0:
            break
        partner = fold_spread(current, p)
        fits = partner.filter(F.col("n_folds") >= 3) if mode == "Sp" else partner.filter(F.col("n_folds") == 1)
        offers = current.filter(F.col("label") == 0)
        offers = offers.join(spread.filter(F.col("n_folds") >= 3), e, "left_semi").join(fits.select(p), p, "left_semi")
        every = checkpointed(offers.select("fold", "src", "dst"))
        # One replaceable negative per spare entity and round, so that none is drained.
        offers = every.withColumn("_k", order_key(f"{seed}/{rnd}", "src", "dst"))
        offers = offers.groupBy(e).agg(F.min_by(F.struct("fold", "src", "dst", "_k"), "_k").alias("o")).select("o.*")
        offers = checkpointed(ranked(offers, ["fold"], ["_k", "src", "dst"], digest_bucket(F.col("_k")), "r"))
        # A crucial entity asks in a fold other than its home, a different one each round.
        asks = crucial.withColumn("_k", order_key(f"{seed}/{rnd}", "need"))
        asks = asks.withColumn("fold", ((F.col("home") + 1 + (digest_int(F.col("_k"), 10, 7) + rnd) % (n_folds - 1)) % n_folds).cast("int"))
        asks = ranked(asks, ["fold"], ["_k", "need"], digest_bucket(F.col("_k")), "r")
        swap = offers.join(asks.select("fold", "r", "need"), ["fold", "r"]).select("fold", "src", "dst", "need")
        new = {e: F.col("need"), p: F.col(p)}
        made = swap.select("fold", F.col("src").alias("old_src"), F.col("dst").alias("old_dst"), new["src"].alias("src"), new["dst"].alias("dst"))
        made = made.join(known, ["src", "dst"], "left_anti").join(current.select("src", "dst"), ["src", "dst"], "left_anti")
        made = checkpointed(made)
        if made.isEmpty():
            made = checkpointed(_any_offer(every, crucial, current.select("src", "dst").unionByName(known).distinct(), e, p))
            if made.isEmpty():
                break
        gone = made.select("fold", F.col("old_src").alias("src"), F.col("old_dst").alias("dst"), F.lit(0).alias("label"))
        kept = current.join(gone, ["fold", "src", "dst", "label"], "left_anti")
        current = checkpointed(kept.unionByName(made.select("fold", "src", "dst", F.lit(0).alias("label"))))
    left = fold_spread(current, e).filter(F.col("n_folds") == 1).select(e, "fold")
    return current, left


def check_splits(folds: DataFrame) -> DataFrame:
    """Per seed: folds with unseen drugs / targets in test, and the split type they amount to."""
    n = folds.groupBy("seed").agg(F.count_distinct("fold").alias("n_folds"))
    parts = {}
    for side in ("src", "dst"):
        single = folds.groupBy("seed", side).agg(F.count_distinct("fold").alias("_n"), F.min("fold").alias("fold")).filter(F.col("_n") == 1)
        parts[side] = single.groupBy("seed").agg(F.count_distinct("fold").alias(f"{side}_folds"))
    x = n.join(parts["src"], "seed", "left").join(parts["dst"], "seed", "left").na.fill(0)
    s, d, t = F.col("src_folds"), F.col("dst_folds"), F.col("n_folds")
    verdict = F.when((s == 0) & (d == 0), "Sp").when((s == t) & (d == t), "Sd+St").when(s == t, F.when(d == 0, "Sd").otherwise("Sd, St not exact"))
    verdict = verdict.when(d == t, F.when(s == 0, "St").otherwise("St, Sd not exact")).otherwise("not exact")
    return x.select("seed", "n_folds", "src_folds", "dst_folds", verdict.alias("verdict"))


def fold_proportions(folds: DataFrame) -> DataFrame:
    """Positive and negative counts of the test part of each fold, and of the rest."""
    test = folds.groupBy("seed", "fold").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("test_pos"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("test_neg")
    )
    w = W.partitionBy("seed")
    return test.select(
        "seed", "fold", "test_pos", "test_neg",
        (F.sum("test_pos").over(w) - F.col("test_pos")).alias("train_pos"), (F.sum("test_neg").over(w) - F.col("test_neg")).alias("train_neg"),
    )


def cv_distribution(folds: DataFrame, entity: str) -> DataFrame:
    return folds.groupBy("seed", entity, "fold").agg(F.count("*").alias("n"))


def train_val_test(folds: DataFrame, fractions=(0.7, 0.1, 0.2), seed: int = 0) -> DataFrame:
    """Test is fold 0 of ceil(1/test) folds; the rest is divided by a digest threshold."""
    import math

    n = math.ceil(1 / fractions[2])
    x = folds_sp(folds, n, seed)
    share = fractions[1] / (fractions[0] + fractions[1])
    u = digest_int(order_key(f"val{seed}", "src", "dst"), 1, 7) / float(16**7)
    return x.withColumn("part", F.when(F.col("fold") == 0, "test").when(u < share, "val").otherwise("train")).drop("fold")


def kfold(df: DataFrame, k: int, seed: int = 0, stratify: str | None = None, ids=("src", "dst")) -> DataFrame:
    """Fold by md5 rank mod k, within each class if stratified."""
    x = df.withColumn("_k", order_key(seed, *ids))
    groups = [stratify] if stratify else []
    x = ranked(x, groups, ["_k", *ids], digest_bucket(F.col("_k"), 3), "_r")
    return x.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_k", "_r")


def kfold_contiguous(df: DataFrame, k: int, seed: int = 0, ids=("src", "dst")) -> DataFrame:
    """Contiguous slices of floor(n / k) rows in md5 order; the last takes the remainder."""
    x = df.withColumn("_k", order_key(seed, *ids))
    total = df.agg(F.count("*").alias("_n"))
    x = ranked(x, [], ["_k", *ids], digest_bucket(F.col("_k"), 3), "_r").join(F.broadcast(total))
    size = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    fold = F.least(F.floor((F.col("_r") - 1) / size), F.lit(k - 1))
    return x.withColumn("fold", fold.cast("int")).drop("_k", "_r", "_n")


def kfold_entity(df: DataFrame, entity: str, k: int, seed: int = 0) -> DataFrame:
    """All rows of an entity to one fold by md5 rank of the entity (new-drug setting)."""
    ids = df.select(entity).distinct()
    return salted_join(df, kfold(ids, k, seed, ids=(entity,)), [entity])


def oversample(df: DataFrame, label: str = "label", seed: int = 0, ids=("src", "dst")) -> DataFrame:
    """Repeat minority rows, in md5 order, until both classes are equal.

    Row r of the minority (of m rows) appears for every j = r, r + m, … up to the
    majority size.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    size = counts.agg(F.max("_n").alias("_max"))
    x = df.withColumn("_k", order_key(seed, *ids))
    x = ranked(x, [label], ["_k", *ids], digest_bucket(F.col("_k"), 3), "_r")
    # Two classes: the counts are two rows.
    x = x.join(F.broadcast(counts), label).join(F.broadcast(size))
    times = F.floor((F.col("_max") - F.col("_r")) / F.col("_n")) + 1
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_k", "_r", "_n", "_max")


def expand_train(folds: DataFrame, n_folds: int) -> DataFrame:
    """Every row once per fold as test (its own fold) or train, with class names."""
    x = folds.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    part = F.when(F.col("own") == F.col("fold"), "test").otherwise("train")
    kind = F.when(F.col("label") == 1, "pos").otherwise("neg")
    return x.withColumn("part", part).withColumn("kind", kind).drop("own")
