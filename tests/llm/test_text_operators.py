"""Operators against plain versions on odd documents: nulls, empty and long texts, repeats, clashing columns; then empty tables."""

import brute
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, langid, lines, neardup, sharding, suffixes, suffixtree

ITEMS = [(1, "alpha Be gamma dé e x1 the of und le alpha Be gamma dé e"), (2, "Étá zeta, x1"), (10, ""), (11, None), (None, "x1 x1 x1"), (3, "étá ZETA x1")]


@pytest.mark.parametrize("block", [500_000, 3])
def test_contamination(spark, odd, block):
    rows, df = odd
    rows = rows + [(500, ITEMS[0][1] + " e e e"), (501, "Étá zeta; x1 " + "e " * 300)]
    df = df.unionByName(brute.frame(spark, rows[-2:]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.verdicts(decontaminate.contamination(df, items, block=block))
    assert found.columns == [*df.columns, "contamination", "contaminated"]
    c = F.col("contamination")
    got = found.select("doc_id", c["n_words"].alias("a"), c["n_hit"].alias("b"), F.size(c["items"]).alias("c"), F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("d"), "contaminated")
    # Étá with a capital accent is a word of its own: only A-Z are lower-cased.
    assert brute.rows_of(got, *got.columns) == brute.contamination(rows, ITEMS)


def test_decontaminated_documents_and_spans(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    bad = "One two: " + ITEMS[0][1] + ", three"
    df = brute.frame(spark, [(1, bad), (2, "One two"), (3, None)])
    assert brute.rows_of(decontaminate.decontaminate(df, items), "doc_id") == [(2,), (3,)]
    cut = dict(brute.rows_of(decontaminate.decontaminate(df, items, mode="spans"), "doc_id", "text"))
    assert cut == {1: "One two: , three", 2: "One two", 3: None}


@pytest.mark.parametrize("hot", [4096, 0, 1])
def test_substrings(odd, hot):
    rows, df = odd
    got = suffixes.dedup_substrings(df, hot=hot)
    assert brute.rows_of(got.drop("kept"), *got.columns[:-1]) == brute.substrings(rows)
    assert got.filter(F.sha2("kept", 256) != F.col("kept_sha256")).count() == 0


def test_merge_of_front_coded_runs():
    import random

    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(r.choices(b"ab", k=r.randint(0, 6))) for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 6))]
        coded = []
        for run in runs:
            shared, rest, sizes = suffixes.front_coded(run)
            ends = sizes.cumsum().tolist()
            coded.append((shared.tolist(), [rest[a:z] for a, z in zip([0, *ends], ends)]))
        out = list(suffixes.merge(coded))
        assert [x[3] for x in out] == sorted(sum(runs, []))
        assert all(b[2] == suffixes.common(a[3], b[3]) for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("bucket", [neardup.BUCKET, 1])
@pytest.mark.parametrize("radius", [4, 3])
def test_simhash_components(odd, bucket, radius):
    rows, df = odd
    prints = neardup.fingerprints(df)
    want = [(i, brute.simhash(t)) for i, t in rows]
    got = [(r[0], r[1] % (1 << 64), r[2]) for r in neardup.components(prints, radius, bucket).collect()]
    assert sorted(got, key=str) == brute.components(want, radius)


def test_masks_cover_every_pair_within_the_radius():
    from itertools import combinations

    masks = [m % (1 << 64) for m in neardup.masks()]
    assert len(masks) == 31 and all(m.bit_count() == 32 for m in masks)
    for c in combinations(range(0, 64, 3), 4):
        assert any(not m & sum(1 << i for i in c) for m in masks)


def test_line_dedup(spark, odd):
    rows, df = odd
    order = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    got = lines.dedup_lines(df)
    assert got.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_exact", "n_near"]
    want = brute.lines(rows, order.get)
    assert brute.rows_of(got, "doc_id", "text", "n_lines", "n_exact", "n_near") == want
    assert sum(x[4] for x in want) >= 5


def test_line_dedup_of_repeated_words(spark):
    """Lines of the same words and word pairs in another order are no partners and hide none."""
    import random

    draw = random.Random(5)
    rows = [(1, "0 0 0 1 0 0 0 0 0"), (2, "0 0 0 0 0 1 0 0 0"), (3, "0 0 0 0 0 1 0 0 0 0")]
    rows += [(i, " ".join(draw.choices("01", [9, 1], k=draw.randint(8, 13)))) for i in range(4, 40)]
    for some in (rows[:3], rows):
        want = brute.lines(some, lambda t: 0)
        assert brute.rows_of(lines.dedup_lines(brute.frame(spark, some)), "doc_id", "text", "n_lines", "n_exact", "n_near") == want
        assert any(x[0] == 3 and x[4] == 1 for x in want)


def test_suffix_tree(odd):
    rows, df = odd
    want, states = brute.suffix_tree(rows, suffixtree.K)
    assert states[1] and states[2] and states[3] and states[4]
    got = [tuple(r) for r in suffixtree.score(df).collect()]
    assert sorted((x[:5] + (round(x[5], 4), round(x[6], 4)) for x in got), key=str) == want


def test_shards(spark, odd):
    rows, df = odd
    out = sharding.sharded(df).toPandas()
    assert sorted(out["size"]) == sorted(1 + len((t or "").encode()) for _, t in rows)
    assert all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    placed = sharding.shards_by_bytes(sharding.stored(sharding.sized(df)), 8).toPandas()
    assert placed.groupby(placed["_group"].map(bytes)).shard.nunique().max() == 1
    loads = placed.groupby("shard")["size"].sum()
    assert loads.max() <= max(loads.sum() / 8 * 1.02 + 1, placed.groupby(placed["_group"].map(bytes))["size"].sum().max())


def test_best_fit_decreasing_is_the_sequential_rule():
    import random

    r = random.Random(1)
    for _ in range(50):
        sizes = {s: r.randint(1, 5) for s in r.sample(range(1, 60), 12)}
        plan, used = sharding.best_fit_decreasing([(s, n, s * n) for s, n in sizes.items()], 80)
        rooms = []
        for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            fits = [i for i, x in enumerate(rooms) if x >= s]
            if fits:
                rooms[min(fits, key=lambda i: (rooms[i], i))] -= s
            else:
                rooms.append(80 - s)
        loads = {}
        for s, lo, hi, shard in plan:
            loads[shard] = loads.get(shard, 0) + s * (hi - lo)
        assert used == len(rooms) and sorted(80 - x for x in loads.values()) == sorted(rooms)


def test_room_tree_keeps_order_and_balance():
    import random

    r, tree, keys = random.Random(2), sharding.RoomTree(), set()
    for _ in range(3000):
        key = (r.randint(0, 300), r.randint(0, 9))
        if key in keys and r.random() < 0.7:
            keys.remove(key)
            tree.remove(key)
        elif key not in keys:
            keys.add(key)
            tree.add(key)
        room = r.randint(0, 310)
        assert tree.tightest(room) == min((k for k in keys if k[0] >= room), default=None)
    depth = lambda n: 1 + max(depth(n[1]), depth(n[2])) if n else 0
    assert depth(tree.root) <= 2 * (len(keys) + 1).bit_length()


def _parsed(words, word):
    """Phrases of a greedy parse into substrings of the words."""
    known = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    n = at = 0
    while at < len(word):
        k = 1
        while at + k < len(word) and word[at : at + k + 1] in known:
            k += 1
        at, n = at + k, n + 1
    return n


def test_suffix_automaton_parses_like_all_substrings():
    import random

    r = random.Random(1)
    text = lambda a, n: "".join(r.choice(a) for _ in range(r.randint(1, n)))
    for _ in range(200):
        words = [text("abc", 8) for _ in range(r.randint(1, 6))]
        automaton = langid.SuffixAutomaton(words)
        for word in (text("abcd", 12) for _ in range(20)):
            assert automaton.phrases(word) == _parsed(words, word)


def test_language_cases(spark, odd):
    _, df = odd
    models = langid.train(df)
    got = {(r[0], r[1]): r[2:] for r in langid.identify(df, models).select("doc_id", "text", "lang_pred", "score").collect()}
    for (_, text), (name, score) in got.items():
        assert (name == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= score <= 1
    assert {r[0] for r in langid.identify(df, []).select("lang_pred").collect()} == {"und"}
    assert langid.identify(df, models).columns == [*df.columns, "lang_pred", "score"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.train(docs.filter(langid.learned_from(F.col("doc_id"))))
    held = langid.identify(docs, models).filter(~langid.learned_from(F.col("doc_id")))
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.97


def test_held_out_scores_beat_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, model = suffixtree.score(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_empty_tables(spark, odd, none):
    _, df = odd
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(df, items.limit(0)).count() == df.count()
    assert suffixes.dedup_substrings(none).count() == 0
    assert neardup.components(neardup.fingerprints(none)).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert suffixtree.score(none).count() == 0
    assert sharding.sharded(none).count() == 0
    assert langid.train(none) == [] and langid.identify(none, []).count() == 0


def _joins(df):
    """Broadcast joins of the plan as Spark has it before any of it ran."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


def test_exploded_rows_are_not_broadcast(spark, odd, monkeypatch):
    """Masks, flips, halves and variants are many times the rows that Spark sizes them by."""
    seen = []

    def watched(df):
        seen.append((df.columns, _joins(df)))
        return kept(df)

    kept = neardup.stored
    monkeypatch.setattr(neardup, "stored", watched)
    fps = neardup.fingerprints(odd[1]).select("fp").distinct()
    assert _joins(neardup.links(fps, bucket=2)) == [] and [j for _, j in seen] == [[]]
    monkeypatch.setattr(lines, "stored", watched)
    seen.clear()
    assert _joins(lines.dedup_lines(odd[1])) == []
    assert dict((tuple(c), j) for c, j in seen)["at", "w", "n"] == []
