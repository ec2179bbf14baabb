"""Line deduplication over all documents by a deletion-neighbourhood join, native DataFrame functions only.

A line is its words; lines without a word are never removed. Of equal lines the earliest stays (smallest
doc_id, then hash of the text, then place). A line of at least ``WORDS`` words also goes if an earlier
line is within one word edit (one word put in, left out or replaced), whether or not that one stays.

Distinct lines that share no half with another cannot be within one edit and drop out first. Every other line
emits its variants as hashed keys: the line, the line without each word, and the line with a gap at each word.
Hashes of the variants come from sums over the words with their places, modulo 2^61 - 1, so variants with equal
keys are equal but for chance, and a line's variants cost little more than the line. Lines meet at equal keys,
where only the earliest matters: a gap or a whole line is compared with the earliest of its key, so no pairs of
a group are made. The word edit distance of every such candidate is then verified.

Cases: null texts stay null; empty texts and blank lines stay; long lines and texts are read whole; ties are
settled by the hash of the text, rows equal in id and text are one document and lose the same lines; a null
doc_id comes first; an empty table gives no rows; other columns pass through, those named like the three
counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS = 8
SPACE = r"[\x20\x09-\x0D]+"
_MOD = (1 << 61) - 1
COUNTS = ("n_lines", "n_exact", "n_near")


def words_of(line: Column) -> Column:
    """Words between blanks; other white space is rare and replaced before, as a single blank splits fastest."""
    plain = F.when(line.rlike(r"[\t\x0B\f\r\n]"), F.regexp_replace(line, SPACE, " ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def _hash(*parts) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts]), F.lit(_MOD))


def half_keys(w: Column, n: Column) -> Column:
    """Hashes of the first and of the last half; two lines within one edit share one of them."""
    halves = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(halves, lambda h: F.array(
        F.xxhash64(F.lit("head"), h, F.slice(w, 1, h)), F.xxhash64(F.lit("tail"), h, F.slice(w, n - h + 1, h)))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.pmod(a + x, F.lit(_MOD)))


def placed(w: Column) -> Column:
    """Hash of each word with its place."""
    return F.transform(w, lambda x, i: _hash(x, i))


def moves(w: Column, n: Column, at: Column) -> Column:
    """For each place, what the sum of ``placed`` loses when the words up to there move one place ahead, modulo ``_MOD``.

    A running sum by doubling: each round adds the value a power of two before, n log n steps for a line of any length."""
    lost = F.zip_with(at, F.transform(w, lambda x, i: _hash(x, i - 1)), lambda a, b: F.pmod(a - b, F.lit(_MOD)))
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < n)
    return F.aggregate(powers, lost, lambda s, k: F.transform(s, lambda x, i: F.when(i < k, x).otherwise(F.pmod(x + F.get(s, i - k), F.lit(_MOD)))))


def gap_keys(at: Column, n: Column, total: Column) -> Column:
    """Keys of the line with a gap at each word; ``total``: sum of ``at``, the words' hashes with their places."""
    return F.transform(at, lambda x, i: F.xxhash64(F.lit("gap"), n, i, F.pmod(total - x, F.lit(_MOD))))


def without_keys(at: Column, n: Column, total: Column, moved: Column) -> Column:
    """Keys of the line without each word, equal to the ``whole_key`` of that line, as later words move one place ahead; ``moved``: its ``moves``."""
    rest = F.pmod(total - F.get(moved, n - 1), F.lit(_MOD))
    key = lambda x, s, r: F.xxhash64(F.lit("whole"), n - 1, F.pmod(r + s - x, F.lit(_MOD)))
    return F.flatten(F.transform(F.array(rest), lambda r: F.zip_with(at, moved, lambda x, s: key(x, s, r))))


def whole_key(n: Column, total: Column) -> Column:
    return F.xxhash64(F.lit("whole"), n, total)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by one word put in, left out or replaced, at most."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    other = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.coalesce(F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)), F.lit(0)).cast("int")
    rest = F.size(short) - first + 1
    shifted = (first == 0) | (rest == 0) | (F.slice(long, first + 1, F.greatest(rest, F.lit(0))) == F.slice(short, first, F.greatest(rest, F.lit(0))))
    same = F.size(F.filter(other, lambda x: x)) <= 1
    return F.when(F.size(a) == F.size(b), same).when(F.size(long) == F.size(short) + 1, shifted).otherwise(F.lit(False))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows with the lines that stay, and n_lines, n_exact, n_near: lines before, removed as equal, removed as near."""
    docs = docs.drop(*COUNTS)
    rows = docs.select(F.col(key).alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(text, "\n")).alias("_p", "line"))
    w, n = F.col("w"), F.col("n")
    rows = rows.select("_d", "_t", "_p", words_of(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    rows = stored(rows.select(
        F.struct("_d", "_t", "_p").alias("at"), "n", F.when(n > 0, F.xxhash64(w)).alias("h1"), F.when(n > 0, F.xxhash64(F.lit(1), w)).alias("h2"),
        F.when(n >= words, half_keys(w, n)).alias("halves")))
    distinct = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("halves").alias("halves"))
    distinct = stored(distinct)

    # Lines that share a half with another one, with their words fetched from their first place.
    halves = distinct.select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    # Spark sizes exploded and listed rows by what they were made of, or by their packed files: the hints keep them from being broadcast.
    met = halves.join(shared.hint("merge"), "half").select("first").distinct()
    wanted = met.groupBy(F.col("first._d").alias("_d"), F.col("first._t").alias("_t")).agg(F.collect_set("first._p").alias("places"))
    own = docs.select(F.col(key).alias("_d0"), F.xxhash64(text).alias("_t0"), F.split(text, "\n").alias("lines"))  # read again: cheaper than to keep all lines
    found = own.join(wanted.hint("merge"), F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_t0") == F.col("_t")))
    found = found.select("_d", "_t", F.explode("places").alias("_p"), "lines").select(F.struct("_d", "_t", "_p").alias("at"), words_of(F.get("lines", F.col("_p"))).alias("w"))
    near = stored(found.withColumn("n", F.size("w")))

    # Variants; only the earliest of each key is a candidate.
    summed = near.select("at", "w", "n", placed(w).alias("placed"))
    put, total = F.col("placed"), F.col("total")
    summed = summed.select("at", "n", "placed", _sum(put).alias("total"), moves(w, n, put).alias("moved"))
    variant = lambda role, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.lit(role).alias("role")))
    variants = F.concat(variant(0, gap_keys(put, n, total)), variant(1, without_keys(put, n, total, F.col("moved"))), variant(2, F.array(whole_key(n, total))))
    variants = summed.select("at", F.explode(variants).alias("v")).select("at", "v.key", "v.role")
    variants = stored(variants)
    at = F.col("at")
    earliest = variants.groupBy("key").agg(F.min(F.when(F.col("role") != 1, at)).alias("whole"), F.min(F.when(F.col("role") == 1, at)).alias("cut"), F.count("*").alias("c")).filter("c > 1").drop("c")
    pairs = variants.join(earliest.hint("merge"), "key").select("at", F.when(F.col("role") == 2, F.col("cut")).otherwise(F.col("whole")).alias("other"))
    pairs = pairs.filter(F.col("other") < at).distinct()
    verified = pairs.join(near.select("at", "w"), "at").join(near.select(F.col("at").alias("other"), F.col("w").alias("v")), "other").filter(one_edit(w, F.col("v")))
    gone = verified.select(F.col("at").alias("first"), F.lit(True).alias("near")).distinct()

    # What became of every line, per document, then the texts.
    fate = distinct.select("h1", "h2", "first").join(gone, "first", "left")
    fate = rows.select("at", "h1", "h2").join(fate, ["h1", "h2"], "left")
    fate = fate.select("at", F.when(F.col("first").isNull(), 0).when(F.col("first") != at, 1).when(F.col("near"), 2).otherwise(0).alias("fate"))
    # Names that no table has: the columns of the documents stand beside them.
    doc, digest, kinds = "__line_doc", "__line_digest", "__line_kinds"
    fate = fate.groupBy(F.col("at._d").alias(doc), F.col("at._t").alias(digest)).agg(F.transform(F.array_sort(F.collect_set(F.struct("at._p", "fate"))), lambda x: x["fate"]).alias(kinds))
    fate = stored(fate)
    out = docs.join(fate.hint("merge"), F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(digest)), "left")
    kept = F.filter(F.zip_with(F.split(text, "\n"), kinds, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda x: x["f"] == 0)
    some = F.exists(kinds, lambda f: f > 0)
    counted = lambda kind: F.coalesce(F.size(F.filter(kinds, lambda f: f == kind)), F.lit(0)).cast("long")
    counts = [F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias(COUNTS[0]), counted(1).alias(COUNTS[1]), counted(2).alias(COUNTS[2])]
    return out.select(*[F.when(some, F.array_join(F.transform(kept, lambda x: x["x"]), "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns], *counts)
