"""URL rules through Bloom filter cascades, native DataFrame functions only.

A listed key is a host and the beginning of a path (``example.org/es/``); it fits its host and all subdomains
and every path that begins so. The keys a url can meet are few: one for each pair (labels of the host, length
of the path) that occurs in a list. All keys of the corpus are the universe of the cascade: its first filter
holds the listed keys, the next the unlisted keys of the universe that the first lets through, the next the
listed keys that pass again, and so on until nothing passes. The number of filters passed, odd or even, is
then exact membership for every key of the corpus: pages and lists are never joined.

A filter is one row: an array of 64-bit words with ``BITS`` bits a key, read as a scalar subquery. Lists are
split by the hash of the key so that no filter holds more than ``SEGMENT`` keys; each segment's filters are
tested on the keys of its segment alone.

Cases: a null url or one without ``://`` has empty host and path, meets no rule and is allowed; ports and user
names belong to the host as written; of rules of equal length a block wins; repeated rows and urls are judged
alike; an empty table gives no rows, an empty list allows all; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

BITS, HASHES = 16, 6
SEGMENT = 1_000_000  # keys of one filter: 2 MB


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The keys a url can meet, one column for each shape (null if the url is too short): last labels of the host, first characters of the path."""
    labels = F.split(host, r"\.")
    return [
        F.when((F.size(labels) >= n) & (F.length(path) >= m) & (host != ""), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, m)))
        for n, m in shapes
    ]


def _bits(key: Column, level: int, words: Column) -> list[Column]:
    """Places of a key in the filter of a level, as bit numbers."""
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), words * 64) for i in range(HASHES)]


def _filter(keys: DataFrame, level: int, count: int) -> DataFrame:
    """One row, one column: the words of a Bloom filter of the keys."""
    words = F.lit(max(1, -(-count * BITS // 64))).cast("long")
    places = keys.select(F.explode(F.array(*_bits(F.col("key"), level, words))).alias("b"))
    used = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x"))
    filled = used.agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    return filled.select(F.transform(F.sequence(F.lit(0).cast("long"), words - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _passes(key: Column, level: int, words: Column) -> Column:
    tests = [F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in _bits(key, level, F.size(words).cast("long"))]
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership in a list for all keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame, segment: int = SEGMENT):
        self.count = listed.count()
        self.segments = max(1, -(-self.count // segment))
        self.levels: list[list[DataFrame]] = [self._build(listed, universe, s) for s in range(self.segments)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.segments))

    def _build(self, listed, universe, s):
        ours = lambda df: df.filter(self._part(F.col("key")) == s) if self.segments > 1 else df
        holds, count, levels = ours(listed), self.count, []
        others = None
        while count:
            level = len(levels)
            levels.append(stored(_filter(holds, level, count)))
            passes = _passes(F.col("key"), level, levels[-1].scalar())
            # What the new filter lets through of the other side is what the next filter must hold.
            if others is None:  # of the universe only what passes the first filter is compared with the list
                let = ours(universe).filter(passes).join(holds, "key", "left_anti")
            else:
                let = others.filter(passes)
            holds, others = stored(let), holds
            count = holds.count()
        return levels

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the filters it passes in a row are odd in number."""
        answer = F.lit(False)
        for s, levels in enumerate(self.levels):
            inside = F.lit(len(levels) % 2 == 1)
            for level in reversed(range(len(levels))):
                inside = F.when(_passes(key, level, levels[level].scalar()), inside).otherwise(F.lit(level % 2 == 1))
            answer = F.when(self._part(key) == s, inside).otherwise(answer) if self.segments > 1 else inside
        return answer


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, verdict, labels, length) of (verdict, host, path) rules."""
    rows = spark.createDataFrame(rules or [], "verdict string, host string, path string")
    return rows.select(F.concat("host", "path").alias("key"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct()


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest listed key that fits, and what the lists say of it."""
    shapes = sorted((r[0], r[1]) for r in rules.select("labels", "length").distinct().collect())
    host, path = host_path(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = keys_of(F.col("host"), F.col("path"), shapes)
    if not keys:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = stored(parts.select(F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL").distinct())
    cascades = {v: Cascade(rules.filter(F.col("verdict") == v).select("key").distinct(), universe) for v in ("block", "allow")}
    said = [F.when(cascades["block"].holds(k), F.lit("block")).when(cascades["allow"].holds(k), F.lit("allow")) for k in keys]
    # The greatest of (length, key, verdict) among the keys that are listed.
    best = F.array_max(F.array(*[F.when(v.isNotNull(), F.struct(F.length(k).alias("size"), k.alias("rule"), v.alias("verdict"))) for k, v in zip(keys, said)]))
    return parts.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
