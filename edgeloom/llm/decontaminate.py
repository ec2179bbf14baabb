"""Benchmark decontamination: a broadcast hash set of the test n-grams, one scan of the training texts.

Words are maximal runs of digits, a-z (A-Z lower-cased) and bytes from 0x80 on. A test window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. The windows are
normalised, hashed and broadcast in blocks of at most ``BLOCK`` windows (their number is counted first),
and every block scans all texts. A hash hit counts only after the words themselves were compared.

Cases: null or empty texts have no words; an item without words has no window; equal windows of several
items name them all; a null item id makes hits but is not listed; repeated rows are judged one by one;
long texts are read whole; other columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, mix, slices, spans_to_list, text_bytes

BLOCK = 500_000  # windows of one broadcast: about 100 MB
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_STEP = np.uint64(0x100000001B3)
_FOLD = np.uint64(0xC6A4A7935BD1E995)
_BITS = 22


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(body: np.ndarray, at: np.ndarray):
    """Lower-cased bytes, start and end of every word, and the first word of each text."""
    low = LOWER[body]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _IS_WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return low, starts, ends, np.searchsorted(starts, at)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    place = spans_to_list(starts, sizes)
    first = np.cumsum(sizes) - sizes
    power = _powers(_STEP, int(sizes.max()))
    value = (low[place].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(place)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (only where n words follow)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = _powers(_FOLD, n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * power[j]
    return mix(out)


def benchmark_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(gram, n_gram, items): distinct windows as words joined by a space, with the names of their items."""
    low = F.translate(F.col(text), UPPER, LOWERED)
    words = items.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w"))
    words = words.filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - n + 1, F.lit(1))
    grams = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Grams:
    """A block of windows as sorted hashes with a bitmap in front."""

    def __init__(self, rows):
        self.by_size = {}
        sized = {}
        for gram, items in rows:
            sized.setdefault(gram.count(" ") + 1, []).append((gram.encode(), items))
        for n, block in sized.items():
            body, at = text_bytes(pa.array([g for g, _ in block], pa.large_binary()))
            low, starts, ends, first = words_of(body, at)
            keys = window_hashes(word_hashes(low, starts, ends), n)[first[:-1]]
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[keys >> np.uint64(64 - _BITS)] = True
            self.by_size[n] = (keys[order], seen, [block[i] for i in order])

    def hits(self, h, first, low, starts, ends):
        """(first word, number of words, items) of every verified window inside one text."""
        for n, (keys, seen, block) in self.by_size.items():
            w = window_hashes(h, n)
            at = np.flatnonzero(seen[w >> np.uint64(64 - _BITS)])
            lo = np.searchsorted(keys, w[at])
            same = lo < len(keys)
            same[same] = keys[lo[same]] == w[at[same]]
            at, lo = at[same], lo[same]
            text = np.searchsorted(first, at, "right") - 1
            whole = first[np.minimum(text + 1, len(first) - 1)] >= at + n
            for i, k, t in zip(at[whole].tolist(), lo[whole].tolist(), text[whole].tolist()):
                words = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
                while k < len(keys) and keys[k] == w[i]:
                    if block[k][0] == words:
                        yield t, i - int(first[t]), n, block[k][1]
                    k += 1


def _merged(spans):
    """Union of [start, end) word ranges."""
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _scan(text: str, into: str, held):
    def run(batches):
        grams = held.value
        for b in slices(batches, text):
            body, at = text_bytes(b.column(text))
            low, starts, ends, first = words_of(body, at)
            found: dict[int, tuple[list, set]] = {}
            for t, i, n, items in grams.hits(word_hashes(low, starts, ends), first, low, starts, ends):
                spans, names = found.setdefault(t, ([], set()))
                spans.append((i, i + n))
                names.update(x for x in items if x is not None)
            before = b.column(into).to_pylist() if into in b.schema.names else [None] * b.num_rows
            out = []
            for t, (count, old) in enumerate(zip(np.diff(first).tolist(), before)):
                spans, names = found.get(t, ((), ()))
                if old:
                    spans, names = [*spans, *map(tuple, old["spans"])], {*names, *old["items"]}
                spans = _merged(spans)
                out.append({"n_words": count, "n_hit": sum(e - s for s, e in spans), "spans": spans, "items": sorted(names)})
            columns = {c: b.column(c) for c in b.schema.names if c != into} | {into: pa.array(out, _ARROW)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, into: str = "contamination", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with a struct: n_words, n_hit (words inside any window), spans of hit words, items (sorted as strings)."""
    spark = docs.sparkSession
    out = docs.drop(into)
    schema = T.StructType([*out.schema.fields, T.StructField(into, RESULT)])
    windows = benchmark_windows(items, item, item_text, n)
    parts = max(1, -(-windows.count() // block))
    for part in range(parts):
        rows = windows.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(Grams([tuple(r) for r in rows.collect()]))
        out = out.mapInArrow(_scan(text, into, held), schema)
    return out


def verdicts(found: DataFrame, into: str = "contamination", share: int = 20, flag: str = "contaminated") -> DataFrame:
    """Adds the ``flag``: some word is hit, and at least one word in ``share``."""
    c = F.col(into)
    return found.withColumn(flag, (c["n_hit"] > 0) & (c["n_hit"] * share >= c["n_words"]))


def cut_spans(texts, spans):
    """Texts without their hit words, what stands between the words of one span included."""
    out = []
    for text, cut in zip(texts, spans):
        raw = (text or "").encode()
        _, starts, ends, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        kept, at = [], 0
        for s, e in () if cut is None else cut:
            kept.append(raw[at : starts[s]])
            at = int(ends[e - 1])
        out.append(None if text is None else b"".join([*kept, raw[at:]]).decode())
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", mode: str = "documents", **options) -> DataFrame:
    """Documents without the contaminated ones, or (``mode="spans"``) with the hit words cut out of every text."""
    longest = max(map(len, docs.columns), default=0)  # names longer than any column's are free
    into, flag = "c".ljust(longest + 1, "_"), "f".ljust(longest + 1, "_")
    found = verdicts(contamination(docs, items, text=text, into=into, **options), into, flag=flag)
    if mode == "documents":
        return found.filter(~F.col(flag)).select(docs.columns)
    cut = F.pandas_udf(lambda t, s: pd.Series(cut_spans(t, s)), T.StringType())
    return found.withColumn(text, cut(F.col(text), F.col(into)["spans"])).select(docs.columns)


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
