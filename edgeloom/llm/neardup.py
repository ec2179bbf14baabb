"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is cut by 2^(r+1) - 1 structured masks: bit i belongs to mask v if v and i mod 2^(r+1)
share an odd number of set bits. Any r differing bits leave some mask untouched (r vectors do not span r + 1
dimensions), so two fingerprints within the radius are equal under at least one mask: no pair is missed.

Only distinct fingerprints are compared. Fingerprints equal under a mask form a bucket; a bucket yields the
links of a spanning forest of its close fingerprints, not its pairs. Buckets beyond ``BUCKET`` fingerprints
are linked over shared points: two fingerprints within 2 s bits have a common point within s bits of both, so
every fingerprint emits those points and meets the smallest that has the same.

Cases: null and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a
shingle are one shingle; a repeated row repeats its result; a null doc_id gets its group's smallest id (null
if there is none); long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import LOWER_BYTES, slices, stored

RADIUS, SHINGLE, SEED = 4, 4, 42
BUCKET = 16_384  # fingerprints compared in one task at once


def simhash(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text: a bit is set if it is set in over half the hashes of the word shingles."""
    words = raw.translate(LOWER_BYTES).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(len(words) - shingle, 0)]]
    digest = xxhash.xxh64_digest
    hashes = b"".join(digest(body[a : z - 1], seed) for a, z in zip(starts, ends[min(shingle, len(words)) - 1 :]))
    ones = np.zeros(64, np.int64)
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), 1 << 16):
        ones += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches, "_text"):
            fp = [simhash((t or b""), shingle, seed) for t in b.column("_text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The structured masks, as signed 64-bit numbers."""
    out = [sum(1 << i for i in range(64) if (v & (i % (1 << (radius + 1)))).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints within the radius as all their pairs would."""
    links, waiting = [], fps
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= radius
            links += [(int(at), int(x)) for x in waiting[near]]
            front += list(waiting[near])
            waiting = waiting[~near]
    return links


def _bucket_links(radius: int):
    """Links inside the buckets of a partition sorted by (mask, part)."""

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            mask, part = rest["mask"].to_numpy(), rest["part"].to_numpy()
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            if len(new):
                yield from out(rest["fp"].to_numpy(), [0, *new.tolist()])
                rest = rest.slice(int(new[-1]))
        if rest is not None:
            yield from out(rest["fp"].to_numpy(), [0, rest.num_rows])

    def out(fp, cuts):
        links = [x for a, z in zip(cuts, cuts[1:]) for x in forest(fp[a:z].view(np.uint64), radius)]
        if links:
            both = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) links among distinct fingerprints (column ``fp``) with the same components as all pairs within the radius."""
    parts = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks(radius)])).alias("mask", "_m"))
    parts = parts.select("mask", F.col("fp").bitwiseAND(F.col("_m")).alias("part"), "fp", "_m")
    shared = parts.groupBy("mask", "part").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    # Spark sizes exploded rows like those they were made of: without the hints it would broadcast what is many times larger.
    met = stored(parts.join(shared.hint("merge"), ["mask", "part"]))
    small = met.filter(F.col("_n") <= bucket).select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part")
    found = small.mapInArrow(_bucket_links(radius), "src long, dst long")
    # One of two close fingerprints has their common point within half the radius, the other within the rest of it.
    # They differ only in bits outside the mask.
    flips = [sum(1 << i for i in c) for s in range((radius + 1) // 2 + 1) for c in combinations(range(64), s)]
    flips = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips])
    large = met.filter(F.col("_n") > bucket)
    points = large.select("fp", "mask", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("_m")) == 0)).alias("_flip"))
    points = points.select("fp", "mask", F.col("fp").bitwiseXOR(F.col("_flip")).alias("point"), (F.bit_count("_flip") <= radius // 2).alias("_near"))
    least = points.filter("_near").groupBy("mask", "point").agg(F.min("fp").alias("dst"))
    starred = points.join(least.hint("merge"), ["mask", "point"]).filter(F.col("fp") != F.col("dst"))
    return found.unionByName(starred.select(F.col("fp").alias("src"), "dst")).distinct()


def components(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest doc_id linked over any number of steps."""
    prints = stored(prints)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    edges = stored(links(distinct.select("fp"), radius, bucket))
    linked = connected_components(edges).select(F.col("id").alias("fp"), F.col("component").alias("_root"))
    rooted = stored(distinct.join(linked, "fp", "left").withColumn("_root", F.coalesce("_root", "fp")))
    # Stored, so that the join reads two plain tables: a root with very many fingerprints is then dealt to several tasks.
    least = stored(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    names = stored(rooted.select("fp", "_root").join(least, "_root").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without those that have a near-duplicate of a smaller id in their group; rows without an id stay.

    Rows of one id with different texts are judged each by its own fingerprint, which is computed again for the ids that lose a row.
    """
    found = components(fingerprints(docs, key, text))
    free = "_" * (max(map(len, docs.columns), default=0) + 1)  # no column of the documents begins like this
    gone_id, gone_fp, own = free + "id", free + "fp", free + "own"
    gone = stored(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_id), F.col("fp").alias(gone_fp)).distinct())
    marked = docs.join(stored(gone.select(gone_id).distinct()), F.col(key) == F.col(gone_id), "left")

    def run(batches):
        for b in slices(batches, text):
            fp = [simhash(t or b"") for t in b.column(text).cast(pa.large_binary()).to_pylist()]
            yield b.append_column(own, pa.array(np.array(fp, np.uint64).view(np.int64)))

    suspects = marked.filter(F.col(gone_id).isNotNull()).select(docs.columns).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    kept = suspects.join(gone, (F.col(key) == F.col(gone_id)) & (F.col(own) == F.col(gone_fp)), "left_anti").select(docs.columns)
    return marked.filter(F.col(gone_id).isNull()).select(docs.columns).unionByName(kept)
