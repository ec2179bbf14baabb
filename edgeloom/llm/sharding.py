"""Sharding by best-fit-decreasing bin packing: groups stay whole, the tightest shard that has room takes them.

Groups (equal texts) are sized in Spark. The packing sees counts and bytes of size classes: a class is a size
below 8192 or a size rounded down to 13 significant bits, so there are at most 2^18 classes at any scale.
Classes enter in decreasing order; groups of one class all go to the shard with the least remaining room that
fits, until it does not, found in a balanced search tree. Groups are numbered within their class in Spark and
look up the shard of their number.

Cases: a null text is a group of its own with no bytes; equal texts share a shard, however many they are;
repeated rows keep a slot each; a group above the capacity gets a shard to itself; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import ranked
from .common import stored

BUCKET_ROWS = 100_000
_EXACT = 13  # significant bits of a size class


class RoomTree:
    """Shards ordered by remaining room in an AA tree (balanced by skews and splits)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, left, right, level]

    def add(self, key):
        self.root = self._add(self.root, key)

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._split(self._skew(node))

    @staticmethod
    def _skew(node):
        left = node[1]
        if left and left[3] == node[3]:
            node[1], left[2] = left[2], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[2]
        if right and right[2] and right[2][3] == node[3]:
            node[2], right[1] = right[1], node
            right[3] += 1
            return right
        return node

    def tightest(self, room):
        """The smallest (room, shard) with at least this room, or None."""
        node, best = self.root, None
        while node:
            if node[0][0] >= room:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    def remove(self, key):
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if node is None:
            return None
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        elif node[1] is None and node[2] is None:
            return None
        elif node[1] is None:
            low = node[2]
            while low[1]:
                low = low[1]
            node[0], node[2] = low[0], self._remove(node[2], low[0])
        else:
            high = node[1]
            while high[2]:
                high = high[2]
            node[0], node[1] = high[0], self._remove(node[1], high[0])
        level = 1 + min(node[1][3] if node[1] else 0, node[2][3] if node[2] else 0)
        if level < node[3]:
            node[3] = level
            if node[2] and level < node[2][3]:
                node[2][3] = level
        node = self._skew(node)
        if node[2]:
            node[2] = self._skew(node[2])
            if node[2][2]:
                node[2][2] = self._skew(node[2][2])
        node = self._split(node)
        if node[2]:
            node[2] = self._split(node[2])
        return node


def best_fit_decreasing(classes, capacity: float):
    """Pack [(class, groups, bytes)]: rows (class, lo, hi, shard) and the number of shards."""
    tree, out, shards = RoomTree(), [], 0
    for name, count, size in sorted(classes, reverse=True):
        each, at = size / count, 0
        while at < count:
            found = tree.tightest(each)
            if found is None:
                room, shard = max(capacity, each), shards
                shards += 1
            else:
                room, shard = found
                tree.remove(found)
            fit = min(count - at, max(1, int(room / each)))
            out.append((name, at, at + fit, shard))
            at += fit
            tree.add((max(0.0, room - fit * each), shard))
    return out, shards


def least_capacity(classes, shards: int):
    """The plan of the smallest capacity, found by bisection, that needs at most so many shards."""
    total, largest = sum(c[2] for c in classes), max((c[2] / c[1] for c in classes), default=0)
    low = max(total / shards, largest)
    high, best = low + largest, None
    best, _ = best_fit_decreasing(classes, high + 1)
    for _ in range(24):
        middle = (low + high) / 2
        plan, used = best_fit_decreasing(classes, middle)
        if used <= shards:
            best, high = plan, middle
        else:
            low = middle
        if high - low < 1:
            break
    return best


def size_class(size: Column) -> Column:
    """The size itself, or its leading bits followed by zeros."""
    drop = F.greatest(F.length(F.bin(size)) - _EXACT, F.lit(0))
    return F.floor(size / F.pow(F.lit(2.0), drop)) * F.pow(F.lit(2.0), drop).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _group): bytes and one more, and a digest that equal texts share."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"null")).alias("_group"),
    )


def shards_by_bytes(rows: DataFrame, shards: int, group: str = "_group", size: str = "size") -> DataFrame:
    """Adds ``shard`` (0 … shards - 1): groups whole, bytes near equal. ``rows`` is read twice: give it stored."""
    spark = rows.sparkSession
    groups = rows.groupBy(group).agg(F.sum(size).alias("_bytes")).withColumn("_class", size_class(F.col("_bytes")))
    groups = stored(groups)
    classes = [tuple(r) for r in groups.groupBy("_class").agg(F.count("*"), F.sum("_bytes")).collect()]
    plan = least_capacity(classes, shards) if classes else []
    plan = spark.createDataFrame(plan, "_name long, _lo long, _hi long, shard int")
    buckets = max(64, sum(c[1] for c in classes) // BUCKET_ROWS)
    numbered = ranked(groups, ["_class"], [group], F.pmod(F.xxhash64(group), F.lit(buckets)), "_rank")
    r = F.col("_rank") - 1
    # At most 2^18 classes, each cut once per shard at most where it is split.
    placed = numbered.join(F.broadcast(plan), (F.col("_class") == F.col("_name")) & (r >= F.col("_lo")) & (r < F.col("_hi"))).select(group, "shard")
    return rows.join(placed, group)


def slots(rows: DataFrame, count: int, order: list[str]) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within every shard, numbered in many buckets at once."""
    buckets = max(64, count // BUCKET_ROWS)
    out = ranked(rows, ["shard"], order, F.pmod(F.xxhash64(*order), F.lit(buckets)), "slot")
    return out.withColumn("slot", F.col("slot") - 1)


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    rows = stored(sized(docs, key, text))
    placed = stored(shards_by_bytes(rows, shards).drop("_group"))
    out = slots(placed, placed.count(), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
