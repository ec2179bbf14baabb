"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens (best-two-fit).

A document is its token ids and one end id. Documents longer than a sequence are cut into whole sequences,
the first piece may be shorter. Pieces are packed by their lengths: a bin is filled greedily with the longest
pieces that fit, then its shortest piece gives way to two unpacked ones that fill the larger gap more tightly.
Only the number of pieces of each length decides, so the driver packs a histogram of at most ``size`` counts:
a filling found once is used as often as the counts allow. Pieces are numbered within their length in Spark
and look up the bin and place of their number.

Cases: null and empty texts are one end token; repeated rows and ids are packed as rows of their own; long
texts are cut, never shortened; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import ranked
from .common import slices, stored

SIZE, END = 2048, 0
BUCKET_ROWS = 200_000
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])
_ENCODERS: dict = {}


def encoder(path: str):
    """Byte-level BPE of a ``tokenizers`` file; ids equal those of that library, also for its added tokens inside a text."""
    if path not in _ENCODERS:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers.pre_tokenizers import ByteLevel

        model = json.load(open(path))
        # Visible character of every byte, as byte-level vocabularies write them.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        assert set(of) == set(ByteLevel.alphabet())
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        # Found in the text as it stands: neither normalised nor joined with blanks or bounded by words.
        assert not any(t[k] for t in model["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))
        ranks = {bytes(of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document, in order."""

    def run(batches):
        encode = partial(encoder(vocabulary).encode, allowed_special="all")
        for b in slices(batches, "_text", 2 << 20):
            rows: dict[str, list] = {f.name: [] for f in schema.fields}
            for doc, body in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist()):
                tokens = np.array([*encode(body or ""), end], "<u4")
                first = len(tokens) % size or size
                cuts = [0, *range(first, len(tokens) + 1, size)]
                for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for c, v in zip(rows, (doc, n, a, z - a, zlib.crc32(tokens[a:z].tobytes()), tokens[a:z].astype(np.int32))):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []))
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else []))
    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Fillings ({length: pieces}, number of bins so filled) that use every piece once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(size + 1)
    out = []
    while left.any():
        bin_, rest, gap = {}, left.copy(), size
        while gap > 0:
            fits = np.flatnonzero(rest[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            bin_[length] = bin_.get(length, 0) + 1
            rest[length] -= 1
            gap -= length
        least = min(bin_)
        if gap and sum(bin_.values()) > 1:
            room = gap + least
            largest = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
            a = np.flatnonzero(rest[: room + 1])
            b = largest[room - a]
            b = np.where((b == a) & (rest[a] < 2), largest[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > least:
                k = int(total.argmax())
                bin_[least] -= 1
                for length in (int(a[k]), int(b[k])):
                    bin_[length] = bin_.get(length, 0) + 1
                bin_ = {length: n for length, n in bin_.items() if n}
        times = min(int(left[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            left[length] -= n * times
        out.append((bin_, times))
    return out


def places(fillings) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, per bin, first bin, first offset): where numbers lo … hi - 1 of a length go."""
    used: dict[int, int] = {}
    out, bin_no = [], 0
    for filling, times in fillings:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            lo = used.get(length, 0)
            out.append((length, lo, lo + n * times, n, bin_no, offset))
            used[length] = lo + n * times
            offset += length * n
        bin_no += times
    return out


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length`` from 1 to ``size``. ``pieces`` is read three times: give it stored."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = places(best_two_fit(counts, size))
    plan = spark.createDataFrame(plan, "_length long, _lo long, _hi long, _per long, _bin long, _at long")
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    numbered = ranked(pieces, ["length"], order, F.pmod(F.xxhash64(*order), F.lit(buckets)), "_rank").withColumn("_rank", F.col("_rank") - 1)
    r, at = F.col("_rank"), F.col("_rank") - F.col("_lo")
    # The plan has a few rows for each of the ``size`` lengths, however many pieces there are.
    found = numbered.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (r >= F.col("_lo")) & (r < F.col("_hi")))
    return found.select(*pieces.columns, (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_at") + F.pmod(at, F.col("_per")) * F.col("length")).alias("offset"))


def packed(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(stored(token_pieces(docs, vocabulary, key, text, size, end, ids)), size)
