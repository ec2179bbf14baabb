"""Alignment of the tokens of two tokenizers over the bytes of a text, with corpus-wide counts of linked ids.

A text's tokens are lists of an Arrow batch: they are flattened with their parents' numbers, their byte lengths summed
up within each document, and Acero joins the two sides on (document, end). Every match cuts a group and links an
A token with a B token. ``Table.group_by`` counts the links of an id pair in a run (a slice of a batch), so that only
a run's distinct pairs leave it; Spark adds them up, finds the highest count of each B id and sends every run the
counts of its own pairs. A frequent pair is one row of a run, however often it occurs.

Cases: null and empty texts, and texts whose bytes a tokenizer does not give back, have no tokens; strings of special
tokens are plain text; repeated rows and ids are documents of their own; long texts are read whole (a text longer than
a run's bytes is a run of its own); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

RUN_BYTES = 2 << 20
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
_SIDES: dict = {}


def visible_bytes() -> dict[str, int]:
    """Byte of every character by which byte-level vocabularies write it."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


def byte_side(path: str):
    """(encode, bytes of every id) of a byte-level BPE file of ``tokenizers``; its special tokens are plain text."""
    import tiktoken
    from public_tokenizers import PATTERN

    model, of = json.load(open(path)), visible_bytes()
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    encode = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return (lambda texts: [np.array(encode(" " + t), np.int32) for t in texts]), table


def piece_side(path: str):
    """(encode, bytes of every id) of a ``sentencepiece`` model, which adds the blank itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        table.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return (lambda texts: [np.array(model.encode(t), np.int32) for t in texts]), table


def sides(path_a: str, path_b: str):
    if (path_a, path_b) not in _SIDES:
        a, b = byte_side(path_a), piece_side(path_b)
        # Decimal ids with what may follow them: "," inside a side, "|" after A's, ";" after a group, "" at the end.
        names = pa.array([f"{i}{end}" for i in range(max(len(a[1]), len(b[1]))) for end in (",", "|", ";", "")], pa.large_binary())
        _SIDES[path_a, path_b] = a[0], pa.array(a[1], pa.large_binary()), b[0], pa.array(b[1], pa.large_binary()), names
    return _SIDES[path_a, path_b]


def list_column(ids: list) -> pa.LargeListArray:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def without(lists: pa.LargeListArray, drop: np.ndarray) -> pa.LargeListArray:
    """The lists, empty where ``drop`` says so."""
    lengths = np.where(drop, 0, pc.list_value_length(lists).to_numpy())
    parents = pc.list_parent_indices(lists).to_numpy()
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), pc.list_flatten(lists).filter(pa.array(~drop[parents])))


def token_ends(lists: pa.LargeListArray, table: pa.LargeBinaryArray) -> pa.Table:
    """(doc, end, id, at) of every token: its document's number, the byte after it, its id and its place in the batch."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    length = pc.take(pc.binary_length(table), ids)
    upto = pc.cumulative_sum(length.cast(pa.int64()))
    counts = pc.list_value_length(lists).to_numpy()
    total = np.concatenate([[0], upto.to_numpy()])
    before = total[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)] if len(counts) else np.zeros(0, np.int64)
    end = pc.subtract(upto, pa.array(np.repeat(before, counts)))
    return pa.table({"doc": doc, "end": end, "id": ids, "at": np.arange(len(ids))})


def gives_back(lists: pa.LargeListArray, table: pa.LargeBinaryArray, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list's tokens are a blank and the text."""
    joined, at = text_bytes(pc.take(table, pc.list_flatten(lists)))
    offsets = at[lists.offsets.to_numpy()]
    view = memoryview(joined)
    return np.array([view[a:z] == b" " + t for a, z, t in zip(offsets, offsets[1:], texts)], bool)


def group_strings(a: pa.Table, b: pa.Table, cut_a: np.ndarray, cut_b: np.ndarray, docs: int, names: pa.LargeBinaryArray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of every document; ``cut_a`` and ``cut_b`` mark the last tokens of groups."""
    def before(cuts):  # groups that end before each token
        return np.cumsum(cuts) - cuts

    group_a, group_b = before(cut_a.astype(np.int64)), before(cut_b.astype(np.int64))
    n = int(cut_a.sum())
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
    place_a = np.arange(len(group_a)) + np.concatenate([[0], upto_b])[group_a]
    place_b = np.arange(len(group_b)) + upto_a[group_b]
    last = np.zeros(len(group_b), bool)  # the last token of a document
    doc_b = b["doc"].to_numpy()
    if len(doc_b):
        last[np.append(doc_b[1:] != doc_b[:-1], True)] = True
    row = np.empty(len(group_a) + len(group_b), np.int64)
    row[place_a] = 4 * a["id"].to_numpy().astype(np.int64) + cut_a
    row[place_b] = 4 * b["id"].to_numpy().astype(np.int64) + np.where(last, 3, np.where(cut_b, 2, 0))
    body, at = text_bytes(pc.take(names, pa.array(row)))
    sizes = np.bincount(a["doc"].to_numpy(), minlength=docs) + np.bincount(doc_b, minlength=docs)
    ends = at[np.concatenate([[0], np.cumsum(sizes)])]
    view = memoryview(np.ascontiguousarray(body))
    return [hashlib.sha256(view[s:e]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def encoded(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Rows of two kinds. A run's: (run, codes, counts), its distinct pairs and how often they are linked; a code is a's id
    times the size of B's vocabulary plus b's id. A document's: (run, digests, pairs, times), the places of its pairs in the run's codes."""

    def run(batches):
        encode_a, table_a, encode_b, table_b, names = sides(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(slices(batches, "_text", run_bytes)):
            count = batch.num_rows
            texts = batch["_text"].fill_null("").to_pylist()
            a, b = list_column(encode_a(texts)), list_column(encode_b(texts))
            raw = [t.encode() for t in texts]
            drop = ~(gives_back(a, table_a, raw) & gives_back(b, table_b, raw)) | np.array([not t for t in raw], bool)
            a, b = without(a, drop), without(b, drop)
            ends_a, ends_b = token_ends(a, table_a), token_ends(b, table_b)
            met = ends_a.join(ends_b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
            cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
            cut_a[met["at"].to_numpy()], cut_b[met["at_b"].to_numpy()] = True, True
            code = pc.add(pc.multiply(met["id"].cast(pa.int64()), len(table_b)), met["id_b"].cast(pa.int64()))
            links = pa.table({"doc": met["doc"], "code": code})
            counts = links.group_by("code", use_threads=False).aggregate([([], "count_all")])
            mine = links.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
            codes = counts["code"].to_numpy()
            order = np.argsort(codes)
            place = np.searchsorted(codes, mine["code"].to_numpy(), sorter=order)
            doc, times = mine["doc"].to_numpy(), mine["count_all"].to_numpy()
            by = np.lexsort((place, doc))
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=count))]).astype(np.int32)
            groups = np.bincount(met["doc"].to_numpy(), minlength=count)
            out = pa.table({
                "run": pa.array(np.full(count, first + n)), "doc_id": batch["_key"],
                "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()), "n_groups": groups, "n_links": groups,
                "groups_sha256": pa.array(group_strings(ends_a, ends_b, cut_a, cut_b, count, names), pa.string()),
                "pairs": pa.ListArray.from_arrays(pa.array(at), pa.array(place[by].astype(np.int32))),
                "times": pa.ListArray.from_arrays(pa.array(at), pa.array(times[by].astype(np.int32))),
            })
            blank = lambda kind, rows: pa.nulls(rows, kind)
            whole = pa.table({
                "codes": pa.array([codes[order]], pa.list_(pa.int64())), "counts": pa.array([counts["count_all"].to_numpy()[order]], pa.list_(pa.int64())), "run": pa.array([first + n]),
            })
            for part in (whole, out):
                yield from pa.table([part[f.name].cast(f.type) if f.name in part.column_names else blank(f.type, part.num_rows) for f in schema], schema=schema).combine_chunks().to_batches()

    integers = pa.list_(pa.int32())
    schema = pa.schema([("run", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", integers), ("times", integers), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"run long, {DIGESTS}, groups_sha256 string, pairs array<int>, times array<int>, codes array<long>, counts array<long>")


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """(code, count, best): links of every id pair in the corpus, and whether no pair of its B id has more."""
    rows = table.filter(F.col("codes").isNotNull()).select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    counts = stored(rows.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("count")))
    most = stored(counts.groupBy(F.pmod("code", F.lit(size_b)).alias("_b")).agg(F.max("count").alias("_most")))
    met = counts.join(most, F.pmod("code", F.lit(size_b)) == F.col("_b"))
    return met.select("code", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    table = stored(encoded(docs, path_a, path_b, key, text, run_bytes))
    counts = stored(pair_counts(table, len(sides(path_a, path_b)[3])))
    asked = table.filter(F.col("codes").isNotNull()).select(F.col("run").alias("_run"), F.posexplode("codes").alias("at", "code"))
    answers = asked.join(counts, "code").select("_run", "at", "count", "best")

    def look_up(mine: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["at"].to_numpy())
        count = found["count"].to_numpy()[order].astype(np.int64)
        best = found["best"].to_numpy()[order].astype(np.int64)
        pairs, times = mine["pairs"].combine_chunks(), mine["times"].combine_chunks()
        doc, at, n = pc.list_parent_indices(pairs).to_numpy(), pc.list_flatten(pairs).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        ends = total(np.bincount(doc, minlength=mine.num_rows)).astype(np.int64)
        sums = [np.diff(total(n * x[at])[ends]) if len(at) else np.zeros(mine.num_rows, np.int64) for x in (best, count)]
        return pa.table({"doc_id": mine["doc_id"], "n_a": mine["n_a"], "n_b": mine["n_b"], "n_groups": mine["n_groups"], "n_links": mine["n_links"], "n_best": sums[0], "count_sum": sums[1], "groups_sha256": mine["groups_sha256"]})

    mine = table.filter(F.col("pairs").isNotNull()).drop("codes", "counts")
    return mine.groupBy("run").cogroup(answers.groupBy("_run")).applyInArrow(look_up, f"{DIGESTS}, n_best long, count_sum long, groups_sha256 string")
