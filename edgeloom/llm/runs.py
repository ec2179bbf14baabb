"""Supersteps over runs of documents: runs ask the parts of a key space, parts answer the runs.

A run is a row that holds a few MB of whole documents. In a step every run sends each part one message with
its own distinct keys; a part sees the messages of all runs for its share of the keys and answers each. So a
key is at most once in a message, however often it occurs, and no key gathers rows. All of it is joins and
grouping of DataFrames whose rows carry compressed arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

RUN, PART = 4 << 20, 16 << 20  # bytes of text of a run, and for which there is a part
MESSAGE = "run long, part int, body binary, n long, total long"
_MESSAGE = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("body", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])


def pack(**arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def unpack(body: bytes) -> dict:
    return pickle.loads(zstandard.decompress(body))


def runs(docs: DataFrame, make: Callable, key: str = "doc_id", text: str = "text", size: int = RUN) -> DataFrame:
    """(run, bytes, body): ``make(ids, missing ids, bytes, offsets)`` gives the arrays of a run. Stored."""

    def run(batches):
        seq = 0
        for b in slices(batches, "_text", size):
            body, at = text_bytes(b.column("_text"))
            ids = b.column("_key")
            packed = pack(**make(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), body, at))
            name = (TaskContext.get().partitionId() << 32) + seq
            yield pa.RecordBatch.from_pydict({"run": [name], "bytes": [len(body)], "body": [packed]}, schema=pa.schema([("run", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())]))
            seq += 1

    return stored(docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, "run long, bytes long, body binary"))


def parts_for(base: DataFrame, least: int = 16) -> int:
    """Number of parts: it follows the bytes of text."""
    return max(least, (base.agg(F.sum("bytes")).first()[0] or 0) // PART)


def step(base: DataFrame, answers: list[DataFrame], fn: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``fn(run, arrays of the run, [{part: answer} of each earlier step])`` yields record batches."""
    df = base.select("run", "body")
    for i, a in enumerate(answers):
        mine = a.filter("run >= 0").groupBy("run").agg(F.collect_list(F.struct("part", "body")).alias(f"a{i}"))
        df = df.join(mine, "run", "left")
    n = len(answers)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                got = [{x["part"]: unpack(x["body"]) for x in b.column(2 + i)[row].as_py() or ()} for i in range(n)]
                for out in fn(b.column(0)[row].as_py(), unpack(b.column(1)[row].as_py()), got):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def ask(base: DataFrame, answers: list[DataFrame], fn: Callable) -> DataFrame:
    """Messages of one step; ``fn(arrays, earlier answers)`` gives {part: arrays}."""

    def send(run, arrays, got):
        out = {"run": [], "part": [], "body": [], "n": [], "total": []}
        for part, message in fn(arrays, got).items():
            for c, v in zip(out, (run, part, pack(**message), 0, 0)):
                out[c].append(v)
        yield out

    return step(base, answers, send, MESSAGE, _MESSAGE)


def answer(messages: DataFrame, fn: Callable) -> DataFrame:
    """``fn([arrays of each message])`` gives as many answers and two counts of the part. Stored.

    Rows with run -1 carry the counts.
    """

    def reply(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        replies, n, total = fn([unpack(x) for x in rows["body"]])
        k = len(replies)
        part = rows["part"][0]
        return pa.Table.from_pydict({"run": [*rows["run"], -1], "part": [part] * (k + 1), "body": [*(pack(**r) for r in replies), None], "n": [0] * k + [n], "total": [0] * k + [total]}, schema=_MESSAGE)

    return stored(messages.groupBy("part").applyInArrow(reply, MESSAGE))


def counts(answers: DataFrame) -> tuple[int, int]:
    r = answers.filter("run < 0").agg(F.sum("n"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def cut_keys(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, stop) of sorted 64-bit keys by their leading bits; parts without keys are left out."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    return [(int(part[a]), int(a), int(z)) for a, z in zip(cut, [*cut[1:], len(keys)])]


def merged(got: dict, name: str, dtype) -> np.ndarray:
    """The answers of all parts, in the order of the sorted keys that were asked."""
    return np.concatenate([got[p][name] for p in sorted(got)]) if got else np.zeros(0, dtype)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)
