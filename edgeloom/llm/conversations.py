"""Repair of the structure of conversations by depth-first branch and bound.

A conversation's rows, in the order of turns, are turned into one whose role initials read ``(s?(ua)+)?`` by the
cheapest edits: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant row. Of equally cheap
edits the ASCII-least string of initials wins.

``search`` keeps an explicit stack of prefixes. A node is (row, state of the pattern). A prefix is dropped if its cost
and the lower bound of what follows exceed the incumbent, if the two are equal and its letters come later, or if the
node's table of dominance holds a better prefix. An empty stack proves the incumbent.

Conversations up to ``LONG`` rows and ``LONG_BYTES`` of text are repaired whole, streamed one after the other. Longer
ones never meet in one task: their rows are sorted over range partitions and cut into chunks; a chunk is summarised by
its cheapest cost from every state to every state with the order of their letters, summaries are combined ``FAN`` at a
time, level by level, and the states chosen go down again. Only the hash of a long conversation's text reads its
repaired rows one after the other, as they stream by.

Cases: null role or text is one space; a role without initial, or with another than s, u, a, cannot be kept; rows of
an equal turn go by role, then by the SHA-256 of their text; null turns come first; a null conv_id is a conversation of
its own; repeated rows are duplicates; texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import ranked
from .common import stored

LONG, LONG_BYTES, FAN = 512, 8 << 20, 1024
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
NAMES = {USER: "user", ASSISTANT: "assistant"}
# State after a kept row of this initial, by the state before it.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = (USER, USER, ASSISTANT, USER)  # the only state that an inserted or reroled row can lead to
TAIL = (0, 2, 1, 0)  # rows to insert at the end, by state
ALTERNATE = {"su", "ua", "au"}

REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# -- one run of rows ----------------------------------------------------------

def edits(row, state: int):
    """(letters, cost, next state) of a row (initial, cut, must, times), in ASCII order."""
    initial, cut, must, times = row
    yield "D" * times, DELETE * times, state
    if not must:
        extra = CUT if cut else 0
        after = STEP.get(initial, {}).get(state)
        if after is not None:
            yield "K", KEEP + extra, after
        yield "R", REROLE + extra, NEXT[state]


def lower_bounds(rows, finish) -> list[list[int]]:
    """The least cost of the rows from each on, from each state, to a finish of the given costs by state."""
    bound = [list(finish)]
    for row in reversed(rows):
        after = bound[-1]
        direct = [min(c + after[q] for _, c, q in edits(row, p)) for p in range(4)]
        once = [min(direct[p], INSERT + direct[NEXT[p]]) for p in range(4)]
        bound.append([min(direct[p], INSERT + once[NEXT[p]]) for p in range(4)])
    return bound[::-1]


def search(rows, start: int, finish) -> tuple[int, str, int] | None:
    """(cost, audit, last state) of the cheapest edits, the ASCII-least of them; None if no edits lead to the finish.

    ``finish`` has the cost of ending in each state (``NEVER`` where that is not allowed). Rows are inserted only
    before a row of the run.
    """
    bound, n = lower_bounds(rows, finish), len(rows)
    if bound[0][start] >= NEVER:
        return None
    best, best_audit, best_state = NEVER, "", start
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        hope = cost + bound[i][state]
        if hope > best or hope == best and audit > best_audit[: len(audit)]:
            continue
        if i == n:
            audit += "I" * (finish[state] // INSERT)
            if hope < best or audit < best_audit:
                best, best_audit, best_state = hope, audit, state
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        table[(i, state)] = (cost, audit)
        children = [(i + 1, q, cost + c, audit + letters) for letters, c, q in edits(rows[i], state)]
        children.append((i, NEXT[state], cost + INSERT, audit + "I"))
        children = [x for x in children if x[2] + bound[x[0]][x[1]] <= best]
        # The most hopeful child is taken first, the ASCII-least of equal ones.
        stack += sorted(children, key=lambda x: (x[2] + bound[x[0]][x[1]], x[3]), reverse=True)
    return best, best_audit, best_state


FINISH = tuple(INSERT * n for n in TAIL)


@lru_cache(1 << 14)
def whole(rows: tuple) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    found = search(rows, START, FINISH)
    return found[0], found[1]


def roles_after(rows, audit: str, state: int = START):
    """(row number or None for an inserted row, new role or None for a kept one), for every repaired row."""
    letters, i = iter(audit), 0
    for i, (initial, _, _, times) in enumerate(rows):
        letter = next(letters)
        while letter == "I":
            state = NEXT[state]
            yield None, NAMES[state]
            letter = next(letters)
        if letter == "K":
            state = STEP[initial][state]
            yield i, None
        elif letter == "R":
            state = NEXT[state]
            yield i, NAMES[state]
        else:
            for _ in range(times - 1):
                next(letters)
    for _ in letters:
        state = NEXT[state]
        yield None, NAMES[state]


# -- rows of conversations ----------------------------------------------------

def prepared(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, copies, digest, blank, cut): rows with what the faults need; ``conv`` is the id as text, empty if null."""
    rows = turns.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the damage that the crc32 of ``conv_id:turn`` deals out, as ``prepared`` gives them."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    fate, text = F.col("_fate"), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("_fate")).filter(fate != 0)
    rows = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fate)
    return prepared(rows, copies=F.when(fate == 3, 2).otherwise(1))


class Tally:
    """Counts over the rows of a conversation as they pass in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns that are not null

    def row(self, initial, turn, fault, times=1):
        if fault:
            setattr(self, fault, getattr(self, fault) + times)
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ALTERNATE:
            self.illegal += 1
        if times > 1 and initial * 2 not in ALTERNATE:
            self.illegal += times - 1
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def then(self, other: "Tally"):
        """Add the rows that follow."""
        if other.first is None:
            return
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + getattr(other, c))
        if self.first is None:
            self.first = other.first
        elif self.last + other.first not in ALTERNATE:
            self.illegal += 1
        self.last = other.last
        if other.low is not None:
            self.turns -= other.low == self.high
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


TALLY = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")


def _groups(batches, key):
    """Lists of the rows (dicts) of one key, from sorted batches."""
    rows, at = [], None
    for b in batches:
        for r in b.to_pylist():
            k = key(r)
            if rows and k != at:
                yield rows
                rows = []
            at = k
            rows.append(r)
    if rows:
        yield rows


def _repair_whole(batches):
    """A report of every conversation of a sorted partition."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("conv", "audit", "repaired_sha256") else pa.int64()) for n in names])
    out = []
    for rows in _groups(batches, lambda r: r["conv"]):
        seen, shape, texts, tally = set(), [], [], Tally()
        for r in rows:
            initial = r["role"][:1]
            for _ in range(r["copies"]):
                same = (r["role"], r["text"])
                fault = "blank" if r["blank"] else "duplicate" if same in seen else "truncated" if r["cut"] else ""
                seen.add(same)
                tally.row(initial, r["turn"], fault)
                shape.append((initial, fault == "truncated", fault in ("blank", "duplicate"), 1))
                texts.append(same)
        cost, audit = whole(tuple(shape))
        kept = [f"{role or texts[i][0]}:{'' if i is None else texts[i][1]}" for i, role in roles_after(shape, audit)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((rows[0]["conv"], tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest))
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)


# -- long conversations -------------------------------------------------------

_SUMMARY = "conv string, no long, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long"
_CHOICE = "conv string, no long, enter int, leave int"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _ranked(found: list[list]) -> tuple[list[int], list[int]]:
    """Costs and ranks (order of the letters among the ends of one start) of a 4 x 4 list of (cost, comparable) or None."""
    costs, ranks = [], []
    for ends in found:
        order = sorted({x[1] for x in ends if x})
        costs += [x[0] if x else NEVER for x in ends]
        ranks += [order.index(x[1]) if x else -1 for x in ends]
    return costs, ranks


def _shape(rows) -> tuple:
    """Rows of a chunk as ``search`` takes them: the copies of a row after the first must go."""
    out = []
    for r in rows:
        initial = r["role"][:1]
        must = r["blank"] or r["again"]
        if must:
            out.append((initial, False, True, r["copies"]))
        else:
            out.append((initial, r["cut"], False, 1))
            if r["copies"] > 1:
                out.append((initial, False, True, r["copies"] - 1))
    return tuple(out)


def _only(state: int) -> list[int]:
    return [0 if q == state else NEVER for q in range(4)]


def _summaries(batches):
    """A summary of every chunk of a partition sorted by chunk."""
    for rows in _groups(batches, lambda r: (r["conv"], r["chunk"])):
        shape, tally = _shape(rows), Tally()
        for r in rows:
            fault = "blank" if r["blank"] else "duplicate" if r["again"] else "truncated" if r["cut"] else ""
            if fault in ("blank", "duplicate") or r["copies"] == 1:
                tally.row(r["role"][:1], r["turn"], fault, r["copies"])
            else:
                tally.row(r["role"][:1], r["turn"], fault)
                tally.row(r["role"][:1], r["turn"], "duplicate", r["copies"] - 1)
        found = [[search(shape, p, _only(q)) for q in range(4)] for p in range(4)]
        costs, ranks = _ranked(found)
        yield pa.RecordBatch.from_pylist([{"conv": rows[0]["conv"], "no": rows[0]["chunk"], "costs": costs, "ranks": ranks} | {c: getattr(tally, c) for c in TALLY}], schema=_arrow(_SUMMARY))


def _paths(rows, start: int):
    """Best way through summaries in order from a state: by last state (cost, ranks on the way, states), or None."""
    best: list = [None] * 4
    best[start] = (0, (), ())
    for r in rows:
        after: list = [None] * 4
        for p, way in enumerate(best):
            for q in range(4):
                if way and r["costs"][4 * p + q] < NEVER:
                    new = (way[0] + r["costs"][4 * p + q], way[1] + (r["ranks"][4 * p + q],), way[2] + (q,))
                    after[q] = new if after[q] is None or new < after[q] else after[q]
        best = after
    return best


def _combine(fan: int):
    """One summary of up to ``fan`` summaries."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        tally = Tally()
        for r in rows:
            one = Tally()
            for c in TALLY:
                setattr(one, c, r[c])
            tally.then(one)
        costs, ranks = _ranked([[way and way[:2] for way in _paths(rows, p)] for p in range(4)])
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "no": rows[0]["no"] // fan, "costs": costs, "ranks": ranks} | {c: getattr(tally, c) for c in TALLY}], schema=_arrow(_SUMMARY))

    return run


def _choose(table: pa.Table) -> pa.Table:
    """The states on the way through up to ``FAN`` summaries whose first and last state are known."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    states = (rows[0]["enter"], *_paths(rows, rows[0]["enter"])[rows[0]["leave"]][2])
    return pa.Table.from_pylist([{"conv": r["conv"], "no": r["no"], "enter": p, "leave": q} for r, p, q in zip(rows, states, states[1:])], schema=_arrow(_CHOICE))


def _top(batches):
    """The cheapest last state of whole conversations."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            ways = [(r["costs"][q] + FINISH[q], r["ranks"][q], q) for q in range(4) if r["costs"][q] < NEVER]
            out.append({"conv": r["conv"], "no": r["no"], "enter": START, "leave": min(ways)[2]})
        yield pa.RecordBatch.from_pylist(out, schema=_arrow(_CHOICE))


def _apply(batches):
    """The repaired rows of chunks whose first and last state are known, and their letters (in the row of place -1)."""
    schema = _arrow("conv string, chunk long, place long, turn long, old string, digest string, role string, audit string")
    for rows in _groups(batches, lambda r: (r["conv"], r["chunk"])):
        shape, row_of = _shape(rows), []
        for n, r in enumerate(rows):
            row_of += [n] * (1 if r["blank"] or r["again"] or r["copies"] == 1 else 2)
        audit = search(shape, rows[0]["enter"], _only(rows[0]["leave"]))[1]
        out = [{"place": -1, "audit": audit}]
        for i, role in roles_after(shape, audit, rows[0]["enter"]):
            r = None if i is None else rows[row_of[i]]
            out.append({"place": len(out), "role": role or r["role"]} | ({} if r is None else {"turn": r["turn"], "old": r["role"], "digest": r["digest"]}))
        yield pa.RecordBatch.from_pylist([x | {"conv": rows[0]["conv"], "chunk": rows[0]["chunk"]} for x in out], schema=schema)


def _hashes(batches):
    """SHA-256 of the rows of every conversation, in a sorted partition: rows pass one by one."""
    at, digest = None, None
    for b in batches:
        for conv, role, text in zip(b["conv"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()):
            if digest is None or conv != at:
                if digest is not None:
                    yield pa.RecordBatch.from_pydict({"conv": [at], "repaired_sha256": [digest.hexdigest()]})
                at, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text or ''}".encode())
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"conv": [at], "repaired_sha256": [digest.hexdigest()]})


def _number_chunks(size: int):
    """Rows of a sorted partition with the number of their chunk: up to ``size`` rows of one conversation."""

    def run(batches):
        at, chunk, n = None, -1, 0
        for b in batches:
            chunks = np.empty(b.num_rows, np.int64)
            for k, conv in enumerate(b["conv"].to_pylist()):
                if chunk < 0 or conv != at or n == size:
                    at, chunk, n = conv, chunk + 1, 0
                chunks[k] = chunk
                n += 1
            yield b.append_column("chunk", pa.array(chunks))

    return run


def repair_long(rows: DataFrame, size: int = LONG, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows (conv, chunk, place, role, text)) of conversations of any length."""
    keys = ["conv", "turn", "role", "digest"]
    folded = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    folded = stored(folded)
    first = stored(folded.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("_first")))
    same = [F.col("x.conv") == F.col("y.conv"), F.col("x.role") == F.col("y.role"), F.col("x.digest") == F.col("y.digest")]
    faults = folded.alias("x").join(first.alias("y"), same).select("x.*", (~F.col("y._first.turn").eqNullSafe(F.col("x.turn"))).alias("again"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = faults.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faults.schema) + ", chunk long"
    ordered = ordered.mapInArrow(_number_chunks(size), schema).withColumn("part", F.spark_partition_id())
    ordered = stored(ordered.withColumn("chunk", F.shiftleft(F.col("part").cast("long"), 40) + F.col("chunk")))

    by_chunk = ordered.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "turn", "role", "digest")
    level = stored(by_chunk.mapInArrow(_summaries, _SUMMARY))
    chunk_no = stored(ranked(level.select("conv", F.col("no").alias("chunk")), ["conv"], ["chunk"], F.shiftright("chunk", 40), "no").withColumn("no", F.col("no") - 1)) if level.head(1) else level.select("conv", F.col("no").alias("chunk"), "no")
    level = level.withColumnRenamed("no", "chunk").join(chunk_no.withColumnRenamed("conv", "_conv").withColumnRenamed("chunk", "_chunk"), (F.col("conv") == F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).select("conv", "no", *[x.split()[0] for x in _SUMMARY.split(", ")[2:]])
    levels = [stored(level)]
    while levels[-1].agg(F.max("no")).first()[0]:
        grouped = levels[-1].groupBy("conv", F.floor(F.col("no") / fan).alias("_group"))
        levels.append(stored(grouped.applyInArrow(_combine(fan), _SUMMARY)))
    top = levels[-1]
    choice = top.mapInArrow(_top, _CHOICE)
    for below in levels[-2::-1]:
        up = choice.select(F.col("conv").alias("_conv"), F.col("no").alias("_group"), "enter", "leave")
        met = below.withColumn("_g", F.floor(F.col("no") / fan)).join(up, (F.col("conv") == F.col("_conv")) & (F.col("_g") == F.col("_group")))
        choice = stored(met.drop("_conv", "_g").groupBy("conv", "_group").applyInArrow(_choose, _CHOICE))
    c = choice.join(chunk_no.select(F.col("conv").alias("_conv"), "chunk", F.col("no").alias("_no")), (F.col("conv") == F.col("_conv")) & (F.col("no") == F.col("_no")))
    c = c.select("_conv", F.col("chunk").alias("_chunk"), "enter", "leave")
    chosen = ordered.join(c, (F.col("conv") == F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).drop("_conv", "_chunk")
    chosen = chosen.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "turn", "role", "digest")
    applied = stored(chosen.mapInArrow(_apply, "conv string, chunk long, place long, turn long, old string, digest string, role string, audit string"))

    # What is inserted at the end belongs to no chunk.
    leave = top.mapInArrow(_top, _CHOICE).select("conv", "leave")
    tails = leave.withColumn("_tail", F.element_at(F.array(*[F.lit(n) for n in TAIL]), F.col("leave") + 1)).filter("_tail > 0")
    tails = tails.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("_tail"))))
    tails = tails.select("conv", F.lit((1 << 63) - 1).alias("chunk"), F.col("place").cast("long").alias("place"), F.when(F.col("place") == F.col("_tail"), "assistant").otherwise("user").alias("role"))
    texts = rows.groupBy(*keys).agg(F.first("text").alias("text"))
    texts = texts.select(*[F.col(k).alias("_" + k) for k in keys], "text")
    kept = applied.filter("place > 0")
    same = [(F.col("conv") == F.col("_conv")), F.col("turn").eqNullSafe(F.col("_turn")), F.col("old") == F.col("_role"), F.col("digest") == F.col("_digest")]
    kept = kept.join(texts, same, "left").select("conv", "chunk", "place", "role", F.coalesce("text", F.lit("")).alias("text"))
    repaired = kept.unionByName(tails.withColumn("text", F.lit("")))

    hashes = repaired.repartition("conv").sortWithinPartitions("conv", "chunk", "place").mapInArrow(_hashes, "conv string, repaired_sha256 string")
    audits = applied.filter("place = -1").groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("_audit"))
    report = top.join(leave.withColumnRenamed("conv", "_c1"), (F.col("conv") == F.col("_c1")))
    report = report.join(audits.withColumnRenamed("conv", "_c2"), (F.col("conv") == F.col("_c2")), "left")
    report = report.join(hashes.withColumnRenamed("conv", "_c3"), (F.col("conv") == F.col("_c3")), "left")
    end = F.element_at(F.array(*[F.lit(n) for n in TAIL]), F.col("leave") + 1)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    return report.select(
        "conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        (F.element_at("costs", F.col("leave") + 1) + end * INSERT).cast("long").alias("cost"),
        F.concat(F.coalesce("_audit", F.lit("")), F.repeat(F.lit("I"), end)).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    ), repaired


def repair(rows: DataFrame, long: int = LONG, long_bytes: int = LONG_BYTES, fan: int = FAN) -> DataFrame:
    """The report of every conversation of ``prepared`` rows: faults, cost, audit and the hash of the repaired text."""
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("_n"), F.sum(F.octet_length("text") * F.col("copies")).alias("_bytes"))
    large = stored(sizes.filter((F.col("_n") > long) | (F.col("_bytes") > long_bytes)).select(F.col("conv").alias("_conv")))
    same = (F.col("conv") == F.col("_conv"))
    short = rows.join(large, same, "left_anti") if large.head(1) else rows
    out = short.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest").mapInArrow(_repair_whole, REPORT)
    if large.head(1):
        out = out.unionByName(repair_long(rows.join(large, same, "left_semi"), long, fan)[0])
    return out


def structure(turns: DataFrame) -> DataFrame:
    """The report of every conversation of a table (conv_id, turn, role, text) after the contract's damage."""
    every = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    out = every.join(repair(damaged(turns)), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
