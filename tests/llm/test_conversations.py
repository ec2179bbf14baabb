"""Repair of conversations against a plain recursion, whole and in chunks."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, conv int, copies string, digest string, blank string, no int"


def plain(rows):
    """{conv_id: the query's other columns} for rows (conv_id, turn, role, text)."""
    out = {}
    blank = lambda v: " " if v is None else v
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            fate = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        turns = [r[0] for r in mine if r[0] is not None]

        @lru_cache(None)
        def least(i, last, inserted):
            """(cost, audit, rows) from row i on, after a row of initial ``last``."""
            ways = [(0, "", ())] if i == len(mine) and last in ("", "a") else []
            then = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[then]

            def way(cost, letter, row, rest):
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], row + rest[2]))

            if inserted < 2:
                way(5, "I", (f"{name}:",), least(i, then, inserted + 1))
            if i < len(mine):
                way(2, "D", (), least(i + 1, last, 0))
                if faults[i] not in ("b", "d"):
                    extra = 5 * (faults[i] == "t")
                    if initials[i] == then or initials[i] == "s" and last == "":
                        way(extra, "K", (f"{mine[i][1]}:{mine[i][2]}",), least(i + 1, initials[i], 0))
                    way(1 + extra, "R", (f"{name}:{mine[i][2]}",), least(i + 1, then, 0))
            return min(ways, key=lambda w: w[:2]) if ways else None

        cost, audit, repaired = least(0, "", 0)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def sample(seed=1, conversations=40, long=60):
    r, rows = random.Random(seed), []
    texts = ["Hello.", "hi", "", " \t", "Ok!", "Fine? ", "x.y", "é。", "same.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    for conv in [*range(conversations), None]:
        for t in range(long if conv == 3 else r.randint(0, 12)):
            role = ("user", "assistant")[t % 2] if r.random() < 0.6 else r.choice(roles)
            text = r.choice(texts) if r.random() < 0.5 else f"Text {t}{r.choice(['.', '.', ''])}"
            rows += [(conv, r.choice([t, t, t, t, None, t + 2]), role, text)] * (2 if r.random() < 0.1 else 1)
    rows += [(5000, t, "user", "again.") for t in range(40)] + [(5001, 7, "assistant", "same turn.")] * 30
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = sample()
    return rows, spark.createDataFrame([(*r, 1, "c", "d", "b", 2) for r in rows], SCHEMA).repartition(3).cache()


def test_equals_plain_version(table):
    from edgeloom.llm.conversations import structure

    rows, turns = table
    assert {r[0]: tuple(r)[1:] for r in structure(turns).collect()} == plain(rows)


@pytest.mark.parametrize("long, fan", [(3, 2), (6, 1000)])
def test_long_conversations_in_chunks(table, long, fan):
    from edgeloom.llm.conversations import damaged, repair

    rows, turns = table
    want = plain(rows)
    got = {int(r[0]) if r[0] else None: tuple(r)[1:] for r in repair(damaged(turns), long=long, fan=fan).collect()}
    assert {c: w for c, w in want.items() if c in got} == got
    assert all(w == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, w in want.items() if c not in got)


def test_search_equals_trying_all_edits():
    from itertools import product

    from edgeloom.llm.conversations import FINISH, START, search

    r = random.Random(4)
    for _ in range(60):
        rows = tuple((r.choice("suax"), r.random() < 0.3, r.random() < 0.2, 1) for _ in range(r.randint(0, 4)))
        every = []
        for letters in product(*[[before + e for before in ("", "I", "II") for e in ("D" if must else "KRD")] for _, _, must, _ in rows], ["", "I", "II"]):
            pattern, cost, i = "", 0, 0
            for letter in "".join(letters):
                then = "a" if pattern[-1:] == "u" else "u"
                if letter == "I":
                    pattern, cost = pattern + then, cost + 5
                    continue
                initial, cut, _, _ = rows[i]
                i += 1
                cost += {"K": 0, "R": 1, "D": 2}[letter] + 5 * (cut and letter != "D")
                pattern += {"K": initial, "R": then, "D": ""}[letter]
            if re.fullmatch("(s?(ua)+)?", pattern):
                every.append((cost, "".join(letters)))
        assert search(rows, START, FINISH)[:2] == min(every)


def test_empty_table(spark, table):
    from edgeloom.llm.conversations import structure

    assert structure(spark.createDataFrame([], table[1].schema)).collect() == []
