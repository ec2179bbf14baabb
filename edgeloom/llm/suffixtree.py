"""Language-model scoring by a probabilistic suffix tree over words.

A state is a context of any number of words before a token. A context is examined if its shorter context (without
its earliest word) is a state, its earlier part (without its last word) was examined, and it occurs at least twice
in training but less often than the shorter one: with as many occurrences the two have one distribution, and a
single occurrence cannot vouch for itself. It becomes a state if its next-word distribution diverges from that of
the shorter context: the training tokens after it gain likelihood, each judged by the counts without itself.
Contexts deepen until a depth has no new state; counts fall with every word, so this ends.

Distributions are smoothed towards the shorter context, (n(w) + K p(w)) / (N + K), down to single words,
(c + 1/2) / (N + (V + 1) / 2). A token is scored in the longest state that ends at it; the start of a text counts
as a word of contexts, its end as a token.

Counts are those of all training documents. Runs of documents ask for the totals of their own distinct words,
then, depth by depth, of the words after their examined contexts, so a frequent word is one key of a run. Behind
``WHOLE`` words a run is only the tokens after examined contexts and the sums of its documents. The messages of a
depth are deleted when the runs have taken it in.

Cases: null and empty texts are the end token alone; without training documents all tokens are unknown; a null
doc_id is trained on and not held out; repeated rows count as often as they stand; long texts are scored whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import LOWER_BYTES, discard, stored
from .runs import _MESSAGE, MESSAGE, answer, ask, counts, cut_keys, merged, narrow, pack, parts_for, runs, step

K, RUN, WHOLE = 20.0, 3 << 20, 2
_START = np.uint64(0x5851F42D4C957F2D)
_RUN = pa.schema([("run", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())])
FOLDS, HELD_OUT = 5, 1
_U = np.uint64


def _planes(numbers):
    """Whole numbers byte by byte: the high bytes are nearly always zero and take hardly any room."""
    return np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes):
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


def _gaps(keys):
    """Sorted keys by the gaps between them."""
    return _planes(np.diff(keys, prepend=_U(0)))


def _keys(gaps):
    return np.cumsum(_numbers(gaps), dtype=np.uint64)


def _run(ids, missing, body, at):
    """Tokens of a run as numbers of its words by falling frequency; the end of a text is the empty word."""
    raw, vocabulary, tokens, sizes = body.tobytes(), {b"": 0}, [], []
    offsets = at.tolist()
    for a, z in zip(offsets, offsets[1:]):
        words = raw[a:z].translate(LOWER_BYTES).split()
        tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        tokens.append(0)
        sizes.append(len(words) + 1)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
    token = np.array(tokens, np.int64)
    order = np.argsort(-np.bincount(token, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    held = np.array([not m and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i, m in zip(ids.tolist(), missing.tolist())], bool)
    return {"id": ids, "missing": missing, "held": held, "size": np.array(sizes, np.int64), "token": _planes(rank[token]), "hash": hashes[order]}


def _sorted(run):
    """The run with its words sorted by hash and its tokens as numbers of these."""
    token = _numbers(run["token"])
    order = np.argsort(run["hash"])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return run | {"token": rank[token], "hash": run["hash"][order]}


class _Run:
    """What a run knows from the totals of its words and the depths folded so far."""

    def __init__(self, run, got, model):
        run = _sorted(run)
        self.run, self.model, self.token, self.depth = run, model, run["token"], 0
        self.start = np.cumsum(run["size"]) - run["size"]
        self.place = np.arange(len(self.token)) - np.repeat(self.start, run["size"])
        self.train = np.repeat(~run["held"], run["size"])
        self.key = run["hash"][self.token]
        self.seen = merged(got[0], "total", np.uint8).astype(np.int64)
        self.base = (self.seen + 0.5) / (model["total"] + 0.5 * (model["distinct"] + 1))
        self.p = self.base[self.token]
        self.occurs = np.full(len(self.token), model["total"], np.int64)  # of the context of the depth before each token
        for depth in got[1:]:
            self.deepen()
            n = _numbers(depth[0]["n"]).astype(np.int64)
            self.fold(n, np.unpackbits(depth[0]["keep"], count=len(n)).astype(bool))

    def deepen(self):
        """Go one word further back; ``at`` are the tokens after examined contexts."""
        shorter, self.depth = self.occurs, self.depth + 1
        if self.depth == 1:
            can = np.ones(len(self.token), bool)
            self.occurs = np.where(self.place == 0, self.model["documents"], self.seen[np.concatenate([self.token[:1], self.token[:-1]])])
        else:
            # Occurrences of a context: the total of its last word after its earlier part.
            can = self.state & (self.place > 0) & np.concatenate([self.asked[:0], np.zeros(min(1, len(self.asked)), bool), self.asked[:-1]])
            self.occurs = np.concatenate([np.zeros(min(1, len(self.total)), np.int64), self.total[:-1]])
        self.at = np.flatnonzero(can & (self.occurs >= 2) & (self.occurs < shorter))

    def contexts(self, at, depth):
        """Hashes of the ``depth`` words before tokens."""
        before = self.key[at - 1]
        if depth == 1:
            return np.where(self.place[at] > 0, before, _START)
        return _gram(self.contexts(at - 1, depth - 1), before)

    def examined(self):
        """The tokens after examined contexts; positions of two documents are never neighbours."""
        at, doc = self.at, np.repeat(np.arange(len(self.start)), self.run["size"])
        return {"at": at + doc[at], "doc": doc[at], "context": self.contexts(at, self.depth), "key": self.key[at], "p": self.p[at], "occurs": self.occurs[at], "train": self.train[at]}

    def sums(self):
        """Ids, sizes and scores of the documents by the depths folded so far."""
        add = lambda x: np.add.reduceat(x, self.start) if len(self.start) else np.zeros(0)
        known = add((self.seen[self.token] > 0).astype(np.int64))
        return {c: self.run[c] for c in ("id", "missing", "held", "size")} | {"n_known": known, "base_score": add(np.log10(self.base[self.token])), "score": add(np.log10(self.p))}

    def fold(self, n, keep):
        """Take the totals of the grams at ``at`` and whether their contexts are states."""
        self.total, self.asked, self.state = np.zeros(len(self.token), np.int64), np.zeros(len(self.token), bool), np.zeros(len(self.token), bool)
        self.total[self.at], self.asked[self.at], self.state[self.at] = n, True, keep
        at = self.at[keep]
        self.p[at] = (n[keep] + K * self.p[at]) / (self.occurs[at] + K)


def _gram(context, key):
    """Hash of a context and the token after it: that of the context one word longer, one token on."""
    out = (context ^ (key * _U(0xBF58476D1CE4E5B9))) * _U(0x94D049BB133111EB)
    out ^= out >> _U(29)
    return out


def _whole(model):
    """The examined tokens of a whole run."""

    def examined(run, got):
        r = _Run(run, got, model)
        r.deepen()
        return r.examined()

    return examined


_NUMBERS, _PLAIN = ("at", "doc", "occurs"), ("context", "key", "p", "train")


def _rest(run, got):
    """The examined tokens of a run of which no other token is left."""
    return {c: _numbers(run[c]).astype(np.int64) for c in _NUMBERS} | {c: run[c] for c in _PLAIN}


def _taken(v, grams, states):
    """Of each examined token: hash of its gram, total of that, whether its context is a state."""
    gram = _gram(v["context"], v["key"])
    back, which = (np.unique(x, return_inverse=True)[1] for x in (gram, v["context"]))
    return gram, merged(grams, "total", np.uint8)[back].astype(np.int64), merged(states, "keep", bool)[which]


def _deeper(name, v, sums, grams, states):
    """A run one word deeper: the tokens whose contexts are examined next, and the sums of its documents."""
    gram, n, keep = _taken(v, grams, states)
    p = np.where(keep, (n + K * v["p"]) / (v["occurs"] + K), v["p"])
    sums = sums | {"score": sums["score"] + np.bincount(v["doc"], np.log10(p / v["p"]), len(sums["size"]))}
    on = 1 + np.flatnonzero(keep[1:] & (np.diff(v["at"]) == 1))
    on = on[(n[on - 1] >= 2) & (n[on - 1] < v["occurs"][on])]
    v = {c: x[on] for c, x in v.items()} | {"context": gram[on - 1], "occurs": n[on - 1], "p": p[on]}
    body = pack(sums=sums, **{c: _planes(v[c]) for c in _NUMBERS}, **{c: v[c] for c in _PLAIN})
    return {"run": [name], "bytes": [len(body)], "body": [body]}


def _ask_words(parts):
    def fn(run, got):
        run = _sorted(run)
        n = np.bincount(run["token"].astype(np.int64), np.repeat(~run["held"], run["size"]), len(run["hash"])).astype(np.int64)
        return {p: {"keys": _gaps(run["hash"][a:z]), "n": narrow(n[a:z])} for p, a, z in cut_keys(run["hash"], parts)}

    return fn


def _answer_totals(messages):
    """Totals of all keys; one of the runs that have a key owns it."""
    asked = [_keys(m["keys"]) for m in messages]
    keys = np.concatenate(asked)
    n = np.concatenate([m["n"].astype(np.int64) for m in messages])
    _, owner, back = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(back, n).astype(np.int64)
    own = np.zeros(len(keys), bool)
    own[owner] = True
    cuts = np.cumsum([len(k) for k in asked])[:-1]
    return [{"total": narrow(t), "own": o} for t, o in zip(np.split(total[back], cuts), np.split(own, cuts))], int((total > 0).sum()), int(total.sum())


def _ask_grams(parts, examined):
    def fn(run, got):
        v = examined(run, got)
        keys, back = np.unique(_gram(v["context"], v["key"]), return_inverse=True)
        n = np.bincount(back, v["train"], len(keys)).astype(np.int64)
        return {p: {"keys": _gaps(keys[a:z]), "n": narrow(n[a:z])} for p, a, z in cut_keys(keys, parts)}

    return fn


def _ask_states(parts, examined):
    """Contexts of a run with the gain of the grams that the run owns."""

    def fn(run, got):
        v = examined(run, got[:-1])
        _, one = np.unique(_gram(v["context"], v["key"]), return_index=True)  # a token of each gram
        own = merged(got[-1], "own", bool)
        names, which = np.unique(v["context"], return_inverse=True)
        mine = one[own]
        n, above, occurs = merged(got[-1], "total", np.uint8).astype(np.int64)[own], v["p"][mine], v["occurs"][mine]
        gain = np.where(n > 0, n * np.log10((np.maximum(n - 1, 0) + K * above) / (occurs - 1 + K) / above), 0.0)
        gains = np.bincount(which[mine], gain, len(names))
        return {p: {"keys": _gaps(names[a:z]), "gain": gains[a:z]} for p, a, z in cut_keys(names, parts)}

    return fn


def _answer_states(messages):
    asked = [_keys(m["keys"]) for m in messages]
    names, back = np.unique(np.concatenate(asked), return_inverse=True)
    keep = np.round(np.bincount(back, np.concatenate([m["gain"] for m in messages])), 6) > 0
    return [{"keep": x} for x in np.split(keep[back], np.cumsum([len(k) for k in asked])[:-1])], int(keep.sum()), len(names)


def _fold(model):
    """Totals of the grams of a depth and the states among its contexts, for each examined token of a run."""

    def fn(name, run, got):
        _, n, keep = _taken(_whole(model)(run, got[:-2]), *got[-2:])
        yield {"run": [name], "part": [0], "body": [pack(n=_planes(n), keep=np.packbits(keep))], "n": [0], "total": [0]}

    return fn


def _leave(model):
    """What is left of a whole run one word deeper."""

    def fn(name, run, got):
        r = _Run(run, got[:-2], model)
        sums = r.sums()
        r.deepen()
        yield _deeper(name, r.examined(), sums, *got[-2:])

    return fn


def _go_on(name, run, got):
    yield _deeper(name, _rest(run, None), run["sums"], *got)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(model, sums):
    ids = [None if m else i for i, m in zip(sums["id"].tolist(), sums["missing"].tolist())]
    return {"doc_id": ids, "held_out": sums["held"], "n_tokens": sums["size"], "n_known": sums["n_known"], "train_tokens": np.full(len(ids), model["total"], np.int64), "base_score": sums["base_score"], "score": sums["score"]}


def _score_whole(model):
    def fn(_, run, got):
        yield _scores(model, _Run(run, got, model).sums())

    return fn


def _score_rest(model):
    def fn(_, run, got):
        yield _scores(model, run["sums"])

    return fn


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    base = runs(docs, _run, key, text, RUN)
    parts = parts_for(base)
    known = [answer(ask(base, [], _ask_words(parts)), _answer_totals)]
    distinct, total = counts(known[0])
    model = {"total": total, "distinct": distinct, "documents": _documents(base)}
    depth, whole = 0, True
    while True:
        depth += 1
        examined = _whole(model) if whole else _rest
        grams = answer(ask(base, known, _ask_grams(parts, examined)), _answer_totals)
        states = answer(ask(base, [*known, grams], _ask_states(parts, examined)), _answer_states)
        found, _ = counts(states)
        done = [grams, states]
        if found and depth < WHOLE:
            known.append(stored(step(base, [*known, *done], _fold(model), MESSAGE, _MESSAGE)))
        elif found:
            done += [base, *known]
            base = stored(step(base, [*known, grams, states], _leave(model) if whole else _go_on, "run long, bytes long, body binary", _RUN))
            known, whole = [], False
        for table in done:
            discard(table)
        if not found:
            return step(base, known, _score_whole(model) if whole else _score_rest(model), SCORES, _SCORES)


def _documents(base: DataFrame) -> int:
    """Training documents."""
    from pyspark.sql import functions as F

    def count(_, run, got):
        yield {"n": [int((~run["held"]).sum())]}

    return step(base, [], count, "n long", pa.schema([("n", pa.int64())])).agg(F.sum("n")).first()[0] or 0
