"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds the distinct words (runs of letters, lower-cased, with a mark on
both ends) of a bounded labelled sample. A text is parsed into phrases: from each phrase's start the longest
match in the automaton, at least one letter. Phrases end with a word, so the phrases of a word are counted
once and reused. c phrases over m letters against n letters of training cost c log2(n) / m bits a letter
(the cross-parsing estimate of the cross-entropy); the language of the lowest cost wins, ties by name.

The sample holds at most ``SAMPLE`` documents of each language: those with the smallest hashes of their id
(rows of an equal id count as one).
All else reads whole texts of all rows; predictions see the text alone.

Cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows all are ``und``;
with a single language each text with a letter gets it, with score 1; rows without a label teach nothing;
repeated rows repeat their result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

SAMPLE = 48  # labelled documents of a language
CACHE = 200_000  # words whose phrases a task remembers
LETTERS = re.compile(r"[^\W\d_]+")
MARK = " "


class SuffixAutomaton:
    """All substrings of the given words: ``steps[state]`` maps a letter to the next state."""

    def __init__(self, words):
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.letters = 0
        for word in words:
            last = 0
            for c in word:
                last = self._extend(last, c)
            self.letters += len(word)

    def _new(self, size, steps, link):
        self.steps.append(steps)
        self.size.append(size)
        self.link.append(link)
        return len(self.steps) - 1

    def _clone(self, p, c, q):
        """A state for the longest string that ends p's step only; p's suffixes move to it."""
        twin = self._new(self.size[p] + 1, dict(self.steps[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last, c):
        q = self.steps[last].get(c)
        if q is not None:  # another word began the same way
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
        now, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = now
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][c]
            self.link[now] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return now

    def phrases(self, word: str) -> int:
        """Number of longest matches, one after the other, that make up the word."""
        steps, count, state = self.steps, 1, 0
        for c in word:
            to = steps[state].get(c)
            if to is None:
                count += state > 0
                to = steps[0].get(c, 0)
                if not to:  # a letter never seen is a phrase of its own
                    count += 1
            state = to
        return count - (state == 0 and count > 1)


def learned_from(key: Column) -> Column:
    """Rows to learn from: the checksum of the id leaves another remainder than 1 by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> list[tuple[str, SuffixAutomaton]]:
    """An automaton for every language of the labelled rows given, from at most ``sample`` documents each."""
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    rows = docs.select(h.alias("_h"), F.col(text).alias("_t"), F.col(lang).alias("_l")).filter("_t IS NOT NULL AND _l IS NOT NULL")
    # The hashes alone give the last one of each language's sample; then only the texts up to it are read.
    first = rows.select("_l", "_h").withColumn("_r", F.row_number().over(W.partitionBy("_l").orderBy("_h"))).filter(F.col("_r") <= sample)
    last = [tuple(r) for r in first.groupBy("_l").agg(F.max("_h")).collect()]
    last = docs.sparkSession.createDataFrame(last, "_l string, _last long")  # a row for each language, as many as there are models
    first = rows.join(F.broadcast(last), "_l").filter(F.col("_h") <= F.col("_last"))
    words: dict[str, set[str]] = {}
    for r in first.select("_l", "_t").toLocalIterator():
        words.setdefault(r[0], set()).update(LETTERS.findall(r[1].lower()))
    return [(name, SuffixAutomaton(f"{MARK}{w}{MARK}" for w in sorted(words[name]))) for name in sorted(words) if words[name]]


def _identify(text: str, models):
    known: dict[str, tuple] = {}

    def costs(word):
        if len(known) > CACHE:
            known.clear()
        found = tuple(m.phrases(f"{MARK}{word}{MARK}") for _, m in models)
        if len(word) < 40:
            known[word] = found
        return found

    weights = [math.log2(m.letters + 2) for _, m in models]

    def one(body):
        counts = Counter(LETTERS.findall(body.lower())) if body else None
        # Runs of signs like ½ are words, but no letters.
        if not counts or not models or not any(c.isalpha() for word in counts for c in word):
            return "und", 0.0
        total = [0] * len(models)
        for word, n in counts.items():
            for k, c in enumerate(known.get(word) or costs(word)):
                total[k] += n * c
        bits = [c * w for c, w in zip(total, weights)]
        order = sorted(range(len(models)), key=lambda k: (bits[k], models[k][0]))
        return models[order[0]][0], 1.0 - bits[order[0]] / bits[order[1]] if len(order) > 1 else 1.0

    return one


def _predict(text, lang, score, held):
    def run(batches):
        one = _identify(text, held.value)
        for b in slices(batches, text):
            got = [one(t) for t in b.column(text).to_pylist()]
            columns = {c: b.column(c) for c in b.schema.names if c not in (lang, score)}
            columns |= {lang: pa.array([g[0] for g in got], pa.string()), score: pa.array([g[1] for g in got], pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def identify(docs: DataFrame, models, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with the predicted language and a score: how much the runner-up costs more, from 0 to 1."""
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(models)
    rest = docs.drop(lang, score)
    schema = T.StructType([*rest.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return rest.mapInArrow(_predict(text, lang, score, held), schema)
