"""Scalar cleaning rules for ids, names, measurements and annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binarize(df: DataFrame, col: str, threshold: float = 30.0, out: str = "label") -> DataFrame:
    """1 where the value is strictly below the threshold, else 0 (NULL gives 0)."""
    return df.withColumn(out, F.when(F.col(col) < threshold, 1).otherwise(0))


def positives(df: DataFrame, label: str = "label", keep=("src", "dst")) -> DataFrame:
    return df.filter(F.col(label) == 1).select(*keep)


def parse_qualified(col) -> Column:
    """``>10`` and ``<0.5`` to their number; text that is no number gives NULL."""
    return F.regexp_replace(F.trim(_c(col)), "^[<>]", "").try_cast("double")


def contains_ci(col, needle: str) -> Column:
    return F.lower(_c(col)).contains(needle.lower())


def contains_any(col, needles) -> Column:
    """Case-sensitive: true if any of the needles occurs."""
    return reduce(lambda a, b: a | b, [_c(col).contains(n) for n in needles])


def drop_sentinels(df: DataFrame, cols, sentinel: str = "-") -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != sentinel))
    return df


def explode_multi(df: DataFrame, col: str, sep: str = "|", out: str | None = None) -> DataFrame:
    """One row per part of a delimited cell."""
    return df.withColumn(out or col, F.explode(F.split(F.col(col), "\\Q" + sep + "\\E")))


def normalize_id(col, prefix: str = r"^CID\w?0*") -> Column:
    """Strip a vocabulary prefix and leading zeros: ``CID100000085`` to ``85``."""
    return F.regexp_replace(_c(col), prefix, "").try_cast("long").cast("string")


def extract_id(col, pattern: str = r"^CID[1m](\d+)") -> Column:
    """Digits after a prefix, without leading zeros; NULL when the prefix differs."""
    found = F.regexp_extract(_c(col), pattern, 1)
    return F.when(found != "", found.try_cast("long").cast("string"))


def clean_name(col, blacklist=()) -> Column:
    """Drop bracketed parts, stray brackets and commas, digits, and listed words."""
    x = F.regexp_replace(_c(col), r"\([^)]*\)", "")
    x = F.regexp_replace(x, r"[(,)]", "")
    x = F.regexp_replace(x, r"\d+", "")
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: (w != "") & ~w.isin(list(blacklist) or [""]))
    return F.array_join(words, " ")


def insert_colon(col) -> Column:
    """``hsa123`` to ``hsa:123``."""
    return F.regexp_replace(_c(col), r"^([A-Za-z]+)(\d)", "$1:$2")


def remove_colon(col) -> Column:
    return F.translate(_c(col), ":", "")


def lower_if_string(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.lower(F.col(col))) if dict(df.dtypes)[col] == "string" else df


def classify(code, keywords, classes, default: str = "notAnnotated") -> Column:
    """``enzyme`` if there is a code, else the first listed class among the keywords."""
    found = F.array_intersect(F.array(*[F.lit(c) for c in classes]), _c(keywords))
    return F.when(_c(code).isNotNull() & (_c(code) != ""), F.lit("enzyme")).otherwise(
        F.coalesce(F.when(F.size(found) > 0, F.element_at(found, 1)), F.lit(default))
    )


def code_prefix(col, n: int = 3) -> Column:
    return F.substring(_c(col), 1, n)


def first_listed(col, sep: str = ";") -> Column:
    return F.trim(F.split_part(_c(col), F.lit(sep), F.lit(1)))


def parse_duration(col) -> Column:
    """``1d 2h 3m 4s`` to seconds; text without any such token (``OOT``) gives NULL."""
    # Seconds per unit.
    units = {"d": 86400, "h": 3600, "m": 60, "s": 1}
    c = _c(col)
    total = F.lit(0)
    for unit, seconds in units.items():
        part = F.regexp_extract(c, r"(\d+)\s*" + unit, 1)
        total = total + F.when(part != "", part.cast("long") * seconds).otherwise(0)
    return F.when(c.rlike(r"\d+\s*[dhms]"), total.cast("long"))


def run_name_part(col, from_end: int, sep: str = "_") -> Column:
    """``from_end``-th part of a run name counted from its end (1 is the last)."""
    parts = F.split(_c(col), "\\Q" + sep + "\\E")
    return F.when(F.size(parts) >= from_end, F.element_at(parts, -from_end))


def has_nondigit(col) -> Column:
    return _c(col).rlike(r"\D")


def split_chain(col) -> Column:
    """``A/B=1-200`` to (chain ``A``, start 1, end 200)."""
    c = _c(col)
    bounds = F.split(F.split_part(c, F.lit("="), F.lit(2)), "-")
    return F.struct(
        F.substring(c, 1, 1).alias("chain"),
        F.try_element_at(bounds, F.lit(1)).try_cast("int").alias("start"),
        F.try_element_at(bounds, F.lit(2)).try_cast("int").alias("end"),
    )


def strip_unit(col, unit: str = " A") -> Column:
    return F.regexp_replace(_c(col), "\\Q" + unit + "\\E$", "").try_cast("double")


def dataset_of(col, patterns, default: str | None = None) -> Column:
    """Tag of the first (pattern, tag) that matches, in list order."""
    out = F.lit(default)
    for pattern, tag in reversed(list(patterns)):
        out = F.when(_c(col).rlike(pattern), F.lit(tag)).otherwise(out)
    return out


def indicator(col) -> Column:
    return (_c(col) > 0).cast("int")


def exp_kernel(col, scale: float = 1.0) -> Column:
    return F.lit(scale) * F.exp(-_c(col))


def parse_entry_json(col) -> Column:
    """First code and the lower-cased names of one category out of a JSON record."""
    schema = "struct<codes:array<string>,keywords:array<struct<category:string,name:string>>>"
    return F.from_json(_c(col), schema)


def keyword_names(entry, category: str) -> Column:
    kept = F.filter(_c(entry)["keywords"], lambda k: k["category"] == category)
    return F.transform(kept, lambda k: F.lower(k["name"]))


def extract_synonyms(df: DataFrame, col: str, pattern: str, out: str = "synonym", sep: str = ";") -> DataFrame:
    """One row per regex match in each part of a separated description."""
    parts = df.withColumn("_part", F.explode(F.split(F.col(col), "\\Q" + sep + "\\E")))
    hits = parts.withColumn(out, F.explode(F.regexp_extract_all(F.col("_part"), F.lit(pattern), F.lit(1))))
    return hits.withColumn(out, F.trim(F.col(out))).drop("_part")


