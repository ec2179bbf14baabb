"""The corpus pipeline: language, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import stored
from edgeloom.llm.decontaminate import decontaminate
from edgeloom.llm.langid import identify, train
from edgeloom.llm.lines import dedup_lines
from edgeloom.llm.neardup import keep_one
from edgeloom.llm.packing import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, as learned from the labelled ones: those without any letter go. Without labels all stay."""
    models = train(docs)
    if not models:
        return docs
    found = identify(docs, models, lang="_lang_pred", score="_lang_score")
    return found.filter(F.col("_lang_pred") != "und").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no word is left go."""
    out = dedup_lines(docs)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the contract's share of their words."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the packed sequences."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packing", packing)]
ORACLE_SQL = None  # fingerprints and tokens are beyond SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
