"""Building blocks that keep skewed groups out of a single task.

``ranked`` and ``running_sum`` give exact row numbers and running totals inside
groups of any size: rows are numbered per (group, bucket), where the bucket is
monotone in the order, and the totals of the earlier buckets are added. A group
that holds a third of the table is spread over all of its buckets.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the folder named by ``spark.checkpoint.dir``.

    Later reads take the columns they need. The shuffle files of the job that writes it
    go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_table(df: DataFrame, keys: list[str]):
    """The rows as a table bucketed by ``keys``: joins on all of them read it many times and shuffle it once."""
    spark = df.sparkSession
    name, parts = f"dealt_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def shared_folder(spark) -> str:
    """The folder for checkpoints and other intermediate files, shared by all executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="edgeloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _bucketed(df, groups, bucket, measures):
    """Totals per (group, bucket) and the running total of earlier buckets."""
    earlier = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*groups, bucket.alias("_b")).agg(*[F.sum(e).alias(n) for n, e in measures.items()])
    return sums.select(*groups, "_b", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in measures])


def ranked(df: DataFrame, groups, order, bucket: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based row number by ``order`` within ``groups``.

    ``bucket`` must be monotone in ``order`` and have a bounded number of values.
    """
    groups = list(groups)
    local = W.partitionBy(*groups, "_b").orderBy(*order)
    rows = df.withColumn("_b", bucket).withColumn("_n", F.row_number().over(local))
    before = _bucketed(df, groups, bucket, {"_before": F.lit(1)})
    out = rows.join(before, groups + ["_b"])
    return out.withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_b", "_n", "_before")


def running_sum(df: DataFrame, groups, order, bucket: Column, measures: dict[str, Column]) -> DataFrame:
    """Inclusive running sums by ``order`` within ``groups``; keys must be unique per group."""
    groups = list(groups)
    local = W.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_b", bucket)
    for n, e in measures.items():
        rows = rows.withColumn("_l_" + n, F.sum(e).over(local))
    before = _bucketed(df, groups, bucket, measures)
    out = rows.join(before, groups + ["_b"])
    for n in measures:
        out = out.withColumn(n, F.col(n) + F.col("_l_" + n)).drop("_l_" + n)
    return out.drop("_b")


def salted_join(left: DataFrame, right: DataFrame, on, how: str = "inner", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Equi-join whose hot left keys are split.

    Where the session splits skewed partitions at run time, a plain join does it, from
    sizes that are known by then. Else the left rows of hot keys are salted and their
    right rows copied: keys with more than ``hot_rows`` left rows are spread over ``ceil(n / hot_rows)``
    salts. At most ``|left| / hot_rows`` keys can be hot: that bounds the hot-key table,
    which is therefore broadcast. Rows with a NULL key match nothing and are spread too.
    Left rows keep their matches exactly (inner, left, left_semi or left_anti). If the
    left side is known to have at most ``hot_rows`` rows, nothing can be hot.
    """
    on = list(on)
    if hot_rows == HOT_ROWS and (splits_skew(left.sparkSession) or rows is not None and rows <= hot_rows):
        return left.join(right, on, how)
    hot = (
        left.groupBy(*on).count().filter(F.col("count") > hot_rows)
        .select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    )
    hot = F.broadcast(hot)
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.pmod(F.xxhash64(*left.columns), F.when(unmatched, 4096).otherwise(F.coalesce(F.col("_salts"), F.lit(1))))
    salted = left.join(hot, on, "left").withColumn("_salt", spread.cast("int")).drop("_salts")
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(copies, on + ["_salt"], how).drop("_salt")


def task_count(spark, rows: float, most: int) -> int:
    """How many tasks share the rows so that none gets more than about ``most``: as many as the session deals by default, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // most))


def splits_skew(spark) -> bool:
    """Whether adaptive execution deals skewed join partitions anew, even where that needs another shuffle."""
    on = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin")
    return all(spark.conf.get(k, "false") == "true" for k in on)


def dense_index(ids: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Distinct sorted ids numbered from 0 without a single-task sort.

    The ids are range-partitioned and sorted; the number of ids in earlier
    partitions is added to the position inside the partition. The sorted ids are
    checkpointed first, so both uses see the same partitions.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = (
        ids.select(col).filter(F.col(col).isNotNull()).distinct()
        .repartitionByRange(parts, col).sortWithinPartitions(col)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    fixed = checkpointed(sorted_ids).select(
        col, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")
    )
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = fixed.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    return fixed.join(starts, "_p").select(col, (F.col("_s") + F.col("_i")).cast("long").alias(name))


def cut_points(df: DataFrame, col: str, parts: int = 64) -> list[float]:
    """At most ``parts`` quantile boundaries of a numeric column (a bounded list)."""
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(col, probs, 1.0 / (4 * parts))))


def range_bucket(col: Column, cuts: list[float]) -> Column:
    """Number of boundaries at or below the value: monotone in the value."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(edges, lambda e: e <= col))


def ranked_by_value(df: DataFrame, groups, value: str, key: Column, name: str = "rank", descending: bool = True, cuts=None) -> DataFrame:
    """1-based rank by a number, ties in the order of a digest, in groups of any size.

    The start of every distinct value comes from value counts; ties are numbered per
    value with ``ranked``, so neither a hot group nor a hot value sits in one task.
    """
    groups = list(groups)
    df = df.withColumn("_t", key)
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    cuts = cut_points(df, value) if cuts is None else cuts
    bucket = range_bucket(F.col(value), cuts)
    order, bucket = (F.desc(value), -bucket) if descending else (F.asc(value), bucket)
    start = running_sum(counts, groups, [order], bucket, {"_upto": F.col("_n")})
    start = start.select(*groups, value, (F.col("_upto") - F.col("_n")).alias("_start"))
    inner = ranked(df, groups + [value], ["_t"], F.conv(F.substring("_t", 1, 2), 16, 10).cast("int"), "_in")
    return inner.join(start, groups + [value]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in", "_t")
