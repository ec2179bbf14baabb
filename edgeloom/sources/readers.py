"""Text and table readers. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_table(spark: SparkSession, path, names, usecols=None, sep: str = "\t", comment: str | None = None, header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with explicit names; only ``usecols`` are parsed out."""
    reader = spark.read.schema(_strings(names)).option("sep", sep).option("header", header).option("encoding", encoding)
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    return df.select(*usecols) if usecols else df


def read_edges(spark: SparkSession, path, sep: str = "\t", header: bool = False, comment: str | None = "#", skip_values=()) -> DataFrame:
    """Distinct (src, dst); ``skip_values`` names src values of stray header rows."""
    df = read_table(spark, path, ["src", "dst"], sep=sep, comment=comment, header=header)
    df = df.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if skip_values:
        df = df.filter(~F.col("src").isin(list(skip_values)))
    return df.dropDuplicates(["src", "dst"])


# -- quarterly reports ------------------------------------------------------

def read_quarterly(spark: SparkSession, path, kind: str) -> DataFrame:
    """Lines of ``$``-delimited report files as (year, quarter, fields).

    ``kind`` is the file stem (``REAC`` or ``DRUG``), in any case; year and quarter come
    from the last part of the path that carries them (``REAC12Q3``). Drug files are
    ISO-8859-1. Header lines are left out.
    """
    encoding = "ISO-8859-1" if kind.upper() == "DRUG" else "UTF-8"
    # A separator that cannot occur keeps the whole line in one column.
    raw = (
        spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("escape", "").option("encoding", encoding)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").csv(path)
        .select("line", F.upper(F.regexp_extract(F.col("_metadata.file_path"), r"(?i).*(" + kind + r"\d{2}Q\d)", 1)).alias("_file"))
    )
    year = F.regexp_extract("_file", r"(\d{2})Q\d$", 1)
    quarter = F.regexp_extract("_file", r"Q(\d)$", 1)
    head = F.lower(F.col("line")).rlike(r"^(isr|primaryid|caseid)\$")
    rows = raw.filter((F.col("_file") != "") & F.col("line").isNotNull() & ~head)
    return rows.select(
        (F.lit(2000) + F.when(year != "", year.cast("int"))).alias("year"), F.when(quarter != "", quarter.cast("int")).alias("quarter"),
        F.split(F.trim(F.regexp_replace("line", r"\r$", "")), r"\$").alias("fields"),
    )


def _at(k: int) -> Column:
    return F.try_element_at("fields", F.lit(k + 1))


def report_events(lines: DataFrame) -> DataFrame:
    """(case, term): the term is field 1 of three-field lines, else field 2, in upper case.

    A trailing separator counts as a field.
    """
    term = F.when(F.size("fields") == 3, _at(1)).otherwise(_at(2))
    keep = [c for c in ("year", "quarter") if c in lines.columns]
    return lines.select(*keep, _at(0).alias("case"), F.upper(term).alias("term")).filter(F.col("term").isNotNull())


def report_roles(lines: DataFrame, keep=("PS", "SS")) -> DataFrame:
    """(case, role, name): a role in field 2 has its name in field 3, one in field 3 in field 4."""
    roles = list(keep)
    at2, at3 = _at(2).isin(roles), _at(3).isin(roles)
    role = F.when(at2, _at(2)).when(at3, _at(3))
    name = F.when(at2, _at(3)).when(at3, _at(4))
    cols = [c for c in ("year", "quarter") if c in lines.columns]
    return lines.select(*cols, _at(0).alias("case"), role.alias("role"), name.alias("name")).filter(F.col("role").isNotNull())


# -- sequences, embeddings, matrices ----------------------------------------

def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(id, seq); the lines of a wrapped sequence are joined."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x))
    return records.select(F.trim(F.element_at(lines, 1)).alias("id"), F.array_join(body, "").alias("seq"))


def read_embeddings(spark: SparkSession, path) -> DataFrame:
    """(id, vec) from lines ``id f1 … fd``; a first line of two fields holds count and dimension and is left out."""
    lines = number_lines(spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("block")))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("pos", parts.alias("p")).filter((F.size("p") > 1) & ~((F.col("pos") == 0) & (F.size("p") == 2)))
    return rows.select(F.element_at("p", 1).alias("id"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"))


def number_lines(lines: DataFrame) -> DataFrame:
    """(pos, value) from 0 in file order; ``lines`` is (value, block) of one file.

    The position inside a block is added to the number of lines in earlier blocks.
    """
    rows = lines.withColumn("_m", F.monotonically_increasing_id())
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    blocks = blocks.select("block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(blocks, "block").select((F.col("_before") + F.col("_m") - F.col("_first")).alias("pos"), "value")


def read_matrix(spark: SparkSession, path, sep: str = "\t", labels: list[str] | None = None, row_names: DataFrame | None = None) -> DataFrame:
    """Matrix text as cells (a, b, s), with ``:`` stripped from the labels.

    A labelled file has the column labels in its first line and a row label in front
    of every other line. For an unlabelled file, ``labels`` gives the columns and
    ``row_names`` (pos, id) the rows by their line number from 0.
    """
    clean = lambda c: F.translate(c, ":", "")
    lines = number_lines(spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("block")))
    fields = F.split("value", sep) if labels is None else F.split(F.trim("value"), sep if sep != " " else r"\s+")
    cells = lines.select("pos", F.posexplode(fields).alias("at", "x"))
    if labels is None:
        # The first line names the columns: a table that is joined by position, as the row labels are.
        names = cells.filter("pos = 0 AND at > 0").select("at", F.translate("x", '"', "").alias("b"))
        rows = cells.filter("pos > 0 AND at = 0").select("pos", F.col("x").alias("a"))
        body = cells.filter("pos > 0 AND at > 0")
    else:
        names = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "at int, b string")
        rows, body = row_names.select("pos", F.col("id").alias("a")), cells
    out = body.join(names, "at").join(rows, "pos")
    return out.select(clean(F.col("a")).alias("a"), clean(F.col("b")).alias("b"), F.col("x").cast("double").alias("s"))


def read_runs(spark: SparkSession, glob, schema, sep: str = "\t", header: bool = True) -> DataFrame:
    """Result files unioned, each row tagged with its file's stem as ``run``."""
    df = spark.read.schema(schema).option("sep", sep).option("header", header).csv(glob)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("run"))
