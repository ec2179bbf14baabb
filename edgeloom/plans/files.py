"""File formats: the given tables written in a format and read back with its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.scale import dense_index, shared_folder
from ..sources import catalog as C
from ..sources import readers as R
from ..sources import writers as W
from . import tables as T
from .registry import query
from .tables import with_views


def _new(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _text(df, spark) -> str:
    path = _new(spark)
    df.write.text(path)
    return path


@query("read_edges", with_views("inter") + "SELECT src, dst FROM inter")
def _(spark, sf):
    path = _new(spark)
    W.write_edges(T.affinity(spark, sf).filter("y < 30").select("src", "dst"), path)
    return R.read_edges(spark, path)


@query("read_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_type FROM part")
def _(spark, sf):
    path = _new(spark)
    T.table(spark, sf, "part").write.csv(path)
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return R.read_table(spark, path, names, usecols=["p_partkey", "p_type"], sep=",")


def _report_path(spark, sf, kind, line):
    """Report lines under the quarter of their event, in files named by kind and quarter."""
    e = T.table(spark, sf, "events")
    root = _new(spark)
    # Spark names the files of a folder itself, so the quarter is the folder's name here.
    e.select(line.alias("value"), F.concat(F.lit(kind), F.date_format("ts", "yy"), F.lit("Q"), F.quarter("ts")).alias("file")).write.partitionBy("file").text(root)
    return root


_QUARTER = "CAST(year(ts) AS INTEGER) AS year, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(event_id AS VARCHAR) AS \"case\""


@query("report_events", f"SELECT {_QUARTER}, upper(event_type) || json_extract_string(props, '$.k') AS term FROM events")
def _(spark, sf):
    term = F.concat("event_type", F.get_json_object("props", "$.k"))
    three = F.concat_ws("$", "event_id", term, F.lit(""))
    four = F.concat_ws("$", "event_id", "user_id", term, F.lit("x"), F.lit(""))
    root = _report_path(spark, sf, "REAC", F.when(F.col("event_id") % 2 == 0, three).otherwise(four))
    return R.report_events(R.read_quarterly(spark, root, "REAC"))


@query("report_roles", f"SELECT {_QUARTER}, CASE WHEN event_id % 3 = 0 THEN 'PS' ELSE 'SS' END AS role, 'D' || user_id AS name FROM events WHERE event_id % 3 < 2")
def _(spark, sf):
    name = F.concat(F.lit("D"), "user_id")
    role = F.when(F.col("event_id") % 3 == 0, "PS").when(F.col("event_id") % 3 == 1, "SS").otherwise("C")
    early = F.concat_ws("$", "event_id", F.lit("1"), role, name, F.lit("x"))
    late = F.concat_ws("$", "event_id", F.lit("9"), F.lit("1"), role, name, F.lit("x"))
    root = _report_path(spark, sf, "DRUG", F.when(F.col("event_id") % 2 == 0, early).otherwise(late))
    return R.report_roles(R.read_quarterly(spark, root, "DRUG"))


@query("read_fasta", "SELECT 'Q' || page_id AS id, replace(url, '>', '') AS seq FROM pages")
def _(spark, sf):
    s = T.sequences(spark, sf)
    half = F.floor(F.length("seq") / 2).cast("int")
    wrapped = F.concat(F.lit(">"), "id", F.lit("\n"), F.substring("seq", F.lit(1), half), F.lit("\n"), F.substring(F.col("seq"), half + 1, F.length("seq")))
    return R.read_fasta(spark, _text(s.select(wrapped), spark))


@query("read_embeddings", with_views("emb") + "SELECT id, len(vec) AS width, round(CAST(vec[1] AS DOUBLE), 6) AS first, round(CAST(vec[len(vec)] AS DOUBLE), 6) AS last FROM emb")
def _(spark, sf):
    e = T.embeddings(spark, sf).select(F.concat_ws(" ", "id", F.array_join(F.col("vec").cast("array<string>"), " ")))
    got = R.read_embeddings(spark, _text(e, spark))
    at = lambda k: F.round(F.element_at("vec", k).cast("double"), 6)
    return got.select("id", F.size("vec").alias("width"), at(1).alias("first"), at(-1).alias("last"))


@query("read_runs", "SELECT o_orderpriority AS network, o_totalprice AS auc, true AS tagged FROM orders")
def _(spark, sf):
    path = _new(spark)
    T.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice").write.option("sep", "\t").option("header", True).csv(path)
    runs = R.read_runs(spark, path, "network string, auc double")
    return runs.select("network", "auc", F.col("run").startswith("part-").alias("tagged"))


@query("write_tagged", "SELECT p_partkey, t AS tag FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part), (SELECT unnest(['ring', 'red']) AS t) WHERE contains(p_name, t)")
def _(spark, sf):
    from ..operators.edges import split_by_source

    path = _new(spark)
    rows = split_by_source(T.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["ring", "red"])
    W.write_tagged(rows, path)
    return spark.read.schema("p_partkey string, p_name string, tag string").option("sep", "\t").csv(path).select("p_partkey", "tag")


@query("write_folds", with_views("folds") + "SELECT seed, fold, src, dst, label FROM folds")
def _(spark, sf):
    path = _new(spark)
    W.write_folds(T.labelled_folds(spark, sf), path)
    return spark.read.schema("src string, dst string, label int, seed int, fold int").parquet(path)


def _catalog(spark, sf):
    """Orders as drug records: their parts are targets, their customer an enzyme; orders of one customer have one name.

    A record holds the few lines of its order, so none grows with the table.
    """
    part = lambda c: F.struct(
        F.array(F.struct(c.alias("_id"), F.struct(F.array(F.struct(F.lit("UniProtKB").alias("resource"), c.alias("identifier"))).alias("external-identifier")).alias("external-identifiers"))).alias("polypeptide")
    )
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("P"), "l_partkey").alias("p"), "l_linenumber")
    # Only ids are shuffled; the nested parts are made from them behind it.
    held = li.groupBy("o_orderkey").agg(F.collect_list(F.struct("p")).alias("ps"))
    targets = held.select(
        "o_orderkey", F.transform("ps", lambda x: part(x["p"])).alias("t"), F.array_distinct(F.transform("ps", lambda x: F.struct(F.concat(F.lit("brand "), x["p"]).alias("name")))).alias("pr")
    )
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    prop = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    ident = lambda resource, value: F.struct(F.lit(resource).alias("resource"), value.alias("identifier"))
    rec = T.table(spark, sf, "orders").join(targets, "o_orderkey", "left").select(
        F.array(
            F.struct(F.lit(False).alias("_primary"), F.concat(F.lit("OLD"), key).alias("_VALUE")), F.struct(F.lit(True).alias("_primary"), F.concat(F.lit("DB"), key).alias("_VALUE"))
        ).alias("drugbank-id"),
        F.concat(F.lit("Customer "), "o_custkey").alias("name"),
        F.struct(F.col("pr").alias("product")).alias("products"),
        F.struct(F.array(F.struct(F.concat(F.lit("DB"), key + 1).alias("drugbank-id")), F.struct(F.concat(F.lit("DB"), key - 1).alias("drugbank-id"))).alias("drug-interaction")).alias("drug-interactions"),
        F.struct(F.array(prop("logP", text("o_custkey")), prop("SMILES", text("o_totalprice")), prop("SMILES", F.lit("0"))).alias("property")).alias("calculated-properties"),
        F.struct(F.array(
            ident("KEGG Drug", F.concat(F.lit("D"), key)), ident("KEGG Drug", F.concat(F.lit("E"), key)),
            F.when(key % 2 == 0, ident("PubChem Compound", F.concat(F.lit("C"), key))).otherwise(ident("PubChem Substance", F.concat(F.lit("S"), key))),
        ).alias("external-identifier")).alias("external-identifiers"),
        F.struct(F.col("t").alias("target")).alias("targets"),
        F.struct(F.array(part(F.concat(F.lit("N"), "o_custkey"))).alias("enzyme")).alias("enzymes"),
    )
    path = _new(spark)
    rec.write.format("xml").option("rowTag", "drug").option("rootTag", "drugbank").option("compression", "gzip").save(path)
    return C.read_catalog(spark, path)


@query(
    "catalog_edges",
    """SELECT DISTINCT 'DB' || l_orderkey AS src, 'P' || l_partkey AS dst, 'target' AS role FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'DB' || o_orderkey, 'N' || o_custkey, 'enzyme' FROM orders""",
)
def _(spark, sf):
    return C.catalog_edges(_catalog(spark, sf))


@query(
    "catalog_names",
    """SELECT DISTINCT 'customer ' || o_custkey AS k, 'DB' || o_orderkey AS v FROM orders UNION ALL SELECT DISTINCT 'BRAND P' || l_partkey, 'DB' || l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    return C.catalog_names(_catalog(spark, sf)).select("k", "v")


@query("catalog_property", "SELECT 'DB' || o_orderkey AS drug, o_totalprice AS value FROM orders")
def _(spark, sf):
    return C.catalog_property(_catalog(spark, sf), "SMILES").select("drug", F.col("value").cast("double").alias("value"))


@query(
    "catalog_external_ids",
    """SELECT 'DB' || o_orderkey AS drug, 'D' || o_orderkey AS kegg_drug, CAST(NULL AS VARCHAR) AS kegg_compound, CASE WHEN o_orderkey % 2 = 0 THEN 'C' || o_orderkey END AS pubchem_compound,
    CASE WHEN o_orderkey % 2 <> 0 THEN 'S' || o_orderkey END AS pubchem_substance, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'S' END || o_orderkey AS pubchem FROM orders""",
)
def _(spark, sf):
    return C.catalog_external_ids(_catalog(spark, sf))


@query("catalog_ddi", "SELECT DISTINCT least('DB' || o_orderkey, 'DB' || o) AS src, greatest('DB' || o_orderkey, 'DB' || o) AS dst FROM (SELECT o_orderkey, unnest([o_orderkey + 1, o_orderkey - 1]) AS o FROM orders)")
def _(spark, sf):
    return C.catalog_ddi(_catalog(spark, sf))


# -- matrices and maps ------------------------------------------------------

@query("read_matrix", "SELECT 'S' || s_suppkey AS a, 'N' || n_nationkey AS b, CAST(s_suppkey * 100 + n_nationkey AS DOUBLE) AS s FROM supplier, nation")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey")
    nations = [r[0] for r in T.table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    head = spark.createDataFrame([("\t".join(["", *[f"N:{n}" for n in nations]]), -1)], "line string, o long")
    line = F.concat_ws("\t", F.concat(F.lit("S:"), "s_suppkey"), *[(F.col("s_suppkey") * 100 + n).cast("string") for n in nations])
    path = _new(spark)
    head.unionByName(s.select(line.alias("line"), F.col("s_suppkey").alias("o"))).repartitionByRange("o").sortWithinPartitions("o").select("line").write.text(path)
    return R.read_matrix(spark, path)


@query(
    "write_matrix",
    "SELECT 'D' || user_id AS id, string_agg(CAST(CAST(t = ANY(had) AS INTEGER) AS VARCHAR), ' ' ORDER BY t) AS line FROM (SELECT user_id, list(DISTINCT event_type) AS had FROM events GROUP BY 1), (SELECT DISTINCT event_type AS t FROM events) GROUP BY 1",
)
def _(spark, sf):
    e = T.table(spark, sf, "events").select(F.concat(F.lit("D"), "user_id").alias("src"), F.col("event_type").alias("dst"))
    path = _new(spark)
    ids = e.select(F.col("src").alias("id")).distinct()
    W.write_matrix(e, ids, [r[0] for r in e.select("dst").distinct().orderBy("dst").collect()], path)
    back = R.number_lines(spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("block")))
    # Line numbers against the sorted ids show the order of the rows too.
    return back.join(dense_index(ids, "id", "pos"), "pos").select("id", F.col("value").alias("line"))


@query("write_map", "SELECT DISTINCT p_name AS k, 'P' || p_partkey AS v FROM part")
def _(spark, sf):
    path = _new(spark)
    W.write_map(T.table(spark, sf, "part").select(F.col("p_name").alias("k"), F.concat(F.lit("P"), "p_partkey").alias("v")), path)
    return spark.read.schema("k string, v string").json(path)
