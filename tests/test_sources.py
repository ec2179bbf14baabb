import os

import pytest
from pyspark.sql import functions as F

from edgeloom.operators.edges import split_by_source
from edgeloom.operators.idmap import reduce_map
from edgeloom.sources import catalog as C
from edgeloom.sources import readers as R
from edgeloom.sources import writers as W


def _write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_edges_with_comments_and_stray_header(spark, tmp_path):
    p = _write(tmp_path / "e.tsv", "# comment\nDrug\tGene\nD1\tT1\nD1\tT1\nDrug\tGene\nD2\tT1\n")
    assert _rows(R.read_edges(spark, p, skip_values=["Drug"]), "src", "dst") == [("D1", "T1"), ("D2", "T1")]


def test_table_with_column_subset(spark, tmp_path):
    p = _write(tmp_path / "t.csv", "# c\na,1,x\nb,2,y\n")
    df = R.read_table(spark, p, ["k", "n", "v"], usecols=["k", "v"], sep=",", comment="#")
    assert _rows(df, "k", "v") == [("a", "x"), ("b", "y")]
    assert "n" not in df.columns


def test_quarterly_reports(spark, tmp_path):
    _write(tmp_path / "aers_2005q1" / "ascii" / "REAC05Q1.TXT", "ISR$PT\n1$Nausea$\n2$Rash$\n")
    _write(tmp_path / "faers_2013q4" / "asc" / "reac13q4.txt", "primaryid$caseid$pt$drug_rec_act\n10$1$Fever$$\n")
    _write(tmp_path / "aers_2005q1" / "ascii" / "DRUG05Q1.TXT", "ISR$DRUG_SEQ$ROLE_COD$DRUGNAME\n1$7$PS$CAFÉ$x\n2$8$C$OTHER$x\n", "latin-1")
    _write(tmp_path / "faers_2013q4" / "asc" / "drug13q4.txt", "primaryid$caseid$drug_seq$role_cod$drugname\n10$1$1$SS$ASPIRIN$x\n", "latin-1")
    ev = R.report_events(R.read_quarterly(spark, str(tmp_path), "REAC"))
    assert _rows(ev, "year", "quarter", "case", "term") == [(2005, 1, "1", "NAUSEA"), (2005, 1, "2", "RASH"), (2013, 4, "10", "FEVER")]
    roles = R.report_roles(R.read_quarterly(spark, str(tmp_path), "DRUG"))
    assert _rows(roles, "year", "case", "role", "name") == [(2005, "1", "PS", "CAFÉ"), (2013, "10", "SS", "ASPIRIN")]


def test_event_arity(spark):
    df = spark.createDataFrame([(["1", "Rash", ""],), (["2", "9", "Fever", "x"],), (["3"],)], "fields array<string>")
    assert _rows(R.report_events(df), "case", "term") == [("1", "RASH"), ("2", "FEVER")]


def test_fasta_joins_wrapped_lines(spark, tmp_path):
    p = _write(tmp_path / "s.fasta", ">P1 x\nMKV\nLLA\n>P2\nAAA\n")
    assert _rows(R.read_fasta(spark, p), "id", "seq") == [("P1 x", "MKVLLA"), ("P2", "AAA")]


def test_embeddings_skip_the_count_line(spark, tmp_path):
    p = _write(tmp_path / "e.txt", "2 3\na 1 2 3\nb 0.5 -1 0\n")
    assert _rows(R.read_embeddings(spark, p), "id", "vec") == [("a", [1.0, 2.0, 3.0]), ("b", [0.5, -1.0, 0.0])]


def test_matrix_labelled_and_not(spark, tmp_path):
    p = _write(tmp_path / "m.tsv", "\thsa:1\thsa:2\nhsa:1\t1.0\t0.5\nhsa:2\t0.25\t1.0\n")
    want = [("hsa1", "hsa1", 1.0), ("hsa1", "hsa2", 0.5), ("hsa2", "hsa1", 0.25), ("hsa2", "hsa2", 1.0)]
    assert _rows(R.read_matrix(spark, p), "a", "b", "s") == want
    p = _write(tmp_path / "n.txt", "1.0 0.5\n0.25 1.0\n")
    names = spark.createDataFrame([(0, "hsa:1"), (1, "hsa:2")], "pos long, id string")
    assert _rows(R.read_matrix(spark, p, sep=" ", labels=["hsa:1", "hsa:2"], row_names=names), "a", "b", "s") == want


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    p = _write(tmp_path / "l.txt", "".join(f"line{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = R.number_lines(spark.read.text(p).select("value", F.col("_metadata.file_block_start").alias("block")))
        assert sorted((r.pos, r.value) for r in df.collect()) == [(i, f"line{i}") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_runs_are_tagged(spark, tmp_path):
    _write(tmp_path / "r" / "net_d32_s1.tsv", "auc\taupr\n0.5\t0.4\n")
    _write(tmp_path / "r" / "net_d64_s1.tsv", "auc\taupr\n0.7\t0.6\n")
    df = R.read_runs(spark, str(tmp_path / "r" / "*.tsv"), "auc double, aupr double")
    assert _rows(df, "run", "auc") == [("net_d32_s1", 0.5), ("net_d64_s1", 0.7)]


CATALOG = """<?xml version="1.0"?>
<drugbank>
<drug type="x"><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>OLD1</drugbank-id><name>Alpha</name>
 <products><product><name>Brand a</name></product></products>
 <drug-interactions><drug-interaction><drugbank-id>DB2</drugbank-id></drug-interaction></drug-interactions>
 <calculated-properties><property><kind>logP</kind><value>1</value></property><property><kind>SMILES</kind><value>CCO</value></property></calculated-properties>
 <external-identifiers><external-identifier><resource>KEGG Drug</resource><identifier>D01</identifier></external-identifier>
 <external-identifier><resource>PubChem Substance</resource><identifier>S9</identifier></external-identifier></external-identifiers>
 <targets><target><polypeptide id="P1"><external-identifiers><external-identifier><resource>UniProtKB</resource><identifier>P1</identifier></external-identifier></external-identifiers></polypeptide></target>
 <target><name>no protein</name></target></targets>
 <enzymes><enzyme><polypeptide id="P2"><external-identifiers><external-identifier><resource>UniProtKB</resource><identifier>P2</identifier></external-identifier></external-identifiers></polypeptide></enzyme>
 <enzyme><name>without id</name></enzyme></enzymes></drug>
<drug type="x"><drugbank-id primary="true">DB2</drugbank-id><name>alpha</name>
 <drug-interactions><drug-interaction><drugbank-id>DB1</drugbank-id></drug-interaction></drug-interactions><targets></targets></drug>
</drugbank>
"""


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return C.read_catalog(spark, _write(tmp_path_factory.mktemp("cat") / "c.xml", CATALOG))


def test_catalog(catalog):
    assert _rows(catalog, "drug") == [("DB1",), ("DB2",)]
    assert _rows(C.catalog_edges(catalog), "src", "dst", "role") == [("DB1", "P1", "target"), ("DB1", "P2", "enzyme")]
    assert _rows(C.catalog_edges(catalog, roles=["target"]), "src", "dst") == [("DB1", "P1")]
    ids = {r.drug: r for r in C.catalog_external_ids(catalog).collect()}
    assert ids["DB1"].kegg_drug == "D01" and ids["DB1"].pubchem == "S9" and ids["DB2"].pubchem is None
    names = {r.k: r.v for r in reduce_map(C.catalog_names(catalog), "last").collect()}
    assert names == {"alpha": "DB2", "BRAND A": "DB1"}
    assert _rows(C.catalog_property(catalog, "SMILES"), "drug", "value") == [("DB1", "CCO")]
    assert _rows(C.catalog_ddi(catalog), "src", "dst") == [("DB1", "DB2")]


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "src string, dst string")
    W.write_edges(e, str(tmp_path / "edges"))
    assert _rows(R.read_edges(spark, str(tmp_path / "edges")), "src", "dst") == [("a", "x"), ("b", "x"), ("b", "y")]
    W.write_matrix(e, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), ["x", "y"], str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["0 0", "1 0", "1 1"]
    W.write_map(spark.createDataFrame([("k", "v")], "k string, v string"), str(tmp_path / "map"))
    assert [tuple(r) for r in spark.read.schema("k string, v string").json(str(tmp_path / "map")).collect()] == [("k", "v")]
    folds = e.withColumn("seed", F.lit(0)).withColumn("fold", F.when(F.col("src") == "a", 0).otherwise(1))
    W.write_folds(folds, str(tmp_path / "folds"))
    assert os.path.isdir(tmp_path / "folds" / "seed=0" / "fold=1")
    tagged = split_by_source(e.withColumn("text", F.concat("src", "dst")), "text", ["a", "x"])
    assert _rows(tagged, "src", "dst", "tag") == [("a", "x", "a"), ("a", "x", "x"), ("b", "x", "x")]
    W.write_tagged(tagged, str(tmp_path / "tags"))
    assert sorted(d for d in os.listdir(tmp_path / "tags") if d.startswith("tag=")) == ["tag=a", "tag=x"]


def test_matrix_queries_without_a_single_task(spark, monkeypatch, tmp_path):
    """Rows are written by range and numbered over ranges; several files are read in their order."""
    from edgeloom.plans import QUERIES, files

    path = str(tmp_path / "matrix")
    monkeypatch.setattr(files, "_new", lambda _: path)
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        cells = QUERIES["read_matrix"](spark, "/root/testdata/sf0.01")
        assert sum(f.startswith("part-") for f in os.listdir(path)) > 1
        right = F.concat(F.regexp_replace("a", "^S", ""), F.lpad(F.regexp_replace("b", "^N", ""), 2, "0")).cast("double")
        assert cells.filter(F.col("s") != right).count() == 0 and cells.count() == cells.select("a", "b").distinct().count() == 100 * 25
        path = str(tmp_path / "events")
        lines = QUERIES["write_matrix"](spark, "/root/testdata/sf0.001")
        assert "row_number" not in lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(adaptive, before)


def test_catalogue_of_orders_is_compressed_and_whole(spark, tmp_path):
    from edgeloom.plans import files

    spark.createDataFrame([(1, 7, 10.5), (2, 7, 3.0), (3, 8, 1.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 1), (1, 5, 2), (1, None, 3), (2, 6, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = files._catalog(spark, str(tmp_path))
    assert all(f.endswith(".gz") for f in c.inputFiles())
    assert _rows(C.catalog_names(c), "k", "v") == [("BRAND P5", "DB1"), ("BRAND P6", "DB2"), ("customer 7", "DB1"), ("customer 7", "DB2"), ("customer 8", "DB3")]
    assert _rows(C.catalog_edges(c, roles=["target"]).filter("dst IS NOT NULL"), "src", "dst") == [("DB1", "P5"), ("DB2", "P6")]
    assert _rows(C.catalog_ddi(c), "src", "dst") == [("DB0", "DB1"), ("DB1", "DB2"), ("DB2", "DB3"), ("DB3", "DB4")]
