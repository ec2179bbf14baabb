"""The pipeline, stage by stage, against plain versions; registered queries against their SQL."""

import brute
import corpus_pipeline
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F
from test_media_urls_packing import checked

from edgeloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _stages(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, sf))
        yield name, before, docs


def _texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("odd_rows", [False, True])
def test_stages(spark, odd, tmp_path, odd_rows):
    sf = str(tmp_path) if odd_rows else SF
    if odd_rows:
        spark.createDataFrame([(1, odd[0][3][1][:60]), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = odd[1] if odd_rows else spark.read.parquet(f"{SF}/documents.parquet")
    for name, before, after in _stages(spark, docs, sf):
        rows = _texts(before)
        if name != "packing":
            assert after.columns == docs.columns
        if name == "language":
            assert brute.rows_of(after, "doc_id", "text") == sorted(((i, t) for i, t in rows if any(c.isalpha() for c in t or "")), key=str)
        elif name == "lines":
            order = {r[0]: r[1] for r in before.select("text", F.xxhash64("text")).collect()}
            want = [(i, t, len(t)) for i, t, _, a, b in brute.lines(rows, order.get) if not a + b or t.strip(" \t\n\r\x0b\x0c")]
            assert brute.rows_of(after, "doc_id", "text", "n_chars") == sorted(want, key=str)
        elif name == "near_duplicates":
            groups = {(i, f): g for i, f, g in brute.components([(i, brute.simhash(t)) for i, t in rows])}
            assert brute.rows_of(after, "doc_id", "text") == sorted(((i, t) for i, t in rows if i is None or groups[i, brute.simhash(t)] == i), key=str)
        elif name == "decontaminated":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {x[0] for x in brute.contamination(rows, items) if x[5]}
            assert brute.rows_of(after, "doc_id", "text") == sorted(((i, t) for i, t in rows if i not in bad), key=str)
        else:
            sequences, tokens = checked(after, rows, 2048)
            assert sequences <= -(-tokens // 2048) + 2


def test_run_is_its_stages(spark):
    *_, last = _stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert brute.rows_of(corpus_pipeline.run(spark, SF), *same) == brute.rows_of(last[2], *same)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    error, _ = compare(spark, connect(SF), QUERIES[name], ORACLES.get(name), SF)
    assert error is None


def test_near_duplicates_judges_rows_of_one_id_each_by_its_text(spark):
    from edgeloom.llm.neardup import keep_one

    rows = [(1, "one two three four five"), (5, "one two three four five"), (5, "quite another text of seven words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == [rows[0], rows[2]]


def test_decontamination_returns_clashing_columns_untouched(spark):
    from edgeloom.llm.decontaminate import decontaminate

    docs = spark.createDataFrame([(1, "a b c", "x", 7), (2, "k l m", "y", 8)], "doc_id long, text string, contaminated string, contamination int")
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate(docs, items).collect()] == [(2, "k l m", "y", 8)]
    assert sorted(tuple(r) for r in decontaminate(docs, items, mode="spans").collect()) == [(1, "", "x", 7), (2, "k l m", "y", 8)]


def test_stages_of_empty_tables(spark, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.collect() == []
