"""Scalar rules and identifier mapping on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import idmap as M
from . import tables as T
from .registry import query
from .tables import with_views

KEY = ("l_orderkey", "l_linenumber")


def _items(spark, sf, *cols):
    return T.table(spark, sf, "lineitem").select(*KEY, *cols)


@query("binarize_affinity", with_views("affinity") + "SELECT l_orderkey, l_linenumber, src, dst, y, CASE WHEN y < 30 THEN 1 ELSE 0 END AS label FROM affinity")
def _(spark, sf):
    return C.binarize(T.affinity(spark, sf).drop("dataset"), "y")


@query("positive_pairs", with_views("affinity") + "SELECT src, dst FROM affinity WHERE y < 30")
def _(spark, sf):
    return C.positives(C.binarize(T.affinity(spark, sf), "y"))


@query("parse_qualified", "SELECT l_orderkey, l_linenumber, l_quantity AS value FROM lineitem")
def _(spark, sf):
    sign = F.when(F.col("l_returnflag") == "A", ">").when(F.col("l_returnflag") == "R", "<").otherwise("")
    df = _items(spark, sf, F.concat(sign, F.col("l_quantity").cast("string")).alias("raw"))
    return df.select(*KEY, C.parse_qualified("raw").alias("value"))


@query("contains_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%hold%'")
def _(spark, sf):
    return T.table(spark, sf, "customer").filter(C.contains_ci("c_mktsegment", "Hold")).select("c_custkey", "c_mktsegment")


@query("contains_any", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%red%'")
def _(spark, sf):
    return T.table(spark, sf, "part").filter(C.contains_any("p_name", ["ring", "red"])).select("p_partkey", "p_name")


@query("drop_sentinels", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> '5-LOW'")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.drop_sentinels(o, ["o_orderstatus", "o_orderpriority"], "5-LOW")


@query("explode_multi", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(spark, sf):
    return C.explode_multi(T.table(spark, sf, "part"), "p_name", " ", "word").select("p_partkey", "word")


@query("normalize_id", "SELECT c_custkey, CAST(CAST(substr(c_name, 10) AS BIGINT) AS VARCHAR) AS id FROM customer")
def _(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select("c_custkey", C.normalize_id("c_name", r"^Customer#0*(?=\d)").alias("id"))


@query("extract_id", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS id FROM supplier")
def _(spark, sf):
    return T.table(spark, sf, "supplier").select("s_suppkey", C.extract_id("s_name", r"^Supplier#(\d+)").alias("id"))


@query(
    "clean_name",
    "SELECT p_partkey, array_to_string(list_filter(string_split(p_name || ' MG', ' '), lambda x: x NOT IN ('MG', 'ring')), ' ') AS name FROM part",
)
def _(spark, sf):
    p = T.table(spark, sf, "part")
    raw = F.concat_ws(" ", "p_name", F.concat(F.lit("("), "p_type", F.lit(")")), F.lit(","), "p_size", F.lit("MG"))
    return p.withColumn("raw", raw).select("p_partkey", C.clean_name("raw", ["MG", "ring"]).alias("name"))


@query("insert_colon", "SELECT p_partkey, 'hsa:' || p_partkey AS id, 'hsa' || p_partkey AS plain FROM part")
def _(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", C.insert_colon(F.concat(F.lit("hsa"), "p_partkey")).alias("id"))
    return p.withColumn("plain", C.remove_colon("id"))


@query("lower_names", "SELECT n_nationkey, lower(n_name) AS n_name FROM nation")
def _(spark, sf):
    return C.lower_if_string(T.table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name")


@query(
    "classify_entries",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'enzyme' WHEN list_contains(string_split(p_name, ' '), 'widget') THEN 'widget'
    WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 'ring' WHEN list_contains(string_split(p_name, ' '), 'small') THEN 'small'
    ELSE 'notAnnotated' END AS class FROM part""",
)
def _(spark, sf):
    p = T.table(spark, sf, "part").withColumn("code", F.when(F.col("p_size") > 40, F.col("p_brand")))
    return p.select("p_partkey", C.classify("code", F.split("p_name", " "), ["widget", "ring", "small"]).alias("class"))


@query("code_prefix", "SELECT p_partkey, substr(p_type, 1, 3) AS code, p_brand AS first FROM part")
def _(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select("p_partkey", C.code_prefix("p_type").alias("code"), C.first_listed(F.concat_ws("; ", "p_brand", "p_name")).alias("first"))


@query(
    "parse_duration",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 7 * 86400 + user_id % 24 * 3600 + event_id % 60 END AS seconds,
    CASE WHEN event_type = 'error' OR event_id % 7 * 86400 + user_id % 24 * 3600 + event_id % 60 = 0 THEN NULL
    ELSE round(log2(event_id % 7 * 86400 + user_id % 24 * 3600 + event_id % 60), 6) END AS log2 FROM events""",
)
def _(spark, sf):
    part = lambda c, n, u: F.concat((F.col(c) % n).cast("string"), F.lit(u))
    text = F.concat_ws(" ", part("event_id", 7, "d"), part("user_id", 24, "h"), part("event_id", 60, "s"))
    e = T.table(spark, sf, "events").withColumn("t", F.when(F.col("event_type") == "error", "OOT").otherwise(text))
    e = e.select("event_id", C.parse_duration("t").alias("seconds"))
    return e.withColumn("log2", F.round(F.when(F.col("seconds") > 0, F.log2("seconds")), 6))


@query("parse_run_name", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS last, CAST(c_nationkey AS VARCHAR) AS before, c_mktsegment AS head FROM customer")
def _(spark, sf):
    c = T.table(spark, sf, "customer").withColumn("run", F.concat_ws("_", "c_mktsegment", "c_nationkey", "c_custkey"))
    return c.select("c_custkey", *[C.run_name_part("run", k).alias(n) for k, n in ((1, "last"), (2, "before"), (3, "head"))])


@query("has_nondigit", "SELECT term FROM (SELECT unnest([c_name, CAST(c_custkey AS VARCHAR)]) AS term FROM customer) WHERE regexp_matches(term, '[^0-9]')")
def _(spark, sf):
    c = T.table(spark, sf, "customer").select(F.explode(F.array("c_name", F.col("c_custkey").cast("string"))).alias("term"))
    return c.filter(C.has_nondigit("term"))


@query("split_chain", "SELECT l_orderkey, l_linenumber, 'A' AS chain, l_linenumber AS \"start\", CAST(l_quantity AS INTEGER) AS \"end\" FROM lineitem")
def _(spark, sf):
    text = F.concat(F.lit("A/B="), "l_linenumber", F.lit("-"), F.col("l_quantity").cast("int"))
    return _items(spark, sf, C.split_chain(text).alias("c")).select(*KEY, "c.*")


@query("strip_unit", "SELECT event_id, value FROM events")
def _(spark, sf):
    return T.table(spark, sf, "events").select("event_id", C.strip_unit(F.concat(F.col("value").cast("string"), F.lit(" A"))).alias("value"))


@query(
    "dataset_of",
    "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE 'https%' THEN 'secure' ELSE 'other' END AS dataset FROM pages",
)
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", C.dataset_of("url", [("/en/", "english"), ("^https", "secure")], "other").alias("dataset"))


@query("indicator", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS bit FROM lineitem")
def _(spark, sf):
    return _items(spark, sf, C.indicator("l_discount").alias("bit"))


@query("score_arithmetic", "SELECT l_orderkey, l_linenumber, round(0.9 * exp(-l_tax), 6) AS e, round(abs(l_tax - l_discount), 4) AS d, round((l_tax - l_discount) * (l_tax - l_discount), 6) AS sq FROM lineitem")
def _(spark, sf):
    d = F.col("l_tax") - F.col("l_discount")
    return _items(spark, sf, F.round(C.exp_kernel("l_tax", 0.9), 6).alias("e"), F.round(F.abs(d), 4).alias("d"), F.round(d * d, 6).alias("sq"))


@query("json_field", "SELECT p_partkey, p_brand AS code, lower(p_type) AS names FROM part")
def _(spark, sf):
    record = F.to_json(
        F.struct(
            F.array("p_brand", "p_name").alias("codes"),
            F.array(
                F.struct(F.lit("kind").alias("category"), F.col("p_type").alias("name")), F.struct(F.lit("size").alias("category"), F.col("p_size").cast("string").alias("name"))
            ).alias("keywords"),
        )
    )
    e = T.table(spark, sf, "part").select("p_partkey", C.parse_entry_json(record).alias("e"))
    return e.select("p_partkey", F.col("e.codes")[0].alias("code"), F.array_join(C.keyword_names("e", "kind"), ",").alias("names"))


@query("extract_synonyms", "SELECT p_partkey, unnest([p_name, p_brand]) AS synonym FROM part")
def _(spark, sf):
    text = F.concat(F.lit("name ["), "p_name", F.lit("]; brand ["), "p_brand", F.lit("]"))
    return C.extract_synonyms(T.table(spark, sf, "part").select("p_partkey", text.alias("t")), "t", r"\[(.*?)\]").select("p_partkey", "synonym")


# -- identifier mapping -----------------------------------------------------

def _customer_map(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("ord"))


for _keep, _agg in (("first", "min"), ("last", "max")):

    @query(
        f"map_ids_{_keep}",
        f"SELECT s_suppkey, m.v AS id FROM supplier LEFT JOIN (SELECT c_nationkey AS k, arg_{_agg}(c_name, c_custkey) AS v FROM customer GROUP BY 1) m ON s_nationkey = k",
    )
    def _(spark, sf, keep=_keep):
        return M.map_ids(T.table(spark, sf, "supplier"), "s_nationkey", _customer_map(spark, sf), keep, "id").select("s_suppkey", "id")


def _supplier_nation(spark, sf):
    return T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))


def _nation_name(spark, sf):
    return T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))


@query("compose_maps", "SELECT s_suppkey AS k, n_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    return M.compose_maps(_supplier_nation(spark, sf), _nation_name(spark, sf))


@query(
    "map_cascade",
    """SELECT p_partkey, COALESCE(CASE WHEN p_size > 25 THEN p_name END, n_name, p_brand) AS id FROM part
    LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, sf):
    p = T.table(spark, sf, "part")
    direct = p.filter("p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    hops = M.compose_maps(_supplier_nation(spark, sf), _nation_name(spark, sf))
    names = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    return M.map_cascade(p.select("p_partkey"), "p_partkey", [direct, hops, names], "id")


for _mode, _value in (("coalesce", "COALESCE(b.n_name, a.n_name)"), ("reference", "b.n_name")):

    @query(
        f"map_two_keys_{_mode}",
        f"""SELECT c_custkey, {_value} AS id FROM customer LEFT JOIN nation a ON c_nationkey = a.n_nationkey
        LEFT JOIN nation b ON c_custkey % 50 = b.n_nationkey""",
    )
    def _(spark, sf, mode=_mode):
        c = T.table(spark, sf, "customer").withColumn("k2", F.col("c_custkey") % 50)
        return M.map_two_keys(c, "c_nationkey", "k2", _nation_name(spark, sf), "id", mode).select("c_custkey", "id")


@query(
    "restrict_universe",
    with_views("inter") + "SELECT src, dst FROM inter WHERE dst IN (SELECT 'T'||p_partkey FROM part WHERE p_size > 40)",
)
def _(spark, sf):
    u = T.table(spark, sf, "part").filter("p_size > 40").select(F.concat(F.lit("T"), "p_partkey").alias("id"))
    return M.restrict(T.interactions(spark, sf), "dst", u, "id")


@query(
    "match_names",
    """WITH n AS (SELECT DISTINCT p_partkey AS "case", CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' 5MG' END AS name, p_name AS clean FROM part),
    d AS (SELECT p_name AS name, max(p_type) AS id FROM part GROUP BY 1)
    SELECT DISTINCT "case", CASE WHEN a.id IS NOT NULL THEN n.name ELSE n.clean END AS name, COALESCE(a.id, b.id) AS id
    FROM n LEFT JOIN d a ON n.name = a.name LEFT JOIN d b ON n.clean = b.name WHERE COALESCE(a.id, b.id) IS NOT NULL""",
)
def _(spark, sf):
    p = T.table(spark, sf, "part")
    raw = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" 5MG")))
    names = p.select(F.col("p_partkey").alias("case"), raw.alias("name"))
    words = p.select(F.col("p_name").alias("name"), F.col("p_type").alias("id"))
    return M.match_names(names, words, C.clean_name("name", ["MG"]))
