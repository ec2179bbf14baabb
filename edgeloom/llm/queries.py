"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .conversations import structure
from .decontaminate import contamination, verdicts
from .langid import identify, learned_from, train
from .lines import dedup_lines
from .media import read_media, store_media
from .neardup import components, fingerprints
from .packing import packed
from .sharding import sharded
from .suffixes import dedup_substrings
from .suffixtree import score
from .urlfilter import judge, rules_table
from .vectors import near_vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = " ".join(sql.split("\n"))
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op1_decontaminate", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
          FROM (SELECT item_id, w, unnest(range(1, 1 + greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
    s AS (SELECT DISTINCT n FROM g),
    p AS (SELECT doc_id, w, n, unnest(range(1, 2 + len(w) - n)) AS i FROM d, s WHERE len(w) >= n),
    m AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
    h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
           coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op1_decontaminate(spark, sf):
    found = verdicts(contamination(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark")))
    c = F.col("contamination")
    items = c["items"]
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_pack")
def op2_pack(spark, sf):
    import public_tokenizers

    return packed(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_shard")
def op8_shard(spark, sf):
    return sharded(read(spark, sf, "documents"), 8)


@query("op4_simhash")
def op4_simhash(spark, sf):
    found = components(fingerprints(read(spark, sf, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_language")
def op7_language(spark, sf):
    docs = read(spark, sf, "documents")
    models = train(docs.filter(learned_from(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op6_urls", """
    WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path FROM a),
    r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    m AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
          FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1""")
def op6_urls(spark, sf):
    return judge(read(spark, sf, "pages"), rules_table(spark, RULES))


@query("op5_media")
def op5_media(spark, sf):
    found = read_media(store_media(read(spark, sf, "documents")))
    shots = F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["first_frame"].cast("string"), c["frames"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(";"), shots).alias("feature"))


@query("op9_lines", r"""
    WITH l AS (SELECT doc_id, p - 1 AS p, list_filter(string_split_regex(string_split(text, chr(10))[p], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
               FROM (SELECT doc_id, text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS p FROM documents)),
    d AS (SELECT w, min((doc_id, p)) AS first FROM l WHERE len(w) > 0 GROUP BY w),
    n AS (SELECT first, w, len(w) AS n, unnest(range(1, 1 + len(w))) AS i FROM d WHERE len(w) >= 8),
    k AS (SELECT first, md5(array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ')) AS t, n, i FROM n),
    g AS (SELECT t, n, i, min(first) AS m FROM k GROUP BY ALL),
    s AS (SELECT first, md5(array_to_string(w, ' ')) AS t FROM d WHERE len(w) >= 8),
    q AS (SELECT k.first FROM k JOIN g USING (t, n, i) WHERE g.m < k.first UNION SELECT k.first FROM k JOIN s USING (t) WHERE s.first < k.first
          UNION SELECT s.first FROM s JOIN k USING (t) WHERE k.first < s.first),
    f AS (SELECT l.doc_id, l.p, CASE WHEN len(l.w) = 0 THEN 0 WHEN d.first <> (l.doc_id, l.p) THEN 1 WHEN q.first IS NOT NULL THEN 2 ELSE 0 END AS fate
          FROM l LEFT JOIN d ON d.w = l.w LEFT JOIN q ON q.first = d.first)
    SELECT x.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE fate = 1) AS n_exact, count(*) FILTER (WHERE fate = 2) AS n_near,
           sha256(coalesce(string_agg(string_split(x.text, chr(10))[f.p + 1], chr(10) ORDER BY f.p) FILTER (WHERE fate = 0), '')) AS kept_sha256
    FROM documents x JOIN f USING (doc_id) GROUP BY x.doc_id""")
def op9_lines(spark, sf):
    out = dedup_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op3_substrings")
def op3_substrings(spark, sf):
    return dedup_substrings(read(spark, sf, "documents"), texts=False).drop("kept")


@query("op10_lm_scores")
def op10_lm_scores(spark, sf):
    return score(read(spark, sf, "documents"))


@query("op11_alignment")
def op11_alignment(spark, sf):
    import public_tokenizers

    return align(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_conversations")
def op12_conversations(spark, sf):
    return structure(read(spark, sf, "conversations"))


@query("op13_embeddings")
def op13_embeddings(spark, sf):
    return near_vectors(read(spark, sf, "embeddings"))
