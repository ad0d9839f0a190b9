"""Queries over the driver's tables for every family of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill import schemas
from inkmill.functions import predicates as P
from inkmill.functions.text import canonical, collapse_ws, estimate_tokens, normalize_query, upload_failure
from inkmill.operators import embed, versions
from inkmill.operators import relational as R
from inkmill.operators.markdown import keep_indexable, normalize, parse_blocks
from inkmill.plans import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}

CUSTOMER_NATION = R.Edge("nation", "c_nationkey", "n_nationkey")
NATION_REGION = R.Edge("region", "n_regionkey", "r_regionkey")
ORDER_CUSTOMER = R.Edge("customer", "o_custkey", "c_custkey")
LINE_ORDER = R.Edge("order", "l_orderkey", "o_orderkey")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text: canonical form, checks, estimates.

_ESTIMATE = r"""CAST(ceil((15 * length({c}) - 15 * length(regexp_replace({c}, '[^\t-\r\x{{85}}\p{{Z}}]', '', 'g')) - 12 * length(regexp_replace({c}, '[^A-Za-z0-9!"#%&''()*,\-./:;?@\[\\\]_{{}}]', '', 'g'))) / 10.0) AS INTEGER)"""


@query("SELECT lang, count(*) AS docs, count(DISTINCT sha256(text)) AS hashes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS source_bytes, CAST(sum(" + _ESTIMATE.format(c="text") + ") AS BIGINT) AS tokens FROM documents GROUP BY lang")
def es_tokens_by_lang(t):
    text = canonical(F.col("text"))
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("docs"), F.countDistinct(F.sha2(text, 256)).alias("hashes"), F.sum(F.octet_length(text).cast("long")).alias("source_bytes"), F.sum(estimate_tokens(text).cast("long")).alias("tokens")
    )


@query(r"SELECT doc_id, sha256(c) AS content_hash, CAST(octet_length(encode(c)) AS BIGINT) AS source_bytes FROM (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN chr(65279) || text || chr(13) || chr(10) WHEN doc_id % 3 = 1 THEN text || chr(13) || 'x' ELSE text END, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') AS c FROM documents)")
def b_canonical_hash(t):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("﻿"), "text", F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\rx"))).otherwise(F.col("text"))
    c = canonical(raw)
    return t.documents.select("doc_id", F.sha2(c, 256).alias("content_hash"), F.octet_length(c).cast("long").alias("source_bytes"))


@query(
    r"""SELECT doc_id, CASE
  WHEN NOT coalesce(regexp_full_match(regexp_replace(key, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g'), '[\p{L}\p{Nd}._/-]{1,128}'), false) THEN 'INVALID_DOCUMENT_KEY'
  WHEN trim(name) = '' THEN 'FILE_REQUIRED'
  WHEN NOT (lower(trim(name)) LIKE '%.md' OR lower(trim(name)) LIKE '%.markdown') THEN 'UNSUPPORTED_FILE_TYPE'
  WHEN octet_length(encode(body)) > 20000 THEN 'FILE_TOO_LARGE'
  WHEN regexp_full_match(body, '[\t-\r\x{85}\p{Z}]*') THEN 'EMPTY_DOCUMENT' END AS failure_code
FROM (SELECT doc_id,
  CASE doc_id % 11 WHEN 1 THEN 'has space' WHEN 2 THEN 'bad!' WHEN 3 THEN repeat('a', 129) WHEN 4 THEN '' WHEN 5 THEN ' 商品/iphone-16_pro ' ELSE 'doc/' || doc_id END AS key,
  CASE doc_id % 7 WHEN 1 THEN 'a.txt' WHEN 2 THEN '  ' WHEN 3 THEN 'CATALOG.MD' WHEN 4 THEN 'x.markdown' ELSE 'a.md' END AS name,
  CASE WHEN doc_id % 13 = 1 THEN ' ' || chr(10) ELSE text END AS body FROM documents)"""
)
def b_validate_codes(t):
    k, n = F.col("doc_id") % 11, F.col("doc_id") % 7
    key = F.when(k == 1, "has space").when(k == 2, "bad!").when(k == 3, "a" * 129).when(k == 4, "").when(k == 5, " 商品/iphone-16_pro ").otherwise(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    name = F.when(n == 1, "a.txt").when(n == 2, "  ").when(n == 3, "CATALOG.MD").when(n == 4, "x.markdown").otherwise("a.md")
    body = F.when(F.col("doc_id") % 13 == 1, " \n").otherwise(F.col("text")).cast("binary")
    return t.documents.select("doc_id", upload_failure(key, name, body, 20000).alias("failure_code"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\t-\r\x{85}\p{Z}]+', ' ', 'g')) AS content FROM documents")
def n_collapse_ws(t):
    return t.documents.select("doc_id", collapse_ws(F.col("text")).alias("content"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '\n$', '') AS code FROM pages")
def n_code_text(t):
    from inkmill.functions.text import code_text

    return t.pages.select("page_id", code_text(F.col("html")).alias("code"))


@query("SELECT conv_id, turn, trim(text) AS query, 'skeleton' AS stage FROM conversations WHERE trim(text) <> ''")
def a_agent_query(t):
    q = normalize_query(F.col("text"))
    return t.conversations.select("conv_id", "turn", q.alias("query"), F.lit("skeleton").alias("stage")).where("query is not null")


# Versions. Orders stand for a document's versions, customers for documents.

_VERSIONS = """vers AS (
  SELECT o_orderkey AS id, o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version,
    sha256(CAST(o_orderkey % 7 AS VARCHAR)) AS content_hash,
    CASE o_orderkey % 17 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    CASE o_orderkey % 17 WHEN 0 THEN 'QUEUED' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'PARSING' ELSE 'STORING' END WHEN 4 THEN 'CHUNKING' ELSE 'COMPLETED' END AS stage
  FROM orders
), docs AS (
  SELECT c_custkey AS id, c_name AS document_key, CAST(coalesce(max(CASE WHEN status = 'SUCCEEDED' THEN version END), 0) AS INTEGER) AS current_version
  FROM customer LEFT JOIN vers ON document_id = c_custkey GROUP BY c_custkey, c_name
)"""


def _versions(t) -> DataFrame:
    from pyspark.sql import Window

    m = F.col("o_orderkey") % 17
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("document_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("version"),
        F.sha2((F.col("o_orderkey") % 7).cast("string"), 256).alias("content_hash"),
        F.when(m == 0, "QUEUED").when(m == 1, "RUNNING").when(m == 4, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(m == 0, "QUEUED").when(m == 1, F.when(F.col("o_orderkey") % 3 == 0, "PARSING").otherwise("STORING")).when(m == 4, "CHUNKING").otherwise("COMPLETED").alias("stage"),
    )


def _documents(t) -> DataFrame:
    top = _versions(t).where("status = 'SUCCEEDED'").groupBy("document_id").agg(F.max("version").alias("top"))
    return t.customer.join(top, F.col("c_custkey") == F.col("document_id"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("document_key"), F.coalesce("top", F.lit(0)).alias("current_version"))


@query("SELECT doc_id, content_hash, source_bytes FROM (SELECT doc_id, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS source_bytes, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d_dedup_first(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text").cast("long")).alias("source_bytes"))


@query(
    "WITH "
    + _VERSIONS
    + """, sub AS (SELECT c_name AS document_key, sha256(CAST(c_custkey % 7 AS VARCHAR)) AS content_hash FROM customer UNION ALL SELECT 'new/' || c_custkey, sha256('new') FROM customer WHERE c_custkey % 10 = 0),
live AS (SELECT d.document_key, v.version, v.content_hash, v.status, d.current_version FROM vers v JOIN docs d ON v.document_id = d.id WHERE v.version = d.current_version OR v.status IN ('QUEUED', 'RUNNING'))
SELECT document_key, content_hash, CASE WHEN same IS NOT NULL OR running IS NOT NULL THEN 'REUSE' WHEN busy THEN 'CONFLICT' ELSE 'CREATE' END AS decision, coalesce(same, running) AS reused_version
FROM (SELECT s.document_key, s.content_hash,
  (SELECT max(version) FROM live l WHERE l.document_key = s.document_key AND l.content_hash = s.content_hash AND l.version = l.current_version) AS same,
  (SELECT max(version) FROM live l WHERE l.document_key = s.document_key AND l.content_hash = s.content_hash AND l.status IN ('QUEUED', 'RUNNING')) AS running,
  EXISTS (SELECT 1 FROM live l WHERE l.document_key = s.document_key AND l.status IN ('QUEUED', 'RUNNING')) AS busy FROM sub s)"""
)
def d_decide(t):
    sub = t.customer.select(F.col("c_name").alias("document_key"), F.sha2((F.col("c_custkey") % 7).cast("string"), 256).alias("content_hash"))
    new = t.customer.where("c_custkey % 10 = 0").select(F.concat(F.lit("new/"), F.col("c_custkey").cast("string")).alias("document_key"), F.sha2(F.lit("new"), 256).alias("content_hash"))
    return versions.decide(sub.unionByName(new), _documents(t), _versions(t))


@query("WITH " + _VERSIONS + " SELECT d.id AS document_id, CAST(greatest(d.current_version, coalesce((SELECT max(version) FROM vers v WHERE v.document_id = d.id), 0)) + 1 AS INTEGER) AS next_version FROM docs d")
def d_next_version(t):
    return versions.next_versions(_documents(t), _versions(t))


@query(
    "WITH "
    + _VERSIONS
    + """, req AS (SELECT CAST(o_orderkey AS VARCHAR) AS ingestion_id, CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS to_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'PARSING' WHEN 1 THEN 'FILTERING' WHEN 2 THEN 'FILTERING' ELSE 'STORING' END AS to_stage FROM orders
  UNION ALL SELECT 'none-' || n_nationkey, 'RUNNING', 'PARSING' FROM nation),
tr(fs, fg, ts, tg) AS (VALUES ('QUEUED','QUEUED','RUNNING','PARSING'),('RUNNING','PARSING','RUNNING','FILTERING'),('RUNNING','FILTERING','RUNNING','NORMALIZING'),('RUNNING','NORMALIZING','RUNNING','CHUNKING'),('RUNNING','CHUNKING','RUNNING','EMBEDDING'),('RUNNING','EMBEDDING','RUNNING','STORING'))
SELECT r.ingestion_id, r.to_status, r.to_stage, CASE WHEN NOT EXISTS (SELECT 1 FROM tr WHERE ts = to_status AND tg = to_stage) THEN 'INVALID_INGESTION_STATE' WHEN v.id IS NULL THEN 'INGESTION_NOT_FOUND'
  WHEN EXISTS (SELECT 1 FROM tr WHERE ts = to_status AND tg = to_stage AND fs = v.status AND fg = v.stage) THEN 'OK' ELSE 'INVALID_INGESTION_STATE' END AS outcome
FROM req r LEFT JOIN vers v ON CAST(v.id AS VARCHAR) = r.ingestion_id"""
)
def d_transition_check(t):
    k = F.col("o_orderkey")
    m = k % 4
    req = t.orders.select(k.cast("string").alias("ingestion_id"), F.when(k % 2 == 0, "RUNNING").otherwise("SUCCEEDED").alias("to_status"), F.when(m == 0, "PARSING").when(m == 1, "FILTERING").when(m == 2, "FILTERING").otherwise("STORING").alias("to_stage"))
    none = t.nation.select(F.concat(F.lit("none-"), F.col("n_nationkey").cast("string")).alias("ingestion_id"), F.lit("RUNNING").alias("to_status"), F.lit("PARSING").alias("to_stage"))
    have = _versions(t).withColumn("ingestion_id", F.col("id").cast("string"))
    return versions.check_transitions(req.unionByName(none), have)


_ACTIVATE = (
    _VERSIONS
    + """, ok AS (SELECT v.* FROM vers v JOIN docs d ON v.document_id = d.id WHERE v.status = 'RUNNING' AND v.stage = 'STORING' AND d.current_version < v.version
  AND v.version = (SELECT max(version) FROM vers x WHERE x.document_id = v.document_id) AND (SELECT count(*) FROM vers x WHERE x.document_id = v.document_id AND x.status IN ('QUEUED', 'RUNNING')) = 1)"""
)


def _activated(t):
    now = F.lit("2026-07-23 01:02:03").cast("timestamp")
    stamps = {"updated_at": now, "completed_at": F.lit(None).cast("timestamp"), "chunk_count": F.lit(0), "embedded_chunk_count": F.lit(0)}
    lines = t.lineitem.select(F.col("l_orderkey").alias("document_version_id"), F.col("l_linenumber").alias("chunk_index"))
    vers = _versions(t).withColumns(stamps)
    storing = vers.where("status = 'RUNNING' and stage = 'STORING'").select("id")
    new = lines.join(storing, F.col("document_version_id") == F.col("id"), "left_semi")
    old = lines.join(storing, F.col("document_version_id") == F.col("id"), "left_anti")
    return versions.activate(_documents(t).withColumn("updated_at", now), vers, old, new, now)


@query("WITH " + _ACTIVATE + ", oks AS (SELECT * FROM ok WHERE id IN (SELECT l_orderkey FROM lineitem)) SELECT v.id, v.document_id, v.version, CASE WHEN o.id IS NULL THEN v.status ELSE 'SUCCEEDED' END AS status, CASE WHEN o.id IS NULL THEN v.stage ELSE 'COMPLETED' END AS stage FROM vers v LEFT JOIN oks o ON o.document_id = v.document_id WHERE o.id IS NULL OR o.id = v.id")
def d_activate(t):
    return _activated(t)[1].select("id", "document_id", "version", "status", "stage")


@query(
    "WITH "
    + _ACTIVATE
    + """, oks AS (SELECT * FROM ok WHERE id IN (SELECT l_orderkey FROM lineitem)), kept AS (SELECT v.id FROM vers v LEFT JOIN oks o ON o.document_id = v.document_id WHERE o.id IS NULL OR o.id = v.id),
storing AS (SELECT id FROM vers WHERE status = 'RUNNING' AND stage = 'STORING')
SELECT l_orderkey AS document_version_id, l_linenumber AS chunk_index FROM lineitem WHERE l_orderkey IN (SELECT id FROM kept) AND (l_orderkey NOT IN (SELECT id FROM storing) OR l_orderkey IN (SELECT id FROM oks))"""
)
def d_activate_chunks(t):
    return _activated(t)[2]


@query("WITH " + _VERSIONS + " SELECT v.id, d.document_key, v.version, v.status, CASE WHEN v.status = 'FAILED' THEN 'DOCUMENT_SPLIT_FAILED' END AS failure_code FROM vers v JOIN docs d ON d.id = v.document_id")
def d_task_view(t):
    none = F.lit(None)
    vers = _versions(t).withColumns(
        {
            "ingestion_id": F.col("id").cast("string"),
            "failure_code": F.when(F.col("status") == "FAILED", "DOCUMENT_SPLIT_FAILED"),
            "failure_message": none.cast("string"),
            "source_bytes": none.cast("long"),
            "chunk_count": none.cast("int"),
            "embedded_chunk_count": none.cast("int"),
            "created_at": none.cast("timestamp"),
            "updated_at": none.cast("timestamp"),
            "completed_at": none.cast("timestamp"),
        }
    )
    view = versions.task_view(vers, _documents(t))
    return view.select(F.col("ingestion_id").cast("long").alias("id"), "document_key", "version", "status", F.col("failure.code").alias("failure_code"))


@query(
    "SELECT code, http_status, failure_text FROM (VALUES "
    + ", ".join(f"('{c}', {s}, '{schemas.FAILURE_TEXT.get(c, schemas.FAILURE_TEXT['INTERNAL_PROCESSING_ERROR'])}', '{c if c in schemas.FAILURE_TEXT else 'INTERNAL_PROCESSING_ERROR'}')" for c, s in schemas.HTTP_STATUS.items())
    + ") v(code, http_status, failure_text, stored)"
)
def d_failure_map(t):
    codes = t.spark.createDataFrame([(c,) for c in schemas.HTTP_STATUS], "code STRING")
    return codes.select("code", versions.http_status(F.col("code")).alias("http_status"), versions.failure_text(versions.classify_failure(F.col("code"))).alias("failure_text"))


@query("WITH " + _VERSIONS + " SELECT id, CASE WHEN status IN ('QUEUED', 'RUNNING') AND id % 2 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('QUEUED', 'RUNNING') AND id % 2 = 0 THEN 'EMBEDDING_FAILED' END AS failure_code FROM vers")
def d_mark_failed(t):
    now = F.lit("2026-07-23 01:02:03").cast("timestamp")
    none = F.lit(None)
    vers = _versions(t).withColumns({"ingestion_id": F.col("id").cast("string"), "failure_code": none.cast("string"), "failure_message": none.cast("string"), "completed_at": none.cast("timestamp"), "updated_at": now})
    fails = _versions(t).where("id % 2 = 0").select(F.col("id").cast("string").alias("ingestion_id"), F.lit("EMBEDDING").alias("stage"), F.lit("EMBEDDING_FAILED").alias("code"))
    return versions.mark_failed(vers, fails, now).select("id", "status", "failure_code")


@query("WITH " + _VERSIONS + " SELECT v.id, d.document_key, v.content_hash, v.version FROM vers v JOIN docs d ON d.id = v.document_id WHERE v.id = 33")
def a_load_source(t):
    none = F.lit(None).cast("string")
    vers = _versions(t).withColumns({"ingestion_id": F.col("id").cast("string"), "file_name": none, "original_markdown": F.col("version").cast("string"), "source_bytes": F.col("id")})
    one = versions.load_source(vers, _documents(t), "33")
    return one.select(F.col("source_bytes").alias("id"), "document_key", "content_hash", F.col("markdown").cast("int").alias("version"))


@query("SELECT id, CASE WHEN status = 'RUNNING' AND id % 2 = 0 THEN 5 ELSE 0 END AS chunk_count FROM (WITH " + _VERSIONS + " SELECT id, status FROM vers)")
def d_progress(t):
    now = F.lit("2026-07-23 01:02:03").cast("timestamp")
    vers = _versions(t).withColumns({"ingestion_id": F.col("id").cast("string"), "chunk_count": F.lit(0), "embedded_chunk_count": F.lit(0), "updated_at": now})
    progress = vers.where("id % 2 = 0").select("ingestion_id", F.lit(5).alias("n_chunks"), F.lit(0).alias("n_embedded"))
    return versions.set_progress(vers, progress, now).select("id", "chunk_count")


@query("SELECT id, status, CASE status WHEN 'SUCCEEDED' THEN 'DEDUPLICATED' WHEN 'RUNNING' THEN CASE WHEN id % 2 = 0 THEN 'ACCEPTED' ELSE 'INGESTION_UNAVAILABLE' END WHEN 'QUEUED' THEN CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 'ACCEPTED' ELSE 'INGESTION_QUEUE_FULL' END END AS answer FROM (WITH " + _VERSIONS + " SELECT id, status FROM vers)")
def d_reuse_policy(t):
    k = F.col("id")
    return _versions(t).select("id", "status", versions.reuse_policy(F.col("status"), k % 2 == 0, k % 3 == 0).alias("answer"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def r_get(t):
    return R.Query(t.orders, "o_orderkey").where(P.eq("o_orderkey", 7)).select("o_orderkey", "o_custkey", "o_totalprice").df().select("o_orderkey", "o_custkey", "o_totalprice")


# The query builder.


@query("SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'a') AND p_brand <> 'Brand#11' AND p_size IN (1, 5, 9, 14, 23, 36, 45, 49) AND NOT starts_with(p_type, 'SMALL')) OR (lower(p_brand) = lower('BRAND#12') AND contains(lower(p_type), lower('steel'))) OR (p_retailprice >= 1900 AND p_size < 3 AND ends_with(p_type, 'COPPER'))")
def r_pred_string(t):
    p = P.or_(
        P.and_(P.contains("p_name", "a"), P.neq("p_brand", "Brand#11"), P.in_("p_size", [1, 5, 9, 14, 23, 36, 45, 49]), P.not_(P.has_prefix("p_type", "SMALL"))),
        P.and_(P.equal_fold("p_brand", "BRAND#12"), P.contains_fold("p_type", "steel")),
        P.and_(P.gte("p_retailprice", 1900), P.lt("p_size", 3), P.has_suffix("p_type", "COPPER")),
    )
    return R.Query(t.part, "p_partkey").where(p).select("p_partkey", "p_name").df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderkey NOT IN (1, 2, 3) AND o_orderstatus >= 'O'")
def r_pred_compare(t):
    return R.Query(t.orders, "o_orderkey").where(P.gt("o_totalprice", 1000), P.lte("o_totalprice", 200000), P.gte("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")), P.not_in("o_orderkey", [1, 2, 3]), P.gte("o_orderstatus", "O")).ids()


@query("SELECT count(*) FILTER (WHERE false) AS none, count(*) AS every FROM region")
def r_pred_empty_in(t):
    return t.region.agg(F.count(F.when(P.in_("r_name", []), 1)).alias("none"), F.count(F.when(P.not_in("r_name", []), 1)).alias("every"))


@query("SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.toxic = 1")
def r_pred_null(t):
    met = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return met.where(P.or_(P.is_nil("quality"), P.eq("toxic", 1))).select("doc_id", P.is_nil("quality").alias("unlabelled"))


@query("SELECT vec_id FROM embeddings WHERE embedding < [CAST(0 AS FLOAT)]")
def r_pred_vector(t):
    return t.embeddings.where(P.lt("embedding", P.vector([0.0]))).select("vec_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def r_has_edge(t):
    return R.Query(t.customer, "c_custkey").where(R.has_children(t.orders, ORDER_CUSTOMER)).ids()


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def r_not_has_edge(t):
    return R.Query(t.customer, "c_custkey").where(R.has_children(t.orders, ORDER_CUSTOMER, negate=True)).ids()


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def r_has_edge_with(t):
    return R.Query(t.customer, "c_custkey").where(R.has_children(t.orders, ORDER_CUSTOMER, P.gt("o_totalprice", 300000))).select("c_custkey", "c_name").df()


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
def r_has_parent_with(t):
    return R.Query(t.orders, "o_orderkey").where(R.has_parent(t.customer, ORDER_CUSTOMER, P.eq("c_mktsegment", "BUILDING"))).ids()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))")
def r_traverse(t):
    got = R.Query(t.customer, "c_custkey").where(P.eq("c_nationkey", 7)).traverse_to_children(t.orders, ORDER_CUSTOMER, "o_orderkey").unique(False).traverse_to_children(t.lineitem, LINE_ORDER, "l_orderkey")
    return got.unique(False).scan("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 500)")
def r_traverse_parent(t):
    return R.Query(t.orders, "o_orderkey").where(P.lt("o_orderkey", 500)).traverse_to_parent(t.customer, ORDER_CUSTOMER, "c_custkey").unique().scan("c_custkey", "c_name")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def r_traverse_parent_status(t):
    return R.Query(t.orders, "o_orderkey").where(P.eq("o_orderstatus", "F")).traverse_to_parent(t.customer, ORDER_CUSTOMER, "c_custkey").unique().scan("c_custkey", "c_name")


@query("SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def r_eager_1n(t):
    got = R.with_children(t.region, t.nation, NATION_REGION, "nations", ["n_name"])
    names = F.transform("nations", lambda n: n["n_name"])
    return got.select("r_regionkey", "r_name", F.array_join(names, ",").alias("nations"), F.size("nations").cast("long").alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def r_eager_n1(t):
    return R.with_parent(t.nation, t.region, NATION_REGION).select("n_nationkey", "n_name", F.col("region.r_name").alias("r_name"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS max_qty, min(l_quantity) AS min_qty, round(avg(l_quantity), 6) AS mean_qty, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def r_group_agg(t):
    a = R.AGGREGATES
    q = R.Query(t.lineitem, "l_orderkey").where(P.lte("l_shipdate", F.lit("1998-09-02").cast("timestamp_ntz")))
    return q.group_by("l_returnflag", "l_linestatus", aggregates=[R.as_(a["count"](), "n"), R.as_(a["max"]("l_quantity"), "max_qty"), R.as_(a["min"]("l_quantity"), "min_qty"), R.as_(F.round(a["mean"]("l_quantity"), 6), "mean_qty"), R.as_(F.round(a["sum"]("l_extendedprice"), 2), "sum_price")])


@query("SELECT count(*) AS n, max(o_totalprice) AS top, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F'")
def r_global_agg(t):
    return R.Query(t.orders, "o_orderkey").where(P.eq("o_orderstatus", "F")).aggregate(R.count_rows().alias("n"), F.max("o_totalprice").alias("top"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END) = 1 AS negative FROM orders")
def r_count_distinct(t):
    return t.orders.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), (F.max(F.when(F.col("o_totalprice") < 0, 1).otherwise(0)) == 1).alias("negative"))


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_name DESC NULLS FIRST LIMIT 1")
def r_only_first(t):
    return R.Query(t.region, "r_regionkey").order(R.desc("r_name")).select("r_regionkey", "r_name").limit(1).df()


@query("SELECT c_custkey, n_children FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_children FROM customer) ORDER BY n_children DESC, c_custkey LIMIT 50")
def r_order_neighbor_count(t):
    return R.order_by_children_count(t.customer, t.orders, ORDER_CUSTOMER, desc=True, tie=["c_custkey"]).select("c_custkey", "n_children").limit(50)


@query("SELECT o_orderkey, c_name AS customer_c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY c_name NULLS LAST, o_orderkey LIMIT 60")
def r_order_neighbor_field(t):
    return R.order_by_parent_field(t.orders, t.customer, ORDER_CUSTOMER, "c_name", tie=["o_orderkey"]).select("o_orderkey", "customer_c_name").limit(60)


@query("SELECT c_custkey, top FROM (SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer) ORDER BY top DESC NULLS FIRST, c_custkey LIMIT 40")
def r_order_neighbor_terms(t):
    return R.order_by_children(t.customer, t.orders, ORDER_CUSTOMER, F.max("o_totalprice"), desc=True, tie=["c_custkey"], name="top").select("c_custkey", "top").limit(40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 10")
def r_limit_offset(t):
    return R.Query(t.orders, "o_orderkey").order(R.desc("o_totalprice"), R.asc("o_orderkey")).offset(10).limit(25).select("o_orderkey", "o_totalprice").df()


_UPSERT_NEW = "new AS (SELECT c_custkey + 100 AS c_custkey, 'new-' || c_name AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, 'UPSERT' AS c_mktsegment FROM customer)"


def _upsert_rows(t) -> DataFrame:
    return t.customer.select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat(F.lit("new-"), "c_name").alias("c_name"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("UPSERT").alias("c_mktsegment"))


@query(f"WITH {_UPSERT_NEW} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM customer o FULL JOIN new n ON n.c_custkey = o.c_custkey")
def r_upsert_new_values(t):
    return R.upsert(t.customer, _upsert_rows(t), ["c_custkey"])


@query(f"WITH {_UPSERT_NEW} SELECT * FROM customer UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def r_upsert_ignore(t):
    return R.upsert(t.customer, _upsert_rows(t), ["c_custkey"], mode="ignore")


@query(f"WITH {_UPSERT_NEW} SELECT * FROM customer UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def r_upsert_nothing(t):
    return R.upsert(t.customer, _upsert_rows(t), ["c_custkey"], mode="nothing")


@query(f"WITH {_UPSERT_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE o.c_acctbal + n.c_acctbal END AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM customer o FULL JOIN new n ON n.c_custkey = o.c_custkey")
def r_upsert_update(t):
    return R.upsert(t.customer, _upsert_rows(t), ["c_custkey"], mode="update", set_={"c_acctbal": lambda old, new: old + new})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def r_update_cas(t):
    hit = P.and_(P.eq("o_orderstatus", "O"), P.gt("o_totalprice", 100000))
    got = R.settled(R.update(t.orders, hit, {"o_orderstatus": F.lit("R"), "o_totalprice": R.add("o_totalprice", 10), "o_orderpriority": R.clear()}))
    return got.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT conv_id, turn, role || '>extra' AS path FROM conversations")
def r_append(t):
    return t.conversations.withColumn("path", F.array("role")).select("conv_id", "turn", F.array_join(R.append("path", ["extra"]), ">").alias("path"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE NOT c_nationkey < 5))")
def r_delete_cascade(t):
    customers = R.delete(t.customer, P.lt("c_nationkey", 5))
    orders = R.cascade(t.orders, customers, ORDER_CUSTOMER)
    return R.cascade(t.lineitem, orders, LINE_ORDER).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def r_edge_mutation(t):
    return R.set_parent(t.orders, F.col("o_orderkey") % 100 == 0, ORDER_CUSTOMER, 1).select("o_orderkey", "o_custkey")


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def r_unique_violation(t):
    return R.duplicates(t.documents.select(F.sha2("text", 256).alias("hash")), "hash")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def r_unique(t):
    return R.Query(t.customer, "c_custkey").unique().scan("c_mktsegment", "c_nationkey")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT n_nationkey + 1000000, n_name, n_nationkey, 0.0, 'NEW' FROM nation")
def r_insert(t):
    rows = t.nation.select((F.col("n_nationkey") + 1000000).alias("c_custkey"), F.col("n_name").alias("c_name"), F.col("n_nationkey").alias("c_nationkey"))
    return R.insert(t.customer, rows, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("NEW")})


# Splitting.


def _chunks(t) -> DataFrame:
    return ingest.chunk_table(t.documents.select("doc_id", F.coalesce(canonical(F.col("text")), F.lit("")).alias("markdown")))


@query()
def s_text_chunks(t):
    return _chunks(t)


@query("SELECT CAST(0 AS BIGINT) AS bad_tokens, CAST(0 AS BIGINT) AS bad_hashes, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS blanks, (SELECT count(*) FROM documents WHERE trim(text) <> '') AS docs")
def s_chunk_invariants(t):
    c = _chunks(t)
    per = c.groupBy("doc_id").agg((F.max("chunk_index") + 1 != F.count("*")).cast("long").alias("gap"), F.sum((estimate_tokens(F.col("embedding_content")) != F.col("estimated_tokens")).cast("long")).alias("t"), F.sum((F.sha2("embedding_content", 256) != F.col("content_hash")).cast("long")).alias("h"), F.sum((F.trim("content") == "").cast("long")).alias("b"))
    return per.agg(F.sum("t").alias("bad_tokens"), F.sum("h").alias("bad_hashes"), F.sum("gap").alias("gaps"), F.sum("b").alias("blanks"), F.count("*").alias("docs"))


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, role, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))) GROUP BY conv_id, island, role")
def s_islands(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "role").distinct()
    marked = rows.withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).select("conv_id", "first_turn", "last_turn", "role", "n")


SAMPLE = "# Title\n\nshort fact\n\n## Sub\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n> quote\n\n```go\nx = 1\n```\n\n---\n\n![alt](p.jpg)\n\n<!-- note -->\n"


def _sample(t, step) -> DataFrame:
    rows = [(b["ordinal"], b["type"], ">".join(b["heading_path"]), b["content"], b["start_line"], b["end_line"]) for b in step(parse_blocks(SAMPLE))]
    return t.spark.createDataFrame(rows, "ordinal INT, type STRING, path STRING, content STRING, start_line INT, end_line INT")


_ROWS = "SELECT CAST(ordinal AS INTEGER) AS ordinal, type, path, content, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM (VALUES {}) v(ordinal, type, path, content, start_line, end_line)"
_NL, _TAB = "' || chr(10) || '", "' || chr(9) || '"


@query(
    _ROWS.format(
        f"(0,'paragraph','Title','short fact',3,3),(1,'list','Title>Sub','one{_NL}two',7,8),(2,'table','Title>Sub','a{_TAB}b{_TAB}{_NL}1{_TAB}2{_TAB}',10,12),(3,'quote','Title>Sub','quote',14,14),(4,'code','Title>Sub','x = 1{_NL}',16,18),(5,'thematic_break','Title>Sub','',20,20),(6,'image','Title>Sub','alt',22,22),(7,'raw_html','Title>Sub','<!-- note -->',24,24)"
    )
)
def p_blocks(t):
    return _sample(t, lambda b: b)


@query(_ROWS.format(f"(0,'paragraph','Title','short fact',3,3),(1,'list','Title>Sub','one{_NL}two',7,8),(2,'table','Title>Sub','a{_TAB}b{_TAB}{_NL}1{_TAB}2{_TAB}',10,12),(3,'quote','Title>Sub','quote',14,14),(4,'code','Title>Sub','x = 1{_NL}',16,18),(6,'image','Title>Sub','alt',22,22)"))
def f_blocks(t):
    return _sample(t, keep_indexable)


@query(_ROWS.format(f"(0,'paragraph','Title','short fact',3,3),(1,'list','Title>Sub','- one{_NL}- two',7,8),(2,'table','Title>Sub','| a | b |{_NL}| --- | --- |{_NL}| 1 | 2 |',10,12),(3,'quote','Title>Sub','quote',14,14),(4,'code','Title>Sub','x = 1',16,18),(6,'image','Title>Sub','alt',22,22)"))
def n_blocks(t):
    return _sample(t, lambda b: [normalize(x) for x in keep_indexable(b)])


@query(r"SELECT doc_id, 'paragraph' AS type, trim(regexp_replace(text, '[\t-\r\x{85}\p{Z}]+', ' ', 'g')) AS content FROM documents WHERE NOT regexp_matches(text, '(^|\n) {0,3}([#>|<`~*+=_-]|[0-9]{1,9}[.)]|\[)|\n[ \t]*\n|[`\[\]*_~<\\]|!\[|^( {4}|\t)|[|]|\n {4}') AND trim(text) <> ''")
def p_documents_plain(t):
    special = "(^|\n) {0,3}([#>|<`~*+=_-]|[0-9]{1,9}[.)]|\\[)|\n[ \t]*\n|[`\\[\\]*_~<\\\\]|!\\[|^( {4}|\t)|[|]|\n {4}"
    docs = t.documents.where(~F.col("text").rlike(special)).select("doc_id", F.col("text").alias("markdown"))
    return ingest.blocks(docs, normalized=True).select("doc_id", "type", "content")


@query()
def p_documents_all(t):
    docs = t.documents.select("doc_id", F.coalesce(canonical(F.col("text")), F.lit("")).alias("markdown"))
    return ingest.blocks(docs, normalized=True)


# Vectors.


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'DIMENSION' WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'NOT_FINITE' END AS problem FROM embeddings")
def e_vector_check(t):
    return t.embeddings.select("vec_id", embed.vector_problem(F.col("embedding"), 64).alias("problem"))


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id < 20) SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s) WHERE n <= 5"
)
def e_cosine_topk(t):
    return embed.cosine_topk(t.embeddings.where("vec_id < 20"), t.embeddings, 5).withColumn("similarity", F.round("similarity", 6))


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s) WHERE n <= 5"
)
def e_cosine_topk_hundredths(t):
    return embed.cosine_topk_all(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, 5).withColumn("similarity", F.round("similarity", 6))


@query()
def e_embed_chunks(t):
    chunks = _chunks(t)
    got = embed.embed_chunks(chunks.select("doc_id", "chunk_index", "embedding_content"), embed.hash_provider(16), 16, key="doc_id")
    return got.select("doc_id", "chunk_index", embed.vector_problem(F.col("embedding"), 16).alias("problem"), embed.to_float32(F.col("embedding")).alias("embedding"))
