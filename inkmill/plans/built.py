"""Queries over documents whose structure is known: Markdown built from a table's rows, its blocks and chunks in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import predicates as P
from inkmill.functions.text import upload_failure
from inkmill.operators import embed, versions
from inkmill.operators import relational as R
from inkmill.plans import ingest
from inkmill.plans.queries import query
from inkmill.schemas import NotFound, NotSingular, Settings
from inkmill.sources.store import Snapshots, scratch

_NOW = "2026-07-23 01:02:03"


def _plain(t) -> Column:
    """The whole text's ASCII words, which hold no Markdown; `none` for a text without any."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return F.when(words == "", "none").otherwise(words)


_PLAIN = "CASE WHEN trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) = '' THEN 'none' ELSE trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) END"

# Blocks.

#: Lines of a document; {s} its plain text, {d} its id.
_LINES = [
    "# Doc {d}",
    "",
    "{s}",
    "",
    "## Part",
    "",
    "- one {d}",
    "- two *it*",
    "  - inner {d}",
    "",
    "| a | b |",
    "| --- | :-: |",
    "| {d} | `x` |",
    "",
    "> said **it** by",
    "> and more",
    "",
    "### Deep",
    "",
    "```py",
    "x = {d}",
    "",
    "y",
    "```",
    "",
    "---",
    "",
    "![alt {d}](p.png)",
    "",
    "<div>{d}</div>",
    "",
    "Setext {d}",
    "===",
    "",
    "last [link](http://x) {d}",
]
#: type, path, first and last line, content as parsed, canonical content (None: not indexable).
_BLOCKS = [
    ("paragraph", "Doc {d}", 3, 3, "{s}", "{s}"),
    ("list", "Doc {d}>Part", 7, 9, "one {d}\ntwo it\ninner {d}", "- one {d}\n- two it\n  - inner {d}"),
    ("table", "Doc {d}>Part", 11, 13, "a\tb\t\n{d}\tx\t", "| a | b |\n| --- | :---: |\n| {d} | x |"),
    ("quote", "Doc {d}>Part", 15, 16, "said it by\nand more", "said it by and more"),
    ("code", "Doc {d}>Part>Deep", 20, 24, "x = {d}\n\ny\n", "x = {d}\n\ny"),
    ("thematic_break", "Doc {d}>Part>Deep", 26, 26, "", None),
    ("image", "Doc {d}>Part>Deep", 28, 28, "alt {d}", "alt {d}"),
    ("raw_html", "Doc {d}>Part>Deep", 30, 30, "<div>{d}</div>", None),
    ("paragraph", "Setext {d}", 35, 35, "last link {d}", "last link {d}"),
]


def _sql_text(template: str) -> str:
    """A SQL expression for a template: {s} is the column s, {d} is doc_id."""
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in (("{s}", "s"), ("{d}", "doc_id"), ("\n", "chr(10)"), ("\t", "chr(9)")):
        out = out.replace(mark, f"' || {value} || '")
    return out


def _blocks_sql(content: int, only: bool, raw: bool) -> str:
    rows = []
    for k, b in enumerate(_BLOCKS):
        if not (only and b[5] is None):
            source = "\n".join(_LINES[b[2] - 1 : b[3]])
            rows.append(f"SELECT doc_id, {k} AS ordinal, '{b[0]}' AS type, {_sql_text(b[1])} AS path, {_sql_text(b[content])} AS content, {b[2]} AS start_line, {b[3]} AS end_line" + (f", {_sql_text(source)} AS raw_content" if raw else "") + " FROM d")
    return f"WITH d AS (SELECT doc_id, {_PLAIN} AS s FROM documents) " + " UNION ALL ".join(rows)


def _built(t) -> DataFrame:
    s, d = F.col("s"), F.col("doc_id").cast("string")
    lines = [F.replace(F.replace(F.lit(line), F.lit("{s}"), s), F.lit("{d}"), d) for line in _LINES]
    return t.documents.select("doc_id", _plain(t).alias("s")).select("doc_id", F.concat_ws("\n", *lines).alias("markdown"))


def _block_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", "ordinal", "type", F.array_join("heading_path", ">").alias("path"), "content", "start_line", "end_line", *more)


@query(_blocks_sql(4, False, True))
def p_built_blocks(t):
    return _block_rows(ingest.blocks(_built(t)), "raw_content")


@query(_blocks_sql(4, True, False))
def f_built_blocks(t):
    return _block_rows(ingest.blocks(_built(t), kept=True))


@query(_blocks_sql(5, True, False))
def n_built_blocks(t):
    return _block_rows(ingest.blocks(_built(t), normalized=True))


# Chunks: pieces of a fixed weight, so that how many a chunk holds is known. A piece has the hash of the whole text.

_HASH = "md5(coalesce(text, ''))"


def _pieced(t, top: int, piece: Column, before: str, after: str, sep: str) -> DataFrame:
    """Documents under the heading T: 1 + doc_id % top pieces (of column h, and the lambda variable i) between before and after."""
    docs = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), (F.col("doc_id") % top).cast("int").alias("last"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("last")), piece)
    return docs.select("doc_id", F.concat(F.lit("# T\n\n" + before), F.array_join(pieces, sep), F.lit(after)).alias("markdown"))


def _number(i: Column, width: int) -> Column:
    return F.lpad(i.cast("string"), width, "0")


def _chunk_rows(docs: DataFrame) -> DataFrame:
    c = ingest.chunk_table(docs)
    return c.select("doc_id", "chunk_index", "content", "embedding_content", F.array_join("heading_path", ">").alias("path"), "start_line", "end_line", "estimated_tokens", "content_hash")


def _chunks_sql(top: int, chunks: str, first: str, last: str, content: str, weight: str, start: str, end: str) -> str:
    """first and last: a chunk's pieces, of k (its index) and n (pieces); weight: tenths of its content; all SQL."""
    return f"""WITH d AS (SELECT doc_id, {_HASH} AS h, 1 + doc_id % {top} AS n FROM documents),
c AS (SELECT doc_id, h, n, unnest(generate_series(0, {chunks})) AS k FROM d),
r AS (SELECT *, {first} AS a, {last} AS b FROM c),
x AS (SELECT *, {content} AS content FROM r)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, content, 'T' || chr(10) || chr(10) || content AS embedding_content, 'T' AS path, CAST({start} AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line,
  CAST(ceil((3 + {weight}) / 10.0) AS INTEGER) AS estimated_tokens, sha256('T' || chr(10) || chr(10) || content) AS content_hash FROM x"""


def _listed(piece: str, sep: str) -> str:
    return f"array_to_string(list_transform(generate_series(a, b), lambda i: {piece}), {sep})"


# a paragraph weighs 300 tenths: 17 in a chunk, of which the first two come from the chunk before
@query(_chunks_sql(60, "greatest(0, (n - 3) // 15)", "15 * k", "least(15 * k + 16, n - 1)", _listed("h || '-p' || lpad(CAST(i AS VARCHAR), 4, '0') || repeat('x', 62)", "chr(10) || chr(10)"), "300 * (b - a + 1)", "3 + 2 * a", "3 + 2 * b"))
def s_paragraph_chunks(t):
    return _chunk_rows(_pieced(t, 60, lambda i: F.concat("h", F.lit("-p"), _number(i, 4), F.lit("x" * 62)), "", "", "\n\n"))


# a row weighs 156 tenths, the two heading lines 114: 32 rows a part, each below the heading
@query(_chunks_sql(200, "(n - 1) // 32", "32 * k", "least(32 * k + 31, n - 1)", "'| h | n |' || chr(10) || '| --- | --- |' || chr(10) || " + _listed("'| ' || h || ' | ' || lpad(CAST(i AS VARCHAR), 5, '0') || ' |'", "chr(10)"), "(114 + 156 * (b - a + 1))", "3", "5 + b"))
def s_table_chunks(t):
    return _chunk_rows(_pieced(t, 200, lambda i: F.concat(F.lit("| "), "h", F.lit(" | "), _number(i, 5), F.lit(" |")), "| h | n |\n| --- | --- |\n", "", "\n"))


# an item weighs 117 tenths: 43 a part
@query(_chunks_sql(150, "(n - 1) // 43", "43 * k", "least(43 * k + 42, n - 1)", _listed("'- ' || h || '-' || lpad(CAST(i AS VARCHAR), 5, '0')", "chr(10)"), "117 * (b - a + 1)", "3 + a", "3 + b"))
def s_list_chunks(t):
    return _chunk_rows(_pieced(t, 150, lambda i: F.concat(F.lit("- "), "h", F.lit("-"), _number(i, 5)), "", "", "\n"))


# a line weighs 114 tenths: 44 a part; a block in one chunk spans its fences
@query(_chunks_sql(150, "(n - 1) // 44", "44 * k", "least(44 * k + 43, n - 1)", _listed("h || '_' || lpad(CAST(i AS VARCHAR), 5, '0')", "chr(10)"), "114 * (b - a + 1)", "CASE WHEN n <= 44 THEN 3 ELSE 4 + a END", "CASE WHEN n <= 44 THEN n + 4 ELSE 4 + b END"))
def s_code_chunks(t):
    return _chunk_rows(_pieced(t, 150, lambda i: F.concat("h", F.lit("_"), _number(i, 5)), "```\n", "\n```\n", "\n"))


# a sentence weighs 111 tenths: 46 a part; before a last part that leaves room come the last characters of the part
# before it, 213 of those that weigh anything or as many as the room takes
_SENTENCE = "h || lpad(CAST({} AS VARCHAR), 4, '0') || '.'"
_LENT = "CASE WHEN k = 0 OR b - a + 1 >= 46 THEN 0 ELSE least(640, greatest(0, 10 * (511 - CAST(ceil(11.1 * (b - a + 1)) AS INTEGER)))) // 3 END"
_TAIL = (
    f"array_to_string(list_filter([right({_SENTENCE.format('a - 1 - lent // 37')}, CAST(lent % 37 AS BIGINT)), array_to_string(list_transform(generate_series(a - lent // 37, a - 1), lambda i: {_SENTENCE.format('i')}), ' ')], lambda x: x <> ''), ' ')"
)


@query(
    f"""WITH d AS (SELECT doc_id, {_HASH} AS h, 1 + doc_id % 120 AS n FROM documents),
c AS (SELECT doc_id, h, n, unnest(generate_series(0, (n - 1) // 46)) AS k FROM d),
r AS (SELECT *, 46 * k AS a, least(46 * k + 45, n - 1) AS b FROM c),
l AS (SELECT *, {_LENT} AS lent FROM r),
x AS (SELECT *, CASE WHEN lent > 0 THEN {_TAIL} || chr(10) || chr(10) ELSE '' END || {_listed(_SENTENCE.format('i'), "' '")} AS content FROM l)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, content, 'T' || chr(10) || chr(10) || content AS embedding_content, 'T' AS path, 3 AS start_line, 3 AS end_line,
  CAST(ceil((3 + 3 * lent + 111 * (b - a + 1)) / 10.0) AS INTEGER) AS estimated_tokens, sha256('T' || chr(10) || chr(10) || content) AS content_hash FROM x"""
)
def s_sentence_chunks(t):
    return _chunk_rows(_pieced(t, 120, lambda i: F.concat("h", _number(i, 4), F.lit(".")), "", "", " "))


# Failures and ingestion.


def _mixed(t) -> DataFrame:
    """Documents that end in each way: without content, with a cell beyond the provider's limit, whole."""
    k = F.col("doc_id") % 5
    body = F.when(k == 0, "# only a heading").when(k == 1, "<!-- hidden -->").when(k == 2, F.concat(F.lit("| a |\n| - |\n| "), F.repeat(F.lit("汉"), F.lit(3000)), F.lit(" |"))).otherwise(F.concat(F.lit("# Doc\n\n"), _plain(t)))
    return t.documents.select("doc_id", body.alias("markdown"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'CHUNKING' ELSE 'FILTERING' END AS stage, CASE WHEN doc_id % 5 = 2 THEN 'DOCUMENT_SPLIT_FAILED' ELSE 'NO_INDEXABLE_CONTENT' END AS code FROM documents WHERE doc_id % 5 < 3")
def f_failure_rows(t):
    drafts = ingest.split_documents(_mixed(t))
    return ingest.failures(drafts, ingest.finish_chunks(drafts))


def _uploads(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("document_key"), F.lit("a.md").alias("file_name"), F.encode("markdown", "UTF-8").alias("content"))


_STATES = "CASE WHEN doc_id % 5 < 3 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN doc_id % 5 < 2 THEN 'FILTERING' WHEN doc_id % 5 = 2 THEN 'CHUNKING' ELSE 'COMPLETED' END AS stage, CASE WHEN doc_id % 5 < 2 THEN 'NO_INDEXABLE_CONTENT' WHEN doc_id % 5 = 2 THEN 'DOCUMENT_SPLIT_FAILED' END AS code"


@query(
    f"""SELECT 'doc/' || doc_id AS document_key, 1 AS version, {_STATES}, doc_id % 5 >= 3 AS has_chunks FROM documents WHERE NOT (doc_id % 5 >= 3 AND doc_id % 2 = 0)
UNION ALL SELECT 'doc/' || doc_id, 2, 'SUCCEEDED', 'COMPLETED', NULL, true FROM documents WHERE doc_id % 5 >= 3 AND doc_id % 2 = 0"""
)
def q_ingested(t):
    """All documents submitted and processed, then the even ones again: the good ones have changed, the failed ones aren't sent."""
    store = Snapshots(t.spark, scratch(t.spark))
    now, settings = F.lit(_NOW).cast("timestamp"), Settings()
    good = (F.col("doc_id") % 5 >= 3) & (F.col("doc_id") % 2 == 0)
    for docs in (_mixed(t), _mixed(t).where(good).withColumn("markdown", F.concat("markdown", F.lit(" again")))):
        ingest.submit(store, _uploads(docs), now, settings)
        ingest.process(store, embed.hash_provider(settings.embedding_dim), now, settings)
    view = versions.task_view(store.read("rag_document_versions"), store.read("rag_documents"))
    return view.select("document_key", "version", "status", "stage", F.col("failure.code").alias("code"), (F.coalesce("chunk_count", F.lit(0)) > 0).alias("has_chunks"))


@query("SELECT 'doc/' || doc_id AS document_key, CASE WHEN doc_id % 3 = 0 THEN 'REUSE' ELSE 'CONFLICT' END AS decision, CASE WHEN doc_id % 3 <> 0 THEN 'INGESTION_IN_PROGRESS' END AS failure_code FROM documents")
def q_answers(t):
    """All documents submitted, then again before any is processed: a third as they were, the others changed."""
    store, now = Snapshots(t.spark, scratch(t.spark)), F.lit(_NOW).cast("timestamp")
    docs = t.documents.select("doc_id", _plain(t).alias("markdown"))
    ingest.submit(store, _uploads(docs), now)
    again = docs.withColumn("markdown", F.when(F.col("doc_id") % 3 == 0, F.col("markdown")).otherwise(F.concat("markdown", F.lit(" again"))))
    return ingest.submit(store, _uploads(again), now).select("document_key", "decision", "failure_code")


# Checks, stamps, vectors, reads that reach the driver.


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN 'INVALID_MARKDOWN_ENCODING' WHEN doc_id % 6 = 2 THEN 'EMPTY_DOCUMENT'
  WHEN regexp_full_match(coalesce(text, ''), '[\t-\r\x{85}\p{Z}]*') THEN 'EMPTY_DOCUMENT' END AS failure_code FROM documents"""
)
def b_encoding_codes(t):
    k, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    raw, mark = F.encode(text, "UTF-8"), F.unhex(F.lit("EFBBBF"))
    body = F.when(k == 0, F.concat(raw, F.unhex(F.lit("00")))).when(k == 1, F.concat(raw, F.unhex(F.lit("FF")))).when(k == 2, mark).when(k == 3, F.concat(mark, raw)).otherwise(raw)
    return t.documents.select("doc_id", upload_failure(F.lit("key"), F.lit("a.md"), body, 1 << 30).alias("failure_code"))


@query("SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'FLOAT32_RANGE' WHEN 1 THEN 'NOT_FINITE' WHEN 2 THEN 'NOT_FINITE' WHEN 3 THEN 'DIMENSION' WHEN 4 THEN 'NULL' END AS problem FROM embeddings")
def e_vector_range(t):
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 6
    more = F.when(k == 0, F.lit(1e39)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    made = F.when(k == 3, v).when(k != 4, F.concat(v, F.array(more)))
    return t.embeddings.select("vec_id", embed.vector_problem(made, 65).alias("problem"))


@query("SELECT o_orderkey AS id, '2026-01-02T03:04:05' || CASE WHEN o_orderkey * 1000 % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(o_orderkey * 1000 % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS created_at, o_orderstatus AS status FROM orders")
def d_task_json(t):
    at = F.timestamp_micros(F.lit(1767323045000000) + F.col("o_orderkey") * 1000 % 1000000)
    view = t.orders.select(F.col("o_orderkey").cast("string").alias("ingestion_id"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.col("o_orderstatus").alias("status"))
    shown = versions.task_json(view).select(F.col("ingestion_id").cast("long").alias("id"), F.from_json("json", "created_at STRING, completed_at STRING, status STRING").alias("j"))
    return shown.where("j.completed_at is null").select("id", "j.created_at", "j.status")


_READS = {
    "only": "(SELECT n_name FROM nation WHERE n_nationkey = 7)",
    "only_id": "(SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 9)",
    "first": "(SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 1)",
    "first_id": "(SELECT CAST(n_nationkey AS VARCHAR) FROM nation ORDER BY n_name LIMIT 1)",
    "get": "(SELECT n_name FROM nation WHERE n_nationkey = 3)",
    "value": "(SELECT r_name FROM region WHERE r_regionkey = 2)",
    "values": "(SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region)",
    "count": "(SELECT CAST(count(DISTINCT n_regionkey) AS VARCHAR) FROM nation)",
    "intercepted": "(SELECT CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey <> 1)",
    "exist": "(SELECT CAST(EXISTS (SELECT 1 FROM nation) AS VARCHAR))",
    "exist_none": "(SELECT CAST(EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0) AS VARCHAR))",
    "exist_beyond": "(SELECT CAST(count(*) > 100 AS VARCHAR) FROM nation)",
    "exist_limit_0": "'false'",
    "update_one": "(SELECT n_name || '!' FROM nation WHERE n_nationkey = 5)",
    "none": "'NotFound'",
    "several": "'NotSingular'",
    "get_none": "'NotFound'",
    "update_none": "'NotFound'",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, {sql} AS value" for name, sql in _READS.items()))
def r_driver_reads(t):
    nation, region = R.Query(t.nation, "n_nationkey"), R.Query(t.region, "r_regionkey")

    def error(f) -> str:
        try:
            return f"no error: {f()}"
        except (NotFound, NotSingular) as e:
            return type(e).__name__

    renamed = R.update_one(t.nation, 5, {"n_name": F.concat("n_name", F.lit("!"))}, "n_nationkey")
    got = {
        "only": nation.where(P.eq("n_nationkey", 7)).only()["n_name"],
        "only_id": nation.where(P.eq("n_nationkey", 9)).only_id(),
        "first": nation.order(R.desc("n_name")).first()["n_name"],
        "first_id": nation.order(R.asc("n_name")).first_id(),
        "get": nation.get(3)["n_name"],
        "value": region.where(P.eq("r_regionkey", 2)).value("r_name"),
        "values": ",".join(region.order(R.asc("r_name")).values("r_name")),
        "count": nation.select("n_regionkey").unique().count(),
        "intercepted": nation.intercept(lambda df: df.where("n_regionkey <> 1")).count(),
        "exist": nation.exist(),
        "exist_none": nation.where(P.lt("n_nationkey", 0)).exist(),
        "exist_beyond": nation.offset(100).exist(),
        "exist_limit_0": nation.limit(0).exist(),
        "update_one": R.Query(renamed, "n_nationkey").get(5)["n_name"],
        "none": error(nation.where(P.lt("n_nationkey", 0)).only),
        "several": error(nation.only),
        "get_none": error(lambda: nation.get(-1)),
        "update_none": error(lambda: R.update_one(t.nation, -1, {"n_name": F.lit("x")}, "n_nationkey")),
    }
    return t.spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in got.items()], "name STRING, value STRING")


@query(
    "SELECT o_orderkey, uuid < '80000000-0000-0000-0000-000000000000' AS below, uuid = first AS same, uuid <> first AS other, uuid IN (first) AS inside FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, 'cfcd2084-95d5-65ef-66e7-dff9f98764da' AS first FROM (SELECT o_orderkey, md5(CAST(o_orderkey % 10 AS VARCHAR)) AS h FROM orders))"
)
def r_pred_uuid(t):
    h = F.upper(F.md5((F.col("o_orderkey") % 10).cast("string")))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    first, half = "cfcd2084-95d5-65ef-66e7-dff9f98764DA", "80000000-0000-0000-0000-000000000000"
    rows = t.orders.select("o_orderkey", uuid.alias("uuid"))
    return rows.select("o_orderkey", P.uuid_order("uuid", "lt", half).alias("below"), P.uuid_eq("uuid", first).alias("same"), P.uuid_neq("uuid", first).alias("other"), P.uuid_in("uuid", [first]).alias("inside"))
