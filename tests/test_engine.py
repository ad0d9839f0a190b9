import json
import os

import pytest
from pyspark.sql import functions as F

from inkmill import schemas
from inkmill.functions import predicates as P
from inkmill.functions.text import canonical, estimate_tokens, upload_failure, utrim
from inkmill.operators import embed, versions
from inkmill.operators import relational as R
from inkmill.plans import ingest
from inkmill.schemas import EngineError, NotFound, NotSingular, Settings
from inkmill.sources.store import Snapshots, Transaction
from inkmill.sources.uploads import read_files, validate
from inkmill.streaming.ingest import start

SMALL = Settings(embedding_dim=8)


def now():
    return F.lit("2026-07-23 01:02:03").cast("timestamp")


def test_estimates_and_canonical_form(spark):
    df = spark.createDataFrame([("\u3000 \r", 0), ("Zq9?;,", 2), ("e" * 50, 15), ("+", 2), ("木x.~☂", 6), ("word word", 3)], "t STRING, n INT")
    assert df.where(estimate_tokens(F.col("t")) != F.col("n")).isEmpty()
    r = spark.range(1).select(canonical(F.lit("﻿a\r\nb\rc")).alias("c"), utrim(F.lit("　 x ")).alias("t")).first()
    assert (r.c, r.t) == ("a\nb\nc", "x")


def test_upload_rules(spark):
    rows = [
        (" 商品/iphone-16_pro ", "CATALOG.MD", b"x", None),
        ("", "a.md", b"x", "INVALID_DOCUMENT_KEY"),
        ("has space", "a.md", b"x", "INVALID_DOCUMENT_KEY"),
        ("bad!", "a.md", b"x", "INVALID_DOCUMENT_KEY"),
        ("a" * 129, "a.md", b"x", "INVALID_DOCUMENT_KEY"),
        (None, "a.md", b"x", "INVALID_DOCUMENT_KEY"),
        ("k", " ", b"x", "FILE_REQUIRED"),
        ("k", "a.txt", b"x", "UNSUPPORTED_FILE_TYPE"),
        ("k", "a.md", b"12345678901", "FILE_TOO_LARGE"),
        ("k", "a.md", b"a\0b", "INVALID_MARKDOWN_ENCODING"),
        ("k", "a.md", b"\xff", "INVALID_MARKDOWN_ENCODING"),
        ("k", "a.md", b" \n", "EMPTY_DOCUMENT"),
        ("k", "a.markdown", b"\xef\xbb\xbf", "EMPTY_DOCUMENT"),
    ]
    df = spark.createDataFrame(rows, "k STRING, f STRING, c BINARY, want STRING")
    got = df.select("want", upload_failure(F.col("k"), F.col("f"), F.col("c"), 10).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    one = validate(spark.createDataFrame([("k", "C.MD", b"\xef\xbb\xbfa\r\nb\rc")], "document_key STRING, file_name STRING, content BINARY")).first()
    assert (one.markdown, one.source_bytes, one.file_name, one.failure_code) == ("a\nb\nc", 5, "C.MD", None) and len(one.content_hash) == 64


def people(spark):
    return spark.createDataFrame([(1, "ann", None), (2, "bob", 5), (3, "cy", 5), (4, None, 9)], "id LONG, name STRING, n INT")


def test_queries(spark):
    q = R.Query(people(spark))
    assert [r.id for r in q.order(R.asc("n"), R.asc("id")).df().collect()] == [2, 3, 4, 1]
    assert [r.id for r in q.order(R.desc("n"), R.asc("id")).df().collect()] == [1, 4, 2, 3]
    assert q.where(P.eq("n", 5)).count() == 2 and q.exist() and not q.where(P.eq("n", 0)).exist()
    assert q.where(P.neq("n", 5)).count() == 1  # null is neither
    assert q.select("name").df().columns == ["name", "id"]
    assert q.where(P.eq("id", 2)).only().name == "bob" and q.get(3).name == "cy"
    with pytest.raises(NotFound):
        q.get(99)
    with pytest.raises(NotSingular):
        q.where(P.eq("n", 5)).only()
    with pytest.raises(ValueError):
        q.select("nope")
    with pytest.raises(NotSingular):
        q.value("name")
    assert q.where(P.eq("id", 1)).value("name") == "ann"
    assert sorted(q.where(P.not_nil("n")).unique().values("n")) == [5, 9]
    assert [r.id for r in q.order(R.asc("id")).offset(1).limit(2).df().collect()] == [2, 3]
    assert q.where(P.in_("id", [])).count() == 0 and q.where(P.not_in("id", [])).count() == 4
    assert q.intercept(lambda d: d.where("id > 2")).count() == 2
    assert q.where(P.contains("name", "%")).count() == 0  # no wildcards
    assert {r.n: r.c for r in q.group_by("n", aggregates=[R.count_rows().alias("c")]).collect()} == {None: 1, 5: 2, 9: 1}


def test_edges(spark):
    kids = spark.createDataFrame([(1, 2, "x"), (2, 2, "y"), (3, 4, "z"), (4, None, "w")], "id LONG, pid LONG, v STRING")
    edge = R.Edge("parent", "pid")
    q = R.Query(people(spark))
    assert sorted(q.where(R.has_children(kids, edge)).values("id")) == [2, 4]
    assert sorted(q.where(R.has_children(kids, edge, negate=True)).values("id")) == [1, 3]
    assert sorted(R.Query(kids).where(R.has_parent(people(spark), edge, P.eq("n", 5))).values("id")) == [1, 2]
    assert sorted(q.where(P.eq("n", 5)).traverse_to_children(kids, edge).values("id")) == [1, 2]
    assert R.Query(kids).traverse_to_parent(people(spark), edge).count() == 2
    lists = {r.id: [k.v for k in r.parent] for r in R.with_children(people(spark), kids, edge, order=["v"]).collect()}
    assert lists == {1: [], 2: ["x", "y"], 3: [], 4: ["z"]}
    assert {r.id: r.parent and r.parent.name for r in R.with_parent(kids, people(spark), edge).collect()} == {1: "bob", 2: "bob", 3: None, 4: None}
    assert [r.id for r in R.order_by_children_count(people(spark), kids, edge, desc=True, tie=["id"]).collect()] == [2, 4, 1, 3]


def test_writes(spark):
    t = people(spark)
    rows = spark.createDataFrame([(2, "new", 7), (9, "nine", 9), (9, "again", 1)], "id LONG, name STRING, n INT")
    view = lambda df: sorted((r.id, r.name, r.n) for r in df.where("id in (2, 9)").collect())
    assert view(R.upsert(t, rows, ["id"])) == [(2, "new", 7), (9, "again", 1)]
    assert view(R.upsert(t, rows, ["id"], mode="ignore")) == [(2, "bob", 5), (9, "again", 1)]
    assert view(R.upsert(t, rows, ["id"], mode="update", set_={"n": lambda a, b: a + b})) == [(2, "bob", 12), (9, "again", 1)]
    up = R.update(t, P.eq("n", 5), {"n": R.add("n", 1), "name": R.clear()})
    assert R.changed(up) == 2 and R.settled(up).columns == t.columns
    with pytest.raises(NotFound):
        R.update_one(t, 99, {"n": F.lit(1)})
    assert R.delete(t, P.eq("n", 5)).count() == 2  # a null predicate deletes nothing
    with pytest.raises(NotFound):
        R.delete_one(t, 99)
    with pytest.raises(EngineError):
        R.insert(t, spark.createDataFrame([(7, None)], "id LONG, name STRING"), required=["name"])
    bad = schemas.violations(t, unique=["n"], not_null=("name",), max_length={"name": 2}, one_of={"name": ("bob", "ann")})
    assert {(r.rule, r.n) for r in bad.collect()} == {("unique:n", 1), ("not_null:name", 1), ("max_length:name", 1), ("max_length:name", 1), ("one_of:name", 1)} or bad.count() >= 4
    log = []
    hook = R.chain(lambda o, d, go: (log.append("a"), go(o, d))[1], R.on(lambda o, d, go: (log.append("b"), go(o, d))[1], "update"))
    hook("insert", t, lambda o, d: d)
    hook("update", t, lambda o, d: d)
    assert log == ["a", "a", "b"]
    with pytest.raises(EngineError):
        R.reject("delete")("delete", t, lambda o, d: d)


def test_store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": "id LONG, v STRING"})
    assert store.current() == 0 and store.read("t").count() == 0
    df = spark.createDataFrame([(1, "a")], "id LONG, v STRING")
    with Transaction(store) as tx:
        tx.write("t", df)
        assert tx.read("t").count() == 1 and store.read("t").count() == 0
    assert store.current() == 1 and store.read("t").count() == 1
    with pytest.raises(EngineError):
        store.commit({"t": df}, expected=0)
    with pytest.raises(RuntimeError), Transaction(store) as tx:
        tx.write("t", df.limit(0))
        raise RuntimeError
    assert store.read("t").count() == 1
    store.commit({"t": store.read("t").unionByName(df)})
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 1


def provider(texts):
    if any("poison" in t for t in texts):
        raise EngineError("EMBEDDING_FAILED")
    return embed.hash_provider(8)(texts)


def test_ingestion(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    up = lambda *rows: spark.createDataFrame([(k, f"{k}.md", t.encode()) for k, t in rows], "document_key STRING, file_name STRING, content BINARY")
    first = ingest.submit(store, up(("a", "# T\n\nfact one\n"), ("b", "<!-- only -->\n"), ("c", "poison"), ("bad key", "x")), now(), SMALL)
    assert {r.document_key: r.decision for r in first.collect()} == {"a": "CREATE", "b": "CREATE", "c": "CREATE", "bad key": "REJECTED"}
    again = ingest.submit(store, up(("a", "# T\n\nfact one\n"), ("b", "other")), now(), SMALL)
    assert {r.document_key: (r.decision, r.failure_code) for r in again.collect()} == {"a": ("REUSE", None), "b": ("CONFLICT", "INGESTION_IN_PROGRESS")}
    ingest.process(store, provider, now(), SMALL)
    view = {r.document_key: r for r in versions.task_view(store.read("rag_document_versions"), store.read("rag_documents")).collect()}
    assert (view["a"].status, view["a"].stage, view["a"].chunk_count) == ("SUCCEEDED", "COMPLETED", 1)
    assert (view["b"].status, view["b"].stage, view["b"].failure.code) == ("FAILED", "FILTERING", "NO_INDEXABLE_CONTENT")
    assert (view["c"].stage, view["c"].failure.code, view["c"].failure.message) == ("EMBEDDING", "EMBEDDING_FAILED", schemas.FAILURE_TEXT["EMBEDDING_FAILED"])
    (chunk,) = store.read("rag_chunks").collect()
    assert (chunk.content, chunk.embedding_content, chunk.heading_path, len(chunk.embedding)) == ("fact one", "T\n\nfact one", ["T"], 8)
    assert {r.document_key: r.decision for r in ingest.submit(store, up(("a", "# T\n\nfact two\n")), now(), SMALL).collect()} == {"a": "CREATE"}
    ingest.process(store, provider, now(), SMALL)
    assert [c.content for c in store.read("rag_chunks").collect()] == ["fact two"]
    docs = {r.document_key: r.current_version for r in store.read("rag_documents").collect()}
    assert docs == {"a": 2, "b": 0, "c": 0} and store.read("rag_document_versions").count() == 3
    (j,) = [json.loads(r.json) for r in versions.task_json(versions.task_view(store.read("rag_document_versions"), store.read("rag_documents"))).collect() if '"a"' in r.json]
    assert j["status"] == "SUCCEEDED" and "failure" not in j and j["completed_at"].startswith("2026-07-23T01:02:03")


def test_over_long_chunks_fail(spark):
    docs = spark.createDataFrame([(1, "| a |\n| - |\n| " + "汉" * 3000 + " |\n"), (2, "fine")], "doc_id LONG, markdown STRING")
    drafts = ingest.split_documents(docs)
    bad = ingest.failures(drafts, ingest.finish_chunks(drafts)).collect()
    assert [(r.doc_id, r.stage, r.code) for r in bad] == [(1, "CHUNKING", "DOCUMENT_SPLIT_FAILED")]


def test_streaming(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/store")
    os.makedirs(f"{tmp_path}/in")
    for k in range(3):
        (tmp_path / "in" / f"doc{k}.md").write_text(f"text {k}\n")
    run = lambda: start(spark, f"{tmp_path}/in", store, provider, f"{tmp_path}/cp", SMALL, once=True).awaitTermination()
    run()
    assert store.read("rag_chunks").count() == 3
    run()
    assert store.read("rag_chunks").count() == 3 and read_files(spark, f"{tmp_path}/in").count() == 3


def test_embedding_contract():
    ask = []

    def turned(texts):
        ask.append(len(texts))
        return list(reversed(embed.hash_provider(4)(texts)))

    texts = [f"t{k}" for k in range(33)]
    assert embed.embed_texts(texts, turned, 4, 64) == [r["embedding"] for r in embed.hash_provider(4)(texts)] and ask == [32, 1]
    assert embed.embed_texts([], turned, 4) == [] and ask == [32, 1]
    good = embed.hash_provider(2)(["a", "b"])
    broken = [good[:1], [good[0], good[0]], [good[0], good[1] | {"index": 2}], [good[0], good[1] | {"index": None}], [good[0], {"index": 1, "embedding": [1.0]}], [good[0], {"index": 1, "embedding": [1.0, float("nan")]}]]
    for b in broken:
        calls = []
        with pytest.raises(EngineError) as e:
            embed.embed_texts(["a", "b"], lambda t, b=b: (calls.append(1), b)[1], 2)
        assert e.value.code == "INVALID_EMBEDDING_RESPONSE" and len(calls) == 1
    waits, left = [], [2]

    def flaky(texts):
        if left[0]:
            left[0] -= 1
            raise embed.Retryable("503")
        return embed.hash_provider(2)(texts)

    assert len(embed.embed_texts(["a"], flaky, 2, sleep=waits.append)) == 1 and 0.1 <= waits[0] <= 0.125 and 0.2 <= waits[1] <= 0.25
    left[0] = 9
    with pytest.raises(EngineError):
        embed.embed_texts(["a"], flaky, 2, sleep=waits.append)


def test_vectors(spark):
    rows = [([1.0, 2.0], None), ([1.0], "DIMENSION"), ([1.0, float("nan")], "NOT_FINITE"), ([1.0, float("-inf")], "NOT_FINITE"), ([1.0, 1e39], "FLOAT32_RANGE"), (None, "NULL"), ([1.0, None], "NOT_FINITE")]
    df = spark.createDataFrame(rows, "v ARRAY<DOUBLE>, want STRING")
    assert [r.g for r in df.select(embed.vector_problem(F.col("v"), 2).alias("g")).collect()] == [w for _, w in rows]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = embed.cosine_topk(q.where("vec_id = 1"), q, 5).collect()
    assert [(r.vec_id, r.similarity and round(r.similarity, 6)) for r in sorted(got, key=lambda r: r.rank)] == [(2, 0.707107), (3, None)]
    with pytest.raises(ValueError):
        embed.cosine_topk(q, q, 1, query_rows=2)


def test_traversal_from_orders_of_any_id(spark, tmp_path):
    from inkmill.plans.queries import QUERIES

    spark.createDataFrame([(600, 1, "F"), (700, 1, "F"), (800, 2, "O"), (900, 3, "F")], "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey LONG, c_name STRING").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["r_traverse_parent_status"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (3, "c")]


def test_blocks_of_whole_documents(spark, tmp_path):
    from inkmill.plans.queries import QUERIES

    fixture = {
        1: ("plain words", [("paragraph", [], "plain words", 1, 1)]),
        2: ("# T\r\n\r\n- one\r\n- two\r\n\r\n## S\r\n\r\n> said\r\n", [("list", ["T"], "- one\n- two", 3, 4), ("quote", ["T", "S"], "said", 8, 8)]),
        3: ("| a | b |\n| - | - |\n| 1 | 2 |\n\n```py\nx = 1\n```\n", [("table", [], "| a | b |\n| --- | --- |\n| 1 | 2 |", 1, 3), ("code", [], "x = 1", 5, 7)]),
        4: ("first\n\nsecond", [("paragraph", [], "first", 1, 1), ("paragraph", [], "second", 3, 3)]),
        5: ("", []),
        6: (None, []),
    }
    spark.createDataFrame([(k, t) for k, (t, _) in fixture.items()], "doc_id LONG, text STRING").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {k: [] for k in fixture}
    for r in QUERIES["p_documents_all"](spark, str(tmp_path)).orderBy("doc_id", "ordinal").collect():
        got[r.doc_id].append((r.type, list(r.heading_path), r.content, r.start_line, r.end_line))
    assert got == {k: want for k, (_, want) in fixture.items()}
    # the plain-text query returns the first alone
    assert [r.doc_id for r in QUERIES["p_documents_plain"](spark, str(tmp_path)).collect()] == [1]


def test_search_of_many_queries(spark, tmp_path):
    from inkmill.plans.queries import QUERIES

    vectors = {k: [float(k % 7), float(k % 11) + 1] for k in range(100, 1150)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id LONG, embedding ARRAY<DOUBLE>")

    def brute(k, n):
        def cos(a, b):
            return (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) ** 0.5 * (b[0] ** 2 + b[1] ** 2) ** 0.5)

        s = sorted((round(cos(vectors[k], v), 6) for i, v in vectors.items() if i != k), reverse=True)
        return s[:n]

    few = df.where("vec_id < 140")
    got = {}
    for r in embed.cosine_topk_all(few, df, 3, block_rows=16).collect():
        got.setdefault(r.query_id, []).append(round(r.similarity, 6))
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == {k: brute(k, 3) for k in range(100, 140)}
    assert embed.cosine_topk_all(df.limit(0), df, 3).count() == 0
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = {r.query_id for r in QUERIES["e_cosine_topk_hundredths"](spark, str(tmp_path)).collect()}
    assert ids == set(range(100, 1150, 100))  # ids that begin above 20, too


def test_settings():
    assert Settings.from_env({"RAG_MAX_UPLOAD_BYTES": "10"}).max_upload_bytes == 10
    for env in ({"RAG_MAX_UPLOAD_BYTES": "0"}, {"RAG_INGESTION_WORKERS": "x"}, {"EMBEDDING_BATCH_SIZE": "65"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)
    with pytest.raises(EngineError):
        Settings(chunk_size=8, chunk_overlap=8)
    got = Settings.from_env({"REQUEST_TIMEOUT": "1m30s", "EMBEDDING_TIMEOUT": " 250ms ", "EMBEDDING_DIMENSIONS": "1024", "EMBEDDING_MODEL": "embedding-3"})
    assert (got.request_timeout, got.embedding_timeout, got.ingestion_timeout, got.embedding_dim) == (90.0, 0.25, 600.0, 1024)
    for env in ({"REQUEST_TIMEOUT": "soon"}, {"GRAPH_TIMEOUT": "0s"}, {"SHUTDOWN_TIMEOUT": "10"}, {"EMBEDDING_DIMENSIONS": "512"}, {"EMBEDDING_MODEL": "other"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)


def test_files_beyond_the_limit_are_refused_unread(spark, tmp_path):
    few = Settings(max_upload_bytes=10)
    (tmp_path / "small.md").write_bytes(b"0123456789")
    (tmp_path / "big.md").write_bytes(b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # reading the content of a longer file fails
    try:
        got = {r.document_key: (r.failure_code, r.markdown) for r in validate(read_files(spark, str(tmp_path), few), few).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"small": (None, "0123456789"), "big": ("FILE_TOO_LARGE", None)}


def test_stamps(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (1767323045000000), (1767323045120000), (1767323045000001), (1767323050000000) AS v(x)")
        got = [r.s for r in df.select(versions.stamp(F.col("t")).alias("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.12Z", "2026-01-02T03:04:05.000001Z", "2026-01-02T03:04:10Z"]


def test_hook_conditions(spark):
    df, seen = spark.createDataFrame([(1, "a")], "id LONG, name STRING"), []

    def note(op, table, go):
        seen.append(op)
        return go(op, table)

    both = R.if_(note, R.all_of(R.has_op("create", "update"), R.has_fields("id", "name"), R.not_(R.any_of(R.has_op("update"), R.has_fields("other")))))
    for op in ("create", "update", "delete"):
        R.chain(both)(op, df, lambda o, d: d)
    R.chain(both)("create", df.drop("name"), lambda o, d: d)
    assert seen == ["create"]


def test_upserts_tell_the_row_that_is_there(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id LONG, k STRING, v INT")
    rows = spark.createDataFrame([(7, "b", 9), (8, "c", 9)], "id LONG, k STRING, v INT")
    for mode in ("ignore", "nothing", "new_values"):
        got = R.upserted(table, R.upsert(table, rows, ["k"], mode=mode), rows, ["k"]).collect()
        assert sorted(map(tuple, got)) == [("b", 2, False), ("c", 8, True)], mode


def files_of(path):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows_in(spark, files):
    return sum(spark.read.parquet(f).count() for f in files)


def test_a_commit_between_reads_and_commit_is_a_conflict(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path))
    up = lambda key: spark.createDataFrame([(key, f"{key}.md", b"text " + key.encode())], "document_key STRING, file_name STRING, content BINARY")
    ingest.submit(store, up("a"), now(), SMALL)
    plain = versions.next_versions

    def while_another_commits(*args):
        monkeypatch.setattr(versions, "next_versions", plain)
        ingest.submit(store, up("b"), now(), SMALL)
        return plain(*args)

    monkeypatch.setattr(versions, "next_versions", while_another_commits)
    with pytest.raises(EngineError):
        ingest.submit(store, up("c"), now(), SMALL)
    assert {r.document_key for r in store.read("rag_documents").collect()} == {"a", "b"}
    tx = Transaction(store, store.current() - 1)
    tx.write("rag_documents", store.read("rag_documents", tx.base))
    with pytest.raises(EngineError):
        tx.commit()


def test_a_commit_writes_its_own_rows(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    up = lambda keys, text: spark.createDataFrame([(k, f"{k}.md", f"{text} {k}".encode()) for k in keys], "document_key STRING, file_name STRING, content BINARY")
    ingest.submit(store, up([f"k{n}" for n in range(40)], "one"), now(), SMALL)
    ingest.process(store, provider, now(), SMALL)
    before = files_of(tmp_path)
    ingest.submit(store, up(["k3", "new"], "two"), now(), SMALL)
    ingest.process(store, provider, now(), SMALL)
    new = files_of(tmp_path) - before
    # two documents: what was queued, then removals and rows of theirs; none of the other 39
    assert rows_in(spark, new) <= 20
    chunks = {r.content for r in store.read("rag_chunks").collect()}
    assert len(chunks) == 41 and {"two k3", "two new", "one k4"} <= chunks and "one k3" not in chunks
    docs = {r.document_key: r.current_version for r in store.read("rag_documents").collect()}
    assert len(docs) == 41 and docs["k3"] == 2 and docs["new"] == docs["k4"] == 1 and store.read("rag_document_versions").count() == 41
    old = {t: sorted(map(str, store.read(t).collect())) for t in store.manifest()}
    store.compact()
    assert all(len(x["segments"]) == 1 and not x["removals"] for x in store.manifest().values())
    assert {t: sorted(map(str, store.read(t).collect())) for t in store.manifest()} == old
    ingest.clear_work(store)
    assert store.read("rag_chunks").count() == 41
    with pytest.raises(ValueError):
        store.drop("data/rag_chunks")


def test_a_full_queue_and_an_interruption(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    few = Settings(embedding_dim=8, ingestion_workers=1, ingestion_queue_capacity=1)
    up = spark.createDataFrame([(k, f"{k}.md", k.encode()) for k in "cabd"], "document_key STRING, file_name STRING, content BINARY")
    got = {r.document_key: (r.decision, r.failure_code) for r in ingest.submit(store, up, now(), few, bounded=True).collect()}
    assert got == {"a": ("CREATE", None), "b": ("CREATE", None), "c": ("FULL", "INGESTION_QUEUE_FULL"), "d": ("FULL", "INGESTION_QUEUE_FULL")}
    assert {r.decision for r in ingest.submit(store, up.where("document_key = 'c'"), now(), few, bounded=True).collect()} == {"FULL"}
    ingest.interrupt(store, now())
    assert {(r.status, r.failure_code) for r in store.read("rag_document_versions").collect()} == {("FAILED", "PROCESS_INTERRUPTED")}
    assert {r.decision for r in ingest.submit(store, up.where("document_key = 'c'"), now(), few, bounded=True).collect()} == {"CREATE"}
