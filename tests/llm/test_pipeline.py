import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from inkmill.llm import queries, simhash  # noqa: E402

from .helpers import docs, key  # noqa: E402
from .test_scores import corpus  # noqa: E402


def test_stages_chain(spark, tmp_path):
    df, labels, truth = corpus(spark, 500, 8)
    copies = df.where("doc_id between 0 and 40").withColumn("doc_id", df["doc_id"] + 5000)
    df.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, seen = start, [start.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == start.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in now.collect()}
        seen.append(now.count())
        if name == "quality":
            known = [k for k in ids if k in truth]
            assert sum(truth[k][0] for k in known) / len(known) > 0.98
        if name == "toxicity":
            known = [k for k in ids if k in truth]
            assert sum(truth[k][1] for k in known) / len(known) < 0.02
        if name == "near_duplicates":
            assert not any(k >= 5000 for k in ids if k is not None and k - 5000 in ids)
            assert len(ids) == now.count()
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == seen[-1]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.drop("ids").collect()), key=key) == sorted(map(tuple, last.drop("ids").collect()), key=key)


def test_queries_run_on_awkward_tables(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    _, labels, _ = corpus(spark, 100, 3)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    n = docs(spark).count()
    for name, f in queries.QUERIES.items():
        if name not in ("op6_collision", "op9_mtree"):
            assert f(spark, str(tmp_path)).count() == n, name


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    df, labels, _ = corpus(spark, 200, 8)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["a.b", "__w", "__t", "__of", "__times", "__score", "key", "fp", "rows", "size", "c0", "words"]
    odd = df.select("*", *[F.col("doc_id").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns
        plain = stage(spark, df, str(tmp_path))
        rows = sorted(map(tuple, out.collect()), key=key)
        assert [r[: len(df.columns)] for r in rows] == sorted(map(tuple, plain.collect()), key=key), name
        assert all(set(r[len(df.columns) :]) == {r[0]} for r in rows)


def test_one_row_of_each_component_stays(spark):
    far = ["alpha beta gamma delta one", "entirely different words stand here now", "a third text that says nothing alike"]
    rows = [(1, far[0]), (1, far[1]), (2, far[0]), (2, far[1]), (None, far[0]), (None, far[2]), (None, far[2]), (3, None), (4, "")]
    df = docs(spark, [(i, t, f"l{k}", "s", "x", "y") for k, (i, t) in enumerate(rows)])
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(df).collect()), key=str)
    assert got == sorted([(1, far[0]), (1, far[1]), (None, far[2]), (3, None)], key=str)
