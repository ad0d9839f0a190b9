"""Document ingestion as DataFrame stages.

Text crosses into Python once: parsing, filtering, normalising and splitting are one pass over Arrow batches; checks,
hashes, token estimates and everything about versions stay expressions and joins. A document that fails carries a code
and the stage it failed in, and never stops the others.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.text import estimate_tokens, utrim
from inkmill.operators import embed, markdown, splitter, versions
from inkmill.schemas import BLOCK, IN_PROGRESS, EngineError, Settings
from inkmill.sources.store import Snapshots, Transaction
from inkmill.sources.uploads import validate


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "markdown", normalized: bool = False, kept: bool = False) -> DataFrame:
    """The blocks of each document: key and schemas.BLOCK; with kept the indexable ones, normalized those in canonical form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                found = markdown.parse_blocks(t or "")
                if kept or normalized:
                    found = markdown.keep_indexable(found)
                if normalized:
                    found = [markdown.normalize(b) for b in found]
                rows += [{key: k} | b for b in found]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, {BLOCK}")


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "markdown", settings: Settings = Settings()) -> DataFrame:
    """Chunk drafts of each document: key, chunk_index, content, heading_path, start_line, end_line, failure columns.

    A document that can't be split has one row with failure_stage and failure_code and no chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "chunk_index", "content", "heading_path", "start_line", "end_line", "failure_stage", "failure_code"]
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                stage, code = "PARSING", "MARKDOWN_PARSE_FAILED"
                try:
                    found = markdown.parse_blocks(t or "")
                    stage, code = "FILTERING", "NO_INDEXABLE_CONTENT"
                    found = markdown.keep_indexable(found)
                    if not found:
                        raise EngineError(code)
                    stage = "NORMALIZING"
                    found = [markdown.normalize(b) for b in found]
                    stage, code = "CHUNKING", "DOCUMENT_SPLIT_FAILED"
                    chunks = splitter.split(found, settings.chunk_size, settings.chunk_overlap)
                    if not chunks:
                        raise EngineError(code)
                    rows += [(k, c["chunk_index"], c["content"], c["heading_path"], c["start_line"], c["end_line"], None, None) for c in chunks]
                except EngineError as e:
                    rows.append((k, None, None, None, None, None, stage, e.code))
                except Exception:  # one bad document never stops the others
                    rows.append((k, None, None, None, None, None, stage, code))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int32" for c in ("chunk_index", "start_line", "end_line")})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index INT, content STRING, heading_path ARRAY<STRING>, start_line INT, end_line INT, failure_stage STRING, failure_code STRING")


def finish_chunks(drafts: DataFrame) -> DataFrame:
    """Drafts without failures, with embedding_content, estimated_tokens and content_hash."""
    path = F.array_join("heading_path", " > ")
    return (
        drafts.where("failure_code is null")
        .drop("failure_stage", "failure_code")
        .withColumn("embedding_content", utrim(F.concat(path, F.lit("\n\n"), F.col("content"))))
        .withColumns({"estimated_tokens": estimate_tokens(F.col("embedding_content")), "content_hash": F.sha2("embedding_content", 256)})
    )


def failures(drafts: DataFrame, chunks: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """key, stage, code of documents that failed: while being split, or for a chunk beyond the provider's limit."""
    early = drafts.where("failure_code is not null").select(key, F.col("failure_stage").alias("stage"), F.col("failure_code").alias("code"))
    late = chunks.groupBy(key).agg(F.max("estimated_tokens").alias("__top")).where(F.col("__top") > settings.max_chunk_tokens)
    return early.unionByName(late.select(key, F.lit("CHUNKING").alias("stage"), F.lit("DOCUMENT_SPLIT_FAILED").alias("code")))


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "markdown", settings: Settings = Settings()) -> DataFrame:
    """Finished chunks of docs, in one pass."""
    return finish_chunks(split_documents(docs, key, text, settings))


def submit(store: Snapshots, uploads: DataFrame, now: Column, settings: Settings = Settings(), bounded: bool = False) -> DataFrame:
    """Checks uploads, decides on each, and queues new versions in one commit; gives the answers.

    Of uploads with one key in a batch the first by name counts, as the first to come would; the others that have its
    content are reused, the rest are conflicts. With bounded, no more versions wait than workers and queue hold: the
    first by name and key are created, the rest are answered with a full queue. The commit adds the new rows alone, and
    fails if another came after this one read the tables.
    """
    base = store.current()
    checked = _keep(store, validate(uploads, settings), "uploads")
    good = checked.where("failure_code is null")
    docs, vers = store.read("rag_documents", base), store.read("rag_document_versions", base)
    decided = versions.decide(good, docs, vers)
    rank = F.row_number().over(_by_key())
    first = F.first("content_hash").over(_by_key())
    ranked = decided.withColumn("__n", rank).withColumn("__first", first)
    answer = F.when((F.col("decision") == "CREATE") & (F.col("__n") > 1), F.when(F.col("content_hash") == F.col("__first"), "REUSE").otherwise("CONFLICT")).otherwise(F.col("decision"))
    answers = ranked.withColumn("decision", answer).drop("__n", "__first")
    if bounded:
        room = max(0, settings.ingestion_workers + settings.ingestion_queue_capacity - vers.where(F.col("status").isin(*IN_PROGRESS)).count())
        taken = answers.where("decision = 'CREATE'").orderBy("file_name", "document_key").limit(room).select(F.col("document_key").alias("__taken"))
        met = answers.join(F.broadcast(taken), F.col("document_key") == F.col("__taken"), "left")
        answers = met.withColumn("decision", F.when((F.col("decision") == "CREATE") & F.col("__taken").isNull(), "FULL").otherwise(F.col("decision"))).drop("__taken")
    answers = _keep(store, answers, "answers")
    create = answers.where("decision = 'CREATE'")
    top_doc = docs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    top_ver = vers.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = create.join(docs.select(F.col("document_key").alias("__have")), F.col("document_key") == F.col("__have"), "left_anti")
    # written first: both tables derive from these ids
    new_docs = _keep(store, fresh.select((F.monotonically_increasing_id() + top_doc + 1).alias("id"), "document_key", F.lit(0).alias("current_version"), now.alias("created_at"), now.alias("updated_at")), "documents")
    # of the documents that are there, those that get a version; theirs alone are looked up
    some = docs.join(create.select(F.col("document_key").alias("__have")), F.col("document_key") == F.col("__have"), "left_semi").unionByName(new_docs)
    nexts = versions.next_versions(some, vers.join(some.select(F.col("id").alias("__doc")), F.col("document_id") == F.col("__doc"), "left_semi"))
    named = some.select(F.col("document_key").alias("__key"), F.col("id").alias("document_id")).join(nexts, "document_id")
    met = create.join(named, F.col("document_key") == F.col("__key"))
    new_vers = met.select(
        (F.monotonically_increasing_id() + top_ver + 1).alias("id"),
        versions.ingestion_id(F.col("document_key"), F.col("next_version")).alias("ingestion_id"),
        "document_id",
        F.col("next_version").cast("int").alias("version"),
        "file_name",
        "content_hash",
        F.col("markdown").alias("original_markdown"),
        "source_bytes",
        F.lit("QUEUED").alias("status"),
        F.lit("QUEUED").alias("stage"),
        F.lit(0).alias("chunk_count"),
        F.lit(0).alias("embedded_chunk_count"),
        F.lit(None).cast("string").alias("failure_code"),
        F.lit(None).cast("string").alias("failure_message"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    tx = Transaction(store, base)
    tx.add("rag_documents", new_docs)
    tx.add("rag_document_versions", new_vers)
    tx.commit()
    bad = checked.where("failure_code is not null").select("document_key", "file_name", F.lit("REJECTED").alias("decision"), "failure_code")
    conflict = F.when(F.col("decision") == "CONFLICT", "INGESTION_IN_PROGRESS").when(F.col("decision") == "FULL", "INGESTION_QUEUE_FULL")
    return answers.select("document_key", "file_name", "decision", conflict.alias("failure_code")).unionByName(bad)


def _by_key():
    return Window.partitionBy("document_key").orderBy("file_name", "content_hash")


def process(store: Snapshots, provider: embed.Provider, now: Column, settings: Settings = Settings()) -> int:
    """Takes all queued versions through every stage and activates them in one commit; gives its number.

    The commit adds and removes the rows of the documents that have a queued version, nothing else. Chunks are written
    to the store's folder before the commit names them, so embedding runs once even where several tables derive from it.
    """
    base = store.current()
    docs, vers = (store.read(t, base) for t in ("rag_documents", "rag_document_versions"))
    touched = vers.where("status = 'QUEUED'").select(F.col("document_id").alias("__doc")).distinct()
    docs = _keep(store, docs.join(touched, F.col("id") == F.col("__doc"), "left_semi"), "documents")
    vers = _keep(store, vers.join(touched, F.col("document_id") == F.col("__doc"), "left_semi"), "versions")
    queued = vers.where("status = 'QUEUED'").select(F.col("id").alias("vid"), "ingestion_id", F.col("original_markdown").alias("markdown"))
    drafts = _keep(store, split_documents(queued, "vid", "markdown", settings), "drafts")
    chunks = finish_chunks(drafts)
    failed = failures(drafts, chunks, "vid", settings)
    good = chunks.join(failed.select(F.col("vid").alias("__bad")), F.col("vid") == F.col("__bad"), "left_anti")
    embedded = _keep(store, embed.embed_chunks(good, provider, settings.embedding_dim, settings.embed_batch_size, key="vid"), "embedded")
    problem = F.coalesce(F.col("embed_failure"), F.when(embed.vector_problem(F.col("embedding"), settings.embedding_dim).isNotNull(), "INVALID_EMBEDDING_RESPONSE"))
    late = embedded.withColumn("code", problem).where("code is not null").groupBy("vid").agg(F.min("code").alias("code")).select("vid", F.lit("EMBEDDING").alias("stage"), "code")
    every = failed.unionByName(late)
    ids = queued.select(F.col("vid").alias("__vid"), F.col("ingestion_id").alias("__iid"))
    by_id = every.join(ids, F.col("vid") == F.col("__vid")).select(F.col("__iid").alias("ingestion_id"), "stage", "code")
    marked = versions.mark_failed(vers, by_id, now)
    storing = marked.withColumns({"stage": F.when(F.col("status") == "QUEUED", "STORING").otherwise(F.col("stage")), "status": F.when(F.col("status") == "QUEUED", "RUNNING").otherwise(F.col("status"))})
    top = store.read("rag_chunks", base).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    kept = embedded.join(late.select(F.col("vid").alias("__bad")), F.col("vid") == F.col("__bad"), "left_anti")
    rows = kept.select(
        (F.monotonically_increasing_id() + top + 1).alias("id"),
        F.col("vid").alias("document_version_id"),
        "chunk_index",
        "content",
        "embedding_content",
        "heading_path",
        "start_line",
        "end_line",
        "estimated_tokens",
        "content_hash",
        embed.to_float32(F.col("embedding")).alias("embedding"),
        now.alias("created_at"),
    )
    storing, rows = _keep(store, storing, "storing"), _keep(store, rows, "chunks")
    next_docs, next_vers, next_chunks = versions.activate(docs, storing, rows.limit(0), rows, now)
    next_vers = _keep(store, next_vers, "next")
    gone = vers.select("id").join(next_vers.select(F.col("id").alias("__stays")), F.col("id") == F.col("__stays"), "left_anti")
    remove = {"rag_documents": docs.select("id"), "rag_document_versions": vers.select("id"), "rag_chunks": gone}
    return store.commit(None, base, {"rag_documents": next_docs, "rag_document_versions": next_vers, "rag_chunks": next_chunks}, remove)


def interrupt(store: Snapshots, now: Column, attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Marks all versions that are queued or running as interrupted, as a stop does; gives the commit's number.

    Tried again when another commit came in between, `attempts` times in all.
    """
    for attempt in range(attempts):
        base = store.current()
        vers = store.read("rag_document_versions", base)
        live = _keep(store, vers.where(F.col("status").isin(*IN_PROGRESS)), "live")
        marked = versions.mark_failed(live, live.select("ingestion_id", "stage", F.lit("PROCESS_INTERRUPTED").alias("code")), now)
        try:
            return store.commit(None, base, {"rag_document_versions": marked}, {"rag_document_versions": live.select("id")})
        except EngineError:
            if attempt + 1 == attempts:
                raise
            sleep(delay)
    raise ValueError("attempts must be positive")


def clear_work(store: Snapshots) -> None:
    """Removes what submit() and process() wrote for themselves. Only while neither runs."""
    store.drop("work")


def _keep(store: Snapshots, df: DataFrame, what: str) -> DataFrame:
    """df written beside the store's data and read again."""
    at = f"{store.root}/work/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return store.spark.read.schema(df.schema).parquet(at)
