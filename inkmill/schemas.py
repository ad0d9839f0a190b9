"""Table schemas, states, error codes and settings."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USERS = "id BIGINT, user_id STRING, metadata MAP<STRING, STRING>, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP"
DOCUMENTS = "id BIGINT, document_key STRING, current_version INT, created_at TIMESTAMP, updated_at TIMESTAMP"
VERSIONS = (
    "id BIGINT, ingestion_id STRING, document_id BIGINT, version INT, file_name STRING, content_hash STRING, original_markdown STRING, source_bytes BIGINT, "
    "status STRING, stage STRING, chunk_count INT, embedded_chunk_count INT, failure_code STRING, failure_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP, completed_at TIMESTAMP"
)
CHUNKS = (
    "id BIGINT, document_version_id BIGINT, chunk_index INT, content STRING, embedding_content STRING, heading_path ARRAY<STRING>, start_line INT, end_line INT, "
    "estimated_tokens INT, content_hash STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP"
)
BLOCK = "ordinal INT, type STRING, heading_path ARRAY<STRING>, raw_content STRING, content STRING, start_line INT, end_line INT"
CHUNK = "chunk_index INT, content STRING, embedding_content STRING, heading_path ARRAY<STRING>, start_line INT, end_line INT, estimated_tokens INT, content_hash STRING"

# Block types, states, stages, allowed transitions, error codes with their HTTP status, failure texts.
BLOCK_TYPES = ("paragraph", "list", "table", "quote", "code", "raw_html", "image", "thematic_break")
STATUSES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED")
STAGES = ("QUEUED", "PARSING", "FILTERING", "NORMALIZING", "CHUNKING", "EMBEDDING", "STORING", "COMPLETED")
IN_PROGRESS = ("QUEUED", "RUNNING")
TRANSITIONS = [
    ("QUEUED", "QUEUED", "RUNNING", "PARSING"),
    ("RUNNING", "PARSING", "RUNNING", "FILTERING"),
    ("RUNNING", "FILTERING", "RUNNING", "NORMALIZING"),
    ("RUNNING", "NORMALIZING", "RUNNING", "CHUNKING"),
    ("RUNNING", "CHUNKING", "RUNNING", "EMBEDDING"),
    ("RUNNING", "EMBEDDING", "RUNNING", "STORING"),
]
HTTP_STATUS = {
    "INVALID_DOCUMENT_KEY": 400,
    "DOCUMENT_KEY_REQUIRED": 400,
    "FILE_REQUIRED": 400,
    "UNSUPPORTED_FILE_TYPE": 400,
    "FILE_TOO_LARGE": 413,
    "INVALID_MARKDOWN_ENCODING": 400,
    "EMPTY_DOCUMENT": 400,
    "INVALID_INGESTION_ID": 400,
    "INVALID_INGESTION_STATE": 500,
    "INGESTION_IN_PROGRESS": 409,
    "INGESTION_NOT_FOUND": 404,
    "INGESTION_QUEUE_FULL": 503,
    "INGESTION_UNAVAILABLE": 503,
    "MARKDOWN_PARSE_FAILED": 500,
    "NO_INDEXABLE_CONTENT": 500,
    "DOCUMENT_SPLIT_FAILED": 500,
    "EMBEDDING_FAILED": 500,
    "INVALID_EMBEDDING_RESPONSE": 500,
    "DOCUMENT_STORE_FAILED": 500,
    "PROCESS_INTERRUPTED": 500,
    "INTERNAL_PROCESSING_ERROR": 500,
}
FAILURE_TEXT = {
    "MARKDOWN_PARSE_FAILED": "Markdown 解析失败",
    "NO_INDEXABLE_CONTENT": "文档没有可索引内容",
    "DOCUMENT_SPLIT_FAILED": "文档切分失败",
    "EMBEDDING_FAILED": "文本向量生成失败",
    "INVALID_EMBEDDING_RESPONSE": "Embedding 响应无效",
    "DOCUMENT_STORE_FAILED": "文档存储失败",
    "PROCESS_INTERRUPTED": "文档导入处理已中断",
    "INTERNAL_PROCESSING_ERROR": "文档导入处理失败",
}


class EngineError(Exception):
    """An error with one of the codes above."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class NotFound(EngineError):
    def __init__(self, what: str = ""):
        super().__init__("NOT_FOUND", what)


class NotSingular(EngineError):
    def __init__(self, what: str = ""):
        super().__init__("NOT_SINGULAR", what)


_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def seconds(text: str, name: str) -> float:
    """A duration such as 30s or 1m30s."""
    parts = re.findall(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(h|ms|us|µs|ns|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"{name} must be a duration")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Settings:
    """Settings with the defaults and bounds of the service; from_env reads the variables named beside them."""

    max_upload_bytes: int = 5_242_880  # RAG_MAX_UPLOAD_BYTES
    ingestion_workers: int = 1  # RAG_INGESTION_WORKERS
    ingestion_queue_capacity: int = 8  # RAG_INGESTION_QUEUE_CAPACITY
    embedding_dim: int = 1024
    embed_batch_size: int = 32  # 1 to 64; at most 32 are sent at once
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_chunk_tokens: int = 3072
    embedding_model: str = "embedding-3"  # EMBEDDING_MODEL, which must be this one
    # seconds; durations such as 1m30s in the variables
    database_timeout: float = 5.0  # DB_CONNECT_TIMEOUT
    request_timeout: float = 30.0  # REQUEST_TIMEOUT
    graph_timeout: float = 60.0  # GRAPH_TIMEOUT
    shutdown_timeout: float = 10.0  # SHUTDOWN_TIMEOUT
    ingestion_timeout: float = 600.0  # RAG_INGESTION_TIMEOUT
    embedding_timeout: float = 30.0  # EMBEDDING_TIMEOUT

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name in ("chunk_overlap", "embedding_model"):
                continue
            if f.name.endswith("_timeout"):
                if not v > 0:
                    raise ValueError(f"{f.name} must be positive")
                continue
            if not isinstance(v, int) or v <= 0:
                raise ValueError(f"{f.name} must be a positive whole number")
        if self.embed_batch_size > 64:
            raise ValueError("embed_batch_size must be at most 64")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise EngineError("DOCUMENT_SPLIT_FAILED", "overlap must be below the chunk size")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        names = {"max_upload_bytes": "RAG_MAX_UPLOAD_BYTES", "ingestion_workers": "RAG_INGESTION_WORKERS", "ingestion_queue_capacity": "RAG_INGESTION_QUEUE_CAPACITY", "embed_batch_size": "EMBEDDING_BATCH_SIZE", "embedding_dim": "EMBEDDING_DIMENSIONS"}
        times = {"database_timeout": "DB_CONNECT_TIMEOUT", "request_timeout": "REQUEST_TIMEOUT", "graph_timeout": "GRAPH_TIMEOUT", "shutdown_timeout": "SHUTDOWN_TIMEOUT", "ingestion_timeout": "RAG_INGESTION_TIMEOUT", "embedding_timeout": "EMBEDDING_TIMEOUT"}
        found: dict = {}
        for field, name in names.items():
            if raw := env.get(name, "").strip():
                try:
                    found[field] = int(raw)
                except ValueError:
                    raise ValueError(f"{name} must be a whole number") from None
        for field, name in times.items():
            if raw := env.get(name, "").strip():
                found[field] = seconds(raw, name)
        if model := env.get("EMBEDDING_MODEL", "").strip():
            found["embedding_model"] = model
        for field in ("embedding_dim", "embedding_model"):
            if found.get(field, getattr(cls, field)) != getattr(cls, field):
                raise ValueError(f"{field} must be {getattr(cls, field)}")
        return cls(**found)


def violations(df: DataFrame, unique: list[str] | None = None, not_null: tuple = (), max_length: Mapping[str, int] | None = None, one_of: Mapping[str, tuple] | None = None) -> DataFrame:
    """(rule, key, n) of the rules that rows of df break: nothing where all hold."""
    parts = []
    for c in not_null:
        parts.append(df.where(F.col(c).isNull()).select(F.lit(f"not_null:{c}").alias("rule"), F.lit(None).cast("string").alias("key")))
    for c, n in (max_length or {}).items():
        parts.append(df.where(F.char_length(c) > n).select(F.lit(f"max_length:{c}").alias("rule"), F.col(c).alias("key")))
    for c, values in (one_of or {}).items():
        parts.append(df.where(~F.col(c).isin(*values)).select(F.lit(f"one_of:{c}").alias("rule"), F.col(c).alias("key")))
    if unique:
        key = F.to_json(F.struct(*unique))
        twice = df.groupBy(*unique).count().where("count > 1").select(F.lit("unique:" + ",".join(unique)).alias("rule"), key.alias("key"))
        parts.append(twice)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule", "key").agg(F.count("*").alias("n"))
