"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as most contracts here define them: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset and all of Spark runs on this machine (tests), a temporary folder is made once per session. On a
    cluster executors wouldn't share it: there an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = spark.conf.get("inkmill.local.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="inkmill-")
        spark.conf.set("inkmill.local.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: later plans start from the files.

    The files outlive any executor; they are narrow tables only (ids, counts, labels).
    """
    at = fresh_dir(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, b"" for null."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes in that column, one row at least: what work on a run needs stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


_held: dict = {}
_owner: list[str] = [""]


def enter(owner: str) -> None:
    """To be called where an operator's work in a Python worker begins: what another operator kept there goes first.

    A worker thus holds one operator's memory at a time, however many ran in it.
    """
    if _owner[0] != owner:
        _held.clear()
        _owner[0] = owner
        tidy()


def tidy() -> None:
    """Gives memory that isn't used any more back to the machine, as far as the allocators know how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held(key: tuple, make: Callable):
    """What a Python worker keeps between tasks, made by make() once; asking for another key lets go of the last one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Arrow batches have `rows` rows at most, unless the session has chosen another bound than Spark's own 10,000.

    A batch of long texts takes memory several times over, in the JVM and in Python.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_rows(df: DataFrame, cols: list, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over Arrow batches of cols alone; columns of df that cols doesn't name never reach Python."""
    small_batches(df.sparkSession)
    return df.select(*cols).mapInArrow(alone(fn), schema)


def alone(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn as the work of its module: see enter(); what it leaves unused is given back at the end of each task."""
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        yield from fn(batches)
        tidy()

    return run


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names with dots, or that clash with an operator's own, do no harm."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def join_back(rows: DataFrame, facts: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """rows with the columns of facts (each key once, n: how many of rows have it), joined on key, which isn't null.

    Keys that hold more than one of `share` parts of the rows, of which there are at most `share`, come by broadcast, so
    a key of any weight is never gathered in one task; the others by a shuffle.
    """
    total = rows.count()
    heavy = F.col("n") * share > total
    hot, rest = facts.where(heavy), facts.where(~heavy)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(rest, key))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long): the smallest node reachable.

    Alternates the large-star and small-star steps until the edge set stands still, which takes a number of rounds that
    grows with the logarithm of a component's size. A node's smallest neighbour is a partial aggregate and comes back by
    an equi-join that adaptive execution can split, so a node with many neighbours is never gathered in one task. Only
    the round's edge count and checksum reach the driver. Self-links and null ends are ignored; an empty input gives an
    empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: every neighbour of a below it, and a itself, hang on the smallest of them
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def write_shared(path: str, data: bytes) -> None:
    """Writes a whole file in the shared folder: under a name of its own first, then renamed.

    A task that runs twice writes the same bytes, so the later rename changes nothing.
    """
    at = local_path(path)
    if at is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, at)
        return
    os.makedirs(os.path.dirname(at), exist_ok=True)
    tmp = f"{os.path.dirname(at)}/.{os.path.basename(at)}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, at)


def local_path(path: str) -> str | None:
    """The path as this machine's file system names it, None if it is in another store."""
    if path.startswith("file:"):
        return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return None if "://" in path else path


def write_arrays(at: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays as the .npy files of a folder (local_path()): under a name of its own first, then renamed.

    Where a task that runs twice finds the folder, the arrays in it are the same and stay.
    """
    tmp = f"{os.path.dirname(at)}/.{os.path.basename(at)}.{uuid.uuid4().hex}.tmp"
    os.makedirs(tmp)
    for name, x in arrays.items():
        np.save(f"{tmp}/{name}.npy", x, allow_pickle=False)
    try:
        os.rename(tmp, at)
    except OSError:
        shutil.rmtree(tmp)
        if not os.path.isdir(at):
            raise


def mapped_arrays(at: str) -> dict[str, np.ndarray]:
    """The arrays that write_arrays() wrote, mapped: all processes of a machine share the pages, none holds a copy."""
    return {name.removesuffix(".npy"): np.asarray(np.load(f"{at}/{name}", mmap_mode="r", allow_pickle=False)) for name in os.listdir(at)}
