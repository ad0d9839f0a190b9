"""Token ids as files of shuffled planes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alone, fresh_dir, small_batches, text_bytes, write_shared
from .units import encoder, slices

#: File: magic, then HEAD, the document table, the chunk index, the chunks.
MAGIC = b"IDPLANE2"
HEAD = struct.Struct("<BBIQQQQ")  # bytes an id, 1 for bit planes, ids a chunk, documents, ids, bytes of the table, chunks
#: Chunk index entry: offset of the chunk among the chunks, ids in it; then a length for each plane.
ENTRY = struct.Struct("<QI")
CHUNK = 65_536
#: A file is closed once it holds this many ids.
FILE_IDS = 4_194_304
#: Words that a worker remembers, a generation (units.py); more than elsewhere, as nothing else here takes memory.
MEMO = 500_000
MANIFEST = "part long, number long, n_docs long, n_ids long"


def split_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The block's byte planes, or bit planes, lowest first."""
    cols = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [np.ascontiguousarray(cols[:, k]).tobytes() for k in range(width)]
    flat = np.unpackbits(np.ascontiguousarray(cols), axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def join_planes(parts: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if bits:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        out[:, :width] = np.packbits(flat, axis=1, bitorder="little")
    else:
        for k, p in enumerate(parts):
            out[:, k] = np.frombuffer(p, np.uint8)
    return out.view("<u4").ravel()


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, chunk: int = CHUNK, bits: bool = False, level: int = 1) -> bytes:
    """One file's bytes. lengths: ids of each document; ids: all of them, in order. A bit for each document marks null doc_ids."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    top = int(ids.max()) if len(ids) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    nulls = np.array([x is None for x in doc_ids], bool)
    table = z.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.packbits(nulls, bitorder="little").tobytes())
    index, body, at = [], [], 0
    for k in range(0, len(ids), chunk):
        part = ids[k : k + chunk]
        coded = [z.compress(p) for p in split_planes(part, width, bits)]
        index.append(ENTRY.pack(at, len(part)) + np.array([len(c) for c in coded], "<u4").tobytes())
        body += coded
        at += sum(map(len, coded))
    return MAGIC + HEAD.pack(width, bits, chunk, len(doc_ids), len(ids), len(table), len(index)) + table + b"".join(index + body)


class PlaneFile:
    """Reads a file's bytes: the document table, single chunks by the index, or the ids of one document."""

    def __init__(self, data: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token plane file")
        self.z = zstandard.ZstdDecompressor()
        self.data = memoryview(data)
        self.width, bits, self.chunk, n_docs, self.n_ids, table, self.n_chunks = HEAD.unpack_from(data, len(MAGIC))
        self.bits = bool(bits)
        at = len(MAGIC) + HEAD.size
        raw = self.z.decompress(self.data[at : at + table])
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs)
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n_docs), count=n_docs, bitorder="little").astype(bool)
        self.index_at = at + table
        self.planes = self.width * (8 if self.bits else 1)
        self.body_at = self.index_at + self.n_chunks * (ENTRY.size + 4 * self.planes)

    def ids_of_chunk(self, k: int) -> np.ndarray:
        at = self.index_at + k * (ENTRY.size + 4 * self.planes)
        offset, n = ENTRY.unpack_from(self.data, at)
        sizes = np.frombuffer(self.data, "<u4", self.planes, at + ENTRY.size)
        parts, p = [], self.body_at + offset
        for s in sizes.tolist():
            parts.append(self.z.decompress(self.data[p : p + s]))
            p += s
        return join_planes(parts, n, self.width, self.bits)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the file, from the chunks that hold them."""
        stop = self.n_ids if stop is None else stop
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // self.chunk
        whole = np.concatenate([self.ids_of_chunk(k) for k in range(first, (stop - 1) // self.chunk + 1)])
        return whole[start - first * self.chunk : stop - first * self.chunk]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, bits: bool = False, file_ids: int = FILE_IDS, chunk: int = CHUNK, memo: int = MEMO) -> str:
    """Writes the ids of docs (doc_id, text), each document's followed by end_id, in ascending doc_id; gives the folder.

    Documents are dealt by ranges of doc_id and sorted within a range; each task writes files part-RANGE-NUMBER.ids of
    about file_ids ids at most (one document more at the end), so memory doesn't grow with a range. Null ids come
    first and stay null, whatever the other ids; null texts are empty and give end_id alone; rows with equal ids follow one another by text. An empty table
    writes no file. A task that runs again writes the same names and bytes.
    """
    at = path or fresh_dir(docs.sparkSession, "tokens")
    small_batches(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, memo)
        part, number = TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        coded: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, coded, held, number
            write_shared(f"{at}/files/part-{part:07d}-{number:06d}.ids", pack(doc_ids, lengths, np.frombuffer(b"".join(coded), "<u4"), chunk, bits))
            kinds = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
            out = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n_docs": [len(doc_ids)], "n_ids": [held]}, schema=kinds)
            doc_ids, lengths, coded, held, number = [], [], [], 0, number + 1
            return out

        for b in batches:
            texts, keys = text_bytes(b), b.column(0).to_pylist()
            for rows in slices(texts):
                for k, ids in zip(rows, enc.encode([texts[k] for k in rows]), strict=True):
                    doc_ids.append(keys[k])
                    lengths.append(len(ids) // 4 + 1)
                    coded += [ids, end]
                    held += lengths[-1]
                    if held >= file_ids:
                        yield close()
        if doc_ids:
            yield close()

    ranged.mapInArrow(alone(run), MANIFEST).write.parquet(f"{at}/manifest")
    return at


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files in the folder.

    start is the ids of all ranges before the file's, of the files before it in its range, and before the place in it.
    Files are summed up within their range; only the totals, a row for each range, are summed up in one task.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    totals = manifest.groupBy(F.col("part").alias("of")).agg(F.sum("n_ids").alias("total"))
    ranges = totals.select("of", (F.sum("total").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("ranges"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    before = manifest.select("part", "number", inside.alias("files")).join(ranges, F.col("part") == F.col("of")).select(F.format_string("part-%07d-%06d.ids", "part", "number").alias("file"), (F.col("ranges") + F.col("files")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = PlaneFile(data.as_py())
                ids = f.ids().tobytes()
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                view = memoryview(ids)
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(crc), pa.string()), pa.array(f.doc_ids, pa.int64(), mask=f.nulls), pa.array(starts, pa.int64()), pa.array(f.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["at", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ids").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(alone(run), "at string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(before, rows["at"] == before["file"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
