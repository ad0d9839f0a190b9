"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, fresh_dir, held, local_path, map_rows, mapped_arrays, text_bytes, write_arrays
from .units import UnitEncoder, slices

#: A chunk ends where the low bits of a rolling hash over the last 32 bytes are all set: AVERAGE bytes on average.
AVERAGE = 1024
#: Bytes of chunks that a Python worker remembers.
KEEP = 48_000_000
#: Bytes of shared chunks that are encoded once for all workers: those that occur most often.
SHARED = 48_000_000
#: Bytes of text encoded and decoded at once.
SLICE = 4_000_000
_HEAD = re.compile(rb"[\t-\r ]")


def gear() -> np.ndarray:
    """256 fixed pseudo-random words, from a hash of each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=4).digest(), "little") for k in range(256)], np.uint32)


GEAR = gear()


def cuts(data: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of the chunks of data, the last one len(data). Each depends on the 32 bytes before it alone."""
    n = len(data)
    if n <= 32:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i]: over 2k bytes after the step; shifts weigh older bytes more
        older = h[:-k] << np.uint32(k)
        h[k:] += older
    mask = np.uint32((average - 1) << 16)
    ends = (np.flatnonzero((h & mask) == mask) + 1).tolist()
    ends = [e for e in ends if 32 <= e < n]
    return [*ends, n]


def key_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class SharedChunks:
    """The insides of chunks by key, as inside() gives them, from mapped arrays: a worker holds the keys alone."""

    COLUMNS = ("head", "ids", "tail", "first", "last")

    def __init__(self, x: dict[str, np.ndarray]):
        keys = x["keys"].tobytes()
        self.row = {keys[k : k + 16]: k // 16 for k in range(0, len(keys), 16)}
        self.null = x["null"]
        self.columns = [(memoryview(x[f"{c}_at"]), memoryview(x[c])) for c in self.COLUMNS]

    @classmethod
    def arrays(cls, rows: pa.Table) -> dict[str, np.ndarray]:
        """What the constructor takes, of rows (key and COLUMNS, all binary)."""
        x = {"keys": np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8), "null": rows.column("ids").is_null().to_numpy()}
        for c in cls.COLUMNS:
            values = [v or b"" for v in rows.column(c).to_pylist()]
            x[f"{c}_at"], x[c] = np.append(0, np.cumsum([len(v) for v in values], dtype=np.int64)), np.frombuffer(b"".join(values), np.uint8)
        return x

    def __contains__(self, key: bytes) -> bool:
        return key in self.row

    def __len__(self) -> int:
        return len(self.row)

    def get(self, key: bytes) -> tuple | None:
        if (k := self.row.get(key)) is None:
            return None
        head, ids, tail, first, last = (bytes(data[at[k] : at[k + 1]]) for at, data in self.columns)
        return head, None if self.null[k] else ids, tail, first, last


class ChunkEncoder:
    """Encodes whole texts chunk by chunk, remembering chunks, and decodes ids as the library does.

    A chunk that is shared (see encoded_chunks()) comes encoded; any other is encoded once however many texts of this
    worker have it, as long as it is remembered. What is kept is its inside: the ids between the first and the last white space, with
    the bytes left over at either end and the first and last word inside. At a join, what both sides left over is
    encoded anew between the last word of the one inside and the first word of the other. The new ids must agree exactly
    with what both insides have for these words; a text with a join that doesn't is encoded whole. Where a chunk holds no
    white space the piece grows by the whole chunk and goes on to the next join.
    """

    def __init__(self, path: str, average: int, keep: int, shared: dict[bytes, tuple] | SharedChunks | None = None):
        self.enc = UnitEncoder(path)
        if not self.enc.word:
            raise ValueError("chunk reuse needs a tokenizer that drops white space")
        self.average, self.keep, self.size = average, keep, 0
        self.shared = shared or {}
        self.chunks: OrderedDict[bytes, tuple] = OrderedDict()
        self.reused = self.encoded = self.whole = 0
        self.tokens: list[str] | None = None

    def parts(self, text: bytes) -> list[bytes]:
        ends = cuts(text, self.average)
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def inside(self, chunks: list[bytes]) -> list[tuple]:
        """(left over before, inner ids, left over after, first word, last word) of each; ids None without white space."""
        spans = []
        for c in chunks:
            m = _HEAD.search(c)
            if m is None:
                spans.append((c, None, b""))
                continue
            a = m.start()
            z = max(c.rfind(x) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            spans.append((c[:a], c[a:z], c[z:]))
        ids = iter(self.enc.encode([m for _, m, _ in spans if m is not None]))
        out = []
        for head, middle, tail in spans:
            first, last = (middle or b"").split(None, 1)[:1], (middle or b"").rsplit(None, 1)[-1:]
            out.append((head, None if middle is None else next(ids), tail, b"".join(first).strip(), b"".join(last).strip()))
        self.encoded += len(chunks)
        return out

    def remember(self, key: bytes, value: tuple) -> None:
        self.chunks[key] = value
        self.size += 300 + sum(len(x) for x in value if x)

    def forget(self) -> None:
        while self.size > self.keep and self.chunks:
            _, value = self.chunks.popitem(last=False)
            self.size -= 300 + sum(len(x) for x in value if x)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        keyed, missing = [], {}
        for t in texts:
            own = []
            for c in self.parts(t):
                key = key_of(c)
                own.append(key)
                if key in self.shared or key in missing:
                    self.reused += 1
                elif key in self.chunks:
                    self.chunks.move_to_end(key)
                    self.reused += 1
                else:
                    missing[key] = c
            keyed.append(own)
        for key, value in zip(missing, self.inside(list(missing.values())), strict=True):
            self.remember(key, value)
        plans, joins = [], []  # joins: the last word before, what is left over, the first word after
        for own in keyed:
            plan, piece, before = [], [], b""
            for key in own:
                head, ids, tail, first, last = self.shared.get(key) or self.chunks[key]
                piece.append(head)
                if ids is not None:
                    if joint := b"".join(piece):
                        plan.append(len(joins))
                        joins.append((before, joint, first))
                    plan.append(ids)
                    piece, before = [tail], last
            if joint := b"".join(piece):
                plan.append(len(joins))
                joins.append((before, joint, b""))
            plans.append(plan)
        around = self.enc.encode([b" ".join(j) for j in joins])
        words = list({w for before, _, after in joins for w in (before, after)})
        known = dict(zip(words, self.enc.encode(words), strict=True))
        done: list[bytes | None] = []
        for (before, _, after), ids in zip(joins, around, strict=True):
            a, z = known[before], known[after]
            agreed = len(ids) >= len(a) + len(z) and ids.startswith(a) and ids.endswith(z)
            done.append(ids[len(a) : len(ids) - len(z)] if agreed else None)
        out = []
        for text, plan in zip(texts, plans, strict=True):
            found = [x if isinstance(x, bytes) else done[x] for x in plan]
            if None in found:
                self.whole += 1
                found = [np.array(self.enc.lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()]
            out.append(b"".join(found))
        self.forget()
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a tokenizer without a decoder: tokens, space-joined.

        Ids that the vocabulary doesn't have are left out.
        """
        lib = self.enc.lib
        if lib.decoder is not None:
            return lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        if self.tokens is None:
            vocab = lib.get_vocab(with_added_tokens=True)
            self.tokens = [None] * (max(vocab.values(), default=-1) + 1)
            for token, k in vocab.items():
                self.tokens[k] = token
        names, n = self.tokens, len(self.tokens)
        got = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(names.__getitem__, got))
        except (IndexError, TypeError):
            return " ".join(names[k] for k in got if k < n and names[k] is not None)


def encoded_chunks(docs: DataFrame, tokenizer: str, average: int, budget: int) -> pa.Table:
    """The insides of chunks that occur more than once in docs (text), each encoded once in the whole run.

    Tasks count chunks by hash, and only hashes and counts are shuffled; the most frequent ones are chosen, `budget`
    bytes of them at most, so what is returned is bounded. Each then comes from one of the tasks that meet it, and is
    encoded by one. Shared chunks beyond the budget are encoded by each worker that meets them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            size = {}
            for text in text_bytes(b):
                ends = cuts(text, average)
                for x, y in zip([0, *ends], ends, strict=False):
                    key = key_of(text[x:y])
                    n[key] += 1
                    size[key] = y - x
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([size[k] for k in n], pa.int64())], names=["key", "n", "size"])

    found = map_rows(docs, ["text"], count, "key binary, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    often = found.where((F.col("n") > 1) & (F.col("size") <= 16 * average)).orderBy(F.col("n").desc(), "key").limit(max(1, budget // average)).toArrow()
    fits = np.cumsum(often.column("size").to_numpy()) <= budget
    chosen = frozenset(often.column("key").filter(pa.array(fits)).to_pylist())

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(chosen)
        for b in batches:
            got = {}
            for text in text_bytes(b):
                ends = cuts(text, average)
                for x, y in zip([0, *ends], ends, strict=False):
                    if (key := key_of(text[x:y])) in left:
                        left.discard(key)
                        got[key] = text[x:y]
            yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()), pa.array(got.values(), pa.binary())], names=["key", "chunk"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer, average, 0, None, "")
        for b in batches:
            values = enc.inside(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([v[k] for v in values], pa.binary()) for k in range(5))], names=["key", "head", "ids", "tail", "first", "last"])

    once = map_rows(docs, ["text"], bring, "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))
    return once.mapInArrow(alone(inside), "key binary, head binary, ids binary, tail binary, first binary, last binary").toArrow()


def share(docs: DataFrame, tokenizer: str, average: int = AVERAGE, budget: int = SHARED) -> Broadcast:
    """encoded_chunks() for all workers, each of which holds a copy."""
    return docs.sparkSession.sparkContext.broadcast(encoded_chunks(docs, tokenizer, average, budget))


def share_mapped(docs: DataFrame, tokenizer: str, average: int = AVERAGE, budget: int = SHARED) -> Broadcast | str:
    """encoded_chunks() as the folder of a SharedChunks, of which all workers of a machine map one copy.

    A shared folder that isn't in the local file system can't be mapped: there it is share().
    """
    at = local_path(fresh_dir(docs.sparkSession, "chunks"))
    if not at:
        return share(docs, tokenizer, average, budget)
    write_arrays(at, SharedChunks.arrays(encoded_chunks(docs, tokenizer, average, budget)))
    return at


def chunk_encoder(path: str, average: int, keep: int, shared: Broadcast | str | None, name: str) -> ChunkEncoder:
    """A Python worker's encoder, kept over its tasks, so that chunks are reused across them as well."""

    def make() -> ChunkEncoder:
        if shared is None:
            return ChunkEncoder(path, average, keep)
        if isinstance(shared, str):
            return ChunkEncoder(path, average, keep, SharedChunks(mapped_arrays(shared)))
        rows = shared.value
        if hasattr(shared, "_path"):  # the worker may read it again from there
            vars(shared).pop("_value", None)
        columns = [rows.column(c).to_pylist() for c in ("head", "ids", "tail", "first", "last")]
        return ChunkEncoder(path, average, keep, dict(zip(rows.column("key").to_pylist(), zip(*columns, strict=True), strict=True)))

    return held(("chunks", path, average, keep, name), make)


def encode_documents(docs: DataFrame, tokenizer: str, average: int = AVERAGE, keep: int = KEEP, with_output: bool = True, budget: int = SHARED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_output, ids and decoded: a row for each row of docs.

    Null texts are empty: no ids, an empty decoded text. Null ids and repeated rows pass through; other columns are
    ignored; an empty table gives an empty table. Tokenizers that keep white space raise ValueError. Shared chunks are
    found and encoded first (see encoded_chunks()); then one pass without a shuffle.
    """
    shared, name = share_mapped(docs, tokenizer, average, budget), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer, average, keep, shared, name)
        for b in batches:
            texts = text_bytes(b)
            for rows in slices(texts, SLICE):
                ids = enc.encode([texts[k] for k in rows])
                decoded = [enc.decode(x) for x in ids]
                cols = [
                    b.column(0).take(pa.array(rows)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if with_output:
                    values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, ["doc_id", "text"], run, schema + ", ids array<int>, decoded string" * with_output)
