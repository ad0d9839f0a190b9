import hashlib
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from inkmill.llm import chunk_bpe, token_count, token_planes  # noqa: E402
from inkmill.llm.units import UnitEncoder  # noqa: E402

from .helpers import docs, empty, rows  # noqa: E402

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "12", "!", "$$", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "́", "ﬁ", "\x1c", "字", "İ", "Σ", "\x85", "　", "<|end", "of", "word", "THE", "😀", "\x0b", "​", ".", ",", "é.", "».", "$.", "Word.", "≠"]


def library(path, texts):
    lib = tokenizers.Tokenizer.from_file(path)
    return lib, [x.ids for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_equal_the_library(path):
    rng = random.Random(3)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(3000)]
    enc = UnitEncoder(path, generation=50)
    _, want = library(path, made)
    for k in range(0, len(made), 100):
        assert enc.encode([t.encode() for t in made[k : k + 100]]) == [packed(x) for x in want[k : k + 100]]


def test_token_counts(spark):
    df = docs(spark)
    got = {}
    for r in token_count.token_counts(df, WORD, window=300, overlap=8).collect():
        got.setdefault(r.doc_id, []).append(r)
    src = df.collect()
    assert sum(map(len, got.values())) == len(src)
    _, want = library(WORD, [r.text for r in src])
    for r, ids in zip(src, want, strict=True):
        g = got[r.doc_id][0]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 2048)
    assert max(x[0].n_windows for x in got.values()) > 10
    assert max(x[0].n_widened for x in got.values()) > 3  # the text without white space
    # every text of more than one window goes through windows, with the settings of production too
    for r in token_count.token_counts(df, WORD).collect():
        text = next(x.text for x in src if x.doc_id == r.doc_id) or ""
        assert r.n_tokens == got[r.doc_id][0].n_tokens and (r.n_windows > 1 or r.n_widened > 0) == (len(text) > token_count.WINDOW + token_count.OVERLAP)
    assert token_count.token_counts(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("window,overlap", [(4, 2), (7, 3), (50, 5)])
def test_windows_splice_exactly(window, overlap):
    lib = tokenizers.Tokenizer.from_file(WORD)
    rng = random.Random(window)
    for _ in range(500):
        t = "".join(rng.choices(PIECES, k=rng.randint(1, 40)))
        assert token_count.count_huge(lib, t, window, overlap)[0] == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1000, 50257), (70_000, 300), (5, 2**32 - 1)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        f = token_planes.PlaneFile(token_planes.pack([7, None], [n, 0], ids, chunk=512, bits=bits))
        assert (f.ids() == ids).all() and f.doc_ids.tolist() == [7, 0] and f.nulls.tolist() == [False, True] and f.lengths.tolist() == [n, 0]
        a, b = n // 3, n // 2
        assert (f.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_planes.PlaneFile(b"something else")


@pytest.mark.parametrize("bits", [False, True])
def test_written_tokens(spark, bits):
    df = docs(spark)
    at = token_planes.write_tokens(df, BYTE, bits=bits, file_ids=5000, chunk=700)
    got = token_planes.read_tokens(spark, at).collect()
    src = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    _, want = library(BYTE, [r.text for r in src])
    expect, start = [], 0
    for r, ids in zip(src, want, strict=True):
        expect.append((r.doc_id, start, len(ids) + 1, zlib.crc32(packed([*ids, 0]))))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expect
    low = spark.createDataFrame([(-(2**63), "least"), (None, "null"), (2**63 - 1, "most")], "doc_id LONG, text STRING")
    ids = {r.doc_id: r.start for r in token_planes.read_tokens(spark, token_planes.write_tokens(low, BYTE)).collect()}
    assert sorted(ids, key=ids.get) == [None, -(2**63), 2**63 - 1]
    none = token_planes.write_tokens(empty(spark), BYTE)
    assert token_planes.read_tokens(spark, none).count() == 0


def test_chunk_cuts_depend_on_the_bytes_before_alone():
    rng = random.Random(2)
    body = bytes(rng.randrange(97, 123) for _ in range(20_000))
    a, b = chunk_bpe.cuts(body, 64), chunk_bpe.cuts(b"prefix" * 20 + body, 64)
    assert {x + 120 for x in a if x > 32} <= set(b) and len(a) > 100
    assert chunk_bpe.cuts(b"") == [] and chunk_bpe.cuts(b"abc") == [3]


def test_chunk_encoding(spark):
    df = docs(spark)
    src = df.collect()
    lib, want = library(WORD, [r.text for r in src])
    expect = {r.doc_id: (ids, lib.decode(ids, skip_special_tokens=False)) for r, ids in zip(src, want, strict=True)}
    got = chunk_bpe.encode_documents(df, WORD, average=64).collect()
    assert len(got) == len(src)
    for r in got:
        ids, text = expect[r.doc_id]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert chunk_bpe.encode_documents(empty(spark), WORD).count() == 0


def test_chunks_are_reused_and_forgotten():
    enc = chunk_bpe.ChunkEncoder(WORD, 64, 10_000)
    rng = random.Random(4)
    base = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)).encode()
    lib, (want,) = library(WORD, [base.decode()])
    assert enc.encode([base, base]) == [packed(want)] * 2
    assert enc.reused > 100 and enc.size <= 10_000
    for _ in range(300):
        t = "".join(rng.choices(PIECES, k=rng.randint(1, 200)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode([t.encode()]) == [packed(ids)]
        assert enc.decode(packed(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_clashing_columns_are_ignored(spark):
    got = token_count.token_counts(docs(spark), WORD)
    assert dict(got.dtypes)["n_tokens"] == "bigint" and len(rows(got, "doc_id")) == docs(spark).count()


def test_shared_chunks_are_encoded_once_for_all_workers(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(400))
    texts = [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id LONG, text STRING").repartition(8)
    shared = chunk_bpe.share(df, WORD, 64).value
    own = [{chunk_bpe.key_of(c) for c in chunk_bpe.ChunkEncoder(WORD, 64, 0).parts(t.encode())} for t in texts]
    common = set.intersection(*own)
    assert len(common) > 20 and common <= set(shared.column("key").to_pylist()) and len(set(shared.column("key").to_pylist())) == len(shared)
    rows_ = dict(zip(shared.column("key").to_pylist(), zip(*[shared.column(c).to_pylist() for c in ("head", "ids", "tail", "first", "last")], strict=True), strict=True))
    enc = chunk_bpe.ChunkEncoder(WORD, 64, 10_000_000, rows_)
    _, want = library(WORD, texts)
    assert enc.encode([t.encode() for t in texts]) == [packed(x) for x in want]
    # what all have is encoded by none of the workers that use it
    assert enc.encoded <= sum(map(len, own)) - len(common) * len(texts) and enc.reused >= len(common) * len(texts) and enc.whole == 0
    # the most frequent first, within the budget
    few = chunk_bpe.share(df, WORD, 64, 640).value
    assert 0 < len(few) <= 10 and set(few.column("key").to_pylist()) <= common
    got = {r.doc_id: r.ids for r in chunk_bpe.encode_documents(df, WORD, 64, budget=640).collect()}
    assert got == dict(enumerate(want))


def test_a_join_that_disagrees_is_encoded_whole():
    enc = chunk_bpe.ChunkEncoder(WORD, 64, 10_000_000)
    text = " ".join(f"word{k} and other{k}" for k in range(200)).encode()
    _, (want,) = library(WORD, [text.decode()])
    assert enc.encode([text]) == [packed(want)] and enc.whole == 0
    # insides whose last words aren't what their ids say
    enc.chunks = type(enc.chunks)((k, (*v[:4], b"wrong")) for k, v in enc.chunks.items())
    real = enc.enc.encode
    enc.enc.encode = lambda texts: [x[4:] if b"wrong" in t and t != b"wrong" else x for t, x in zip(texts, real(texts), strict=True)]
    assert enc.encode([text]) == [packed(want)] and enc.whole == 1


def test_workers_map_shared_chunks(spark, monkeypatch):
    t = [" ".join(["some words that all texts have"] * 40) + f" {k} " + "z" * 900 + " end" for k in range(12)]
    df = spark.createDataFrame(list(enumerate([*t, None, "", t[0]])), "doc_id LONG, text STRING").repartition(3)
    at = chunk_bpe.share_mapped(df, WORD, 64)
    enc = chunk_bpe.chunk_encoder(WORD, 64, 10_000, at, at)
    table = chunk_bpe.share(df, WORD, 64).value
    columns = [table.column(c).to_pylist() for c in ("key", "head", "ids", "tail", "first", "last")]
    assert len(enc.shared) == len(table) > 3 and None in columns[2]
    assert all(key in enc.shared and enc.shared.get(key) == tuple(inside) for key, *inside in zip(*columns, strict=True))
    assert b"absent" not in enc.shared and enc.shared.get(b"absent") is None
    # the bytes stay in the file: no worker holds them
    assert not any(isinstance(x, bytes) for _, x in enc.shared.columns)
    _, want = library(WORD, [*t, "", "", t[0]])
    assert {r.doc_id: r.ids for r in chunk_bpe.encode_documents(df, WORD, 64).collect()} == dict(enumerate(want))
    # a store that can't be mapped
    monkeypatch.setattr(chunk_bpe, "local_path", lambda _: None)
    assert {r.doc_id: r.ids for r in chunk_bpe.encode_documents(df, WORD, 64).collect()} == dict(enumerate(want))
