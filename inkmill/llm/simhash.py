"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, connected_components, cut, join_back, map_rows, numbered, text_bytes

BITS = 64
#: Rows of one key that are compared in one go; more are dealt out as pairs of tiles.
TILE = 8192
#: Groups of up to SMALL rows are compared many groups at a time.
SMALL = 48


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the text's word shingles; 0 for a text without words."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    n = len(w) - words + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, beside: list[str] = []) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the long columns beside, a row for each row of docs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words, seed) for x in text_bytes(b)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *beside])

    return map_rows(docs, ["doc_id", "text", *beside], run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *beside]))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, (64, words): bit k of word j of plane b is bit b of fps[64 j + k]; lanes past the end are 0."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes(n: int) -> np.ndarray:
    """Words with the first n lanes set."""
    return np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view("<u8")


def within(differ, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of `valid` whose distance is at most radius. differ(b, at): mismatch words of plane b for the words at `at`.

    Each lane's distance is a vertical counter: three planes go through a full adder at a time (carry-save), and its sum
    and carry are added to the counter's bits, whose overflow marks the lane as lost. Words in which all lanes are lost
    are dropped from the work; when none is left the remaining planes aren't read.
    """
    width = max(1, (radius + 1).bit_length() - ((radius + 1) & radius == 0))
    shape = valid.shape
    valid = valid.ravel()
    at = np.flatnonzero(valid)
    live = valid[at].copy()
    count = [np.zeros(len(at), np.uint64) for _ in range(width)]

    def add(word: np.ndarray, low: int) -> None:
        nonlocal live
        for k in range(low, width):
            word, count[k] = count[k] & word, count[k] ^ word
        live = live & ~word

    for b in range(0, BITS, 3):
        if not len(at):
            break
        x = differ(b, at)
        if b + 2 < BITS:
            y, z = differ(b + 1, at), differ(b + 2, at)
            xy = x ^ y
            total, carry = xy ^ z, (x & y) | (z & xy)
            add(total, 0)
            if width > 1:
                add(carry, 1)
            else:
                live = live & ~carry
        else:
            for c in range(b, BITS):
                add(differ(c, at), 0)
        if b % 12 == 9:
            keep = live != 0
            if not keep.all():
                at, live, count = at[keep], live[keep], [c[keep] for c in count]
    if radius + 1 != 1 << width:  # the counter holds more than the radius: subtract by comparing from the top bit
        more, same = np.zeros_like(live), ~np.zeros_like(live)
        for k in reversed(range(width)):
            bit = np.uint64(0xFFFFFFFFFFFFFFFF if radius >> k & 1 else 0)
            more |= same & count[k] & ~bit
            same &= ~(count[k] ^ bit)
        live = live & ~more
    out = np.zeros(len(valid), np.uint64)
    out[at] = live
    return out.reshape(shape)


def ones(words: np.ndarray) -> np.ndarray:
    """The set lanes' numbers."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little"))


def links_small(fps: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each group, for many small groups at once (rows of a group stand together).

    At offset d, the planes are compared with themselves d lanes further on: all pairs (k, k + d) in one go.
    """
    bits = np.zeros((BITS, len(fps)), np.uint8)
    bits[:] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    own = planes(fps)
    root: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    d = 1
    while True:
        same = group[d:] == group[:-d] if d < len(group) else np.zeros(0, bool)
        if not same.any():
            return out
        valid = np.zeros(own.shape[1] * 64, np.uint8)
        valid[: len(same)] = same
        valid = np.packbits(valid, bitorder="little").view("<u8")

        def differ(b: int, at: np.ndarray, d: int = d) -> np.ndarray:
            moved = np.zeros(own.shape[1] * 64, np.uint8)
            moved[: len(fps) - d] = bits[b, d:]
            return own[b][at] ^ np.packbits(moved, bitorder="little").view("<u8")[at]

        for i in ones(within(differ, valid, radius)).tolist():
            a, b = find(i), find(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, i + d))
        d += 1


def links_large(fps: np.ndarray, radius: int, queries: int = 32) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group: blocks of queries against the planes of the whole group."""
    own, n = planes(fps), len(fps)
    words = own.shape[1]
    comp = np.arange(n)
    out = []
    every = lanes(n)
    for q in range(0, n, queries):
        rows = np.arange(q, min(n, q + queries))
        flip = [np.where((fps[rows] >> np.uint64(b)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)) for b in range(BITS)]
        first = q // 64
        valid = np.tile(every[first:], (len(rows), 1))
        span = words - first

        def differ(b: int, at: np.ndarray, flip=flip, first=first, span=span) -> np.ndarray:
            row, word = np.divmod(at, span)
            return own[b][first + word] ^ flip[b][row]

        live = within(differ, valid, radius)
        for r in np.flatnonzero(live.any(axis=1)).tolist():
            i = q + r
            near = ones(live[r]) + first * 64
            near = near[comp[near] != comp[i]]
            if len(near):
                labels, which = np.unique(comp[near], return_index=True)
                out += [(i, int(near[k])) for k in which]
                comp[np.isin(comp, labels)] = comp[i]
    return out


def links(fps: np.ndarray, starts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect, within each group, all rows at radius or fewer bits; starts: the groups' first rows and len(fps)."""
    size = np.diff(starts)
    out = []
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    if len(small):
        rows = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in small])
        group = np.repeat(small, size[small])
        out += [(int(rows[i]), int(rows[j])) for i, j in links_small(fps[rows], group, radius)]
    for g in np.flatnonzero(size > SMALL).tolist():
        a = int(starts[g])
        out += [(a + i, a + j) for i, j in links_large(fps[a : starts[g + 1]], radius)]
    return out


def keys_of(fp: Column, radius: int) -> Column:
    """Keys such that fingerprints at radius or fewer bits share one: radius + 2 runs of bits, of which two stay equal."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    return F.array(*[(F.lit(k << 2 * width).cast("long").bitwiseOR(F.shiftleft(part[i], width)).bitwiseOR(part[j])).cast("long") for k, (i, j) in enumerate(combinations(range(n), 2))])


def fingerprint_links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of the column fp of `distinct` (each once) that connect all within radius bits.

    Two equal runs of bits out of radius + 2 make the candidates (about 26 bits of key at radius 3, so a key's rows stay
    few until there are billions). Keys with one row go no further. A key with more than `tile` rows is dealt out as
    pairs of tiles, so no task gathers an unbounded group; each task emits a spanning forest, never all pairs.
    """
    rows = distinct.select("fp", F.explode(keys_of(F.col("fp"), radius)).alias("key"))
    n = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    met = rows.join(n, "key").select("fp", "key", own.alias("own"), other.alias("other")).select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def emit(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            fps = cols[0].view(np.uint64)
            found = links(fps, starts, radius)
            a, b = (np.array([cols[0][x[k]] for x in found], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            for c in cols[1:]:
                new[1:] |= c[1:] != c[:-1]
            new[:1] = True
            starts = np.flatnonzero(new)
            if len(starts):
                last = int(starts[-1])
                kept = [c[last:] for c in cols]
                if len(starts) > 1:
                    yield emit([c[:last] for c in cols], starts)
        if len(kept[0]) > 1:
            yield emit(kept, np.array([0, len(kept[0])]))

    return dealt.select("fp", "key", F.col("i").cast("long"), F.col("j").cast("long")).mapInArrow(alone(run), "a long, b long")


def components(fps: DataFrame, radius: int) -> DataFrame:
    """fp, n, group, least for each fingerprint of fps (doc_id, fp): its rows, its component's name, and that one's smallest doc_id."""
    node = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    comp = connected_components(fingerprint_links(node.select("fp"), radius))
    linked = comp.join(node, comp["node"] == node["fp"]).select("fp", "component", "low")
    lowest = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(lowest, "component").select(F.col("fp").alias("at"), "component", "least")
    met = node.join(linked, node["fp"] == linked["at"], "left")
    return cut(met.select("fp", "n", F.coalesce("component", "fp").alias("group"), F.when(F.col("at").isNotNull(), F.col("least")).otherwise(F.col("low")).alias("least")), "components")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row for each row of docs.

    Texts without words, null ones too, have fingerprint zero and link like any other. Rows with a null id take part; a
    component of such rows alone has a null component_id. Repeated rows each keep their row. Other columns are ignored,
    and an empty table gives an empty table. Equal fingerprints are one node, so a group of copies of any size costs a
    row; links and components stay distributed, and what a large group has in common comes back to its rows by broadcast.
    """
    fps = cut(fingerprints(docs, words, seed), "fingerprints")
    met = join_back(fps, components(fps, radius), "fp")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs with one of each component: one with the component's smallest doc_id, null ids last.

    Of rows of one component that share that id the one with the smallest hash of its text stays, and of those that
    share the text too, which may differ in other columns, the first by their JSON form. All columns are kept, whatever
    their names. The rows to keep come back by an equi-join on the id and the text's hash.
    """
    plain = numbered(docs)
    key, text = F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.col(f"c{docs.columns.index('text')}")
    hashed = F.coalesce(F.xxhash64(F.lit(7), text), F.lit(0))
    fps = cut(fingerprints(plain.select(key.alias("doc_id"), text.alias("text"), hashed.alias("hash")), words, seed, ["hash"]), "fingerprints")
    units = fps.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("rows"))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "rows")).alias("one")
    # a fingerprint's best first, by partial aggregates; then the best of its component's fingerprints
    best = units.groupBy("fp").agg(lowest).join(components(fps, radius).select("fp", "group"), "fp")
    keep = cut(best.groupBy("group").agg(F.min("one").alias("one")).select("one.*"), "keep")
    keep = keep.select(F.col("doc_id").alias("id_"), F.col("hash").alias("hash_"), F.col("rows").alias("rows_"))
    met = plain.withColumns({"key": key, "hash": hashed}).join(keep, F.col("key").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")))
    row = F.struct(*plain.columns)
    several = met.where("rows_ > 1").groupBy("id_", "hash_").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return met.where("rows_ = 1").select(*plain.columns).unionByName(several).toDF(*docs.columns)
