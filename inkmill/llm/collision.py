"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_back

#: Distinct vectors of a label that one task holds of either side of a comparison.
TILE = 4096
#: Vectors around which a label's tiles gather, at most.
PIVOTS = 64
PROJECTIONS = 48
#: Half a window, as a multiple of the standard deviation of a pair at the threshold.
REACH = 1.0
MISS = 1e-4


def calibrate(cosine: float, projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> tuple[float, int]:
    """(half window, collisions asked for).

    On a Gaussian direction two unit vectors of that cosine differ by a normal value of variance 2 - 2 cosine, so each
    projection puts one in the other's window with a known probability, independently. The count asked for is the
    largest that such a pair misses with a probability of at most `miss`; closer pairs miss it more rarely.
    """
    spread = math.sqrt(max(2 - 2 * cosine, 1e-12))
    p = math.erf(reach / math.sqrt(2))
    tail, need = 0.0, 0
    for k in range(projections + 1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail > miss:
            break
        need = k + 1
    return reach * spread, need


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so tiny and huge ones neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def candidate_pairs(left: np.ndarray, right: np.ndarray, same: bool, cosine: float, projections: int, seed: int, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of left and right (unit vectors) that collide in enough windows, a block of queries at a time.

    Each projection sorts the right side once. A query's window is a run of that order, found by binary search around
    its own projected value; its members' counters go up by one. Counters take a block of queries by the tile.
    """
    half, need = calibrate(cosine, projections)
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((left.shape[1], projections))
    pl, pr = left @ lines, right @ lines
    order = np.argsort(pr, axis=0, kind="stable")
    n = len(right)
    for q in range(0, len(left), chunk):
        rows = np.arange(q, min(len(left), q + chunk))
        count = np.zeros((len(rows), n), np.uint8)
        for k in range(projections):
            ordered = pr[order[:, k], k]
            lo = np.searchsorted(ordered, pl[rows, k] - half, "left").tolist()
            hi = np.searchsorted(ordered, pl[rows, k] + half, "right").tolist()
            at = order[:, k]
            for r in range(len(rows)):
                if hi[r] > lo[r]:
                    count[r, at[lo[r] : hi[r]]] += 1
        i, j = np.nonzero(count >= need)
        i = i + q
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def gap(cosine: float) -> float:
    """How far two unit vectors of at least that cosine can be apart along any direction."""
    return math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-9


def place(vectors: DataFrame, tile: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(vectors with the tile of each; the tiles with the interval that their vectors take along each direction).

    A label's vectors gather around pivots: one for every quarter of a tile's rows, PIVOTS at most, the unit vectors of
    rows with the smallest hash. A cell of more than `tile` rows is dealt by hash into several tiles. The directions are
    the pivots; a dimension without a pivot has no intervals and one cell.
    """
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "node"), "node").select("v").limit(PIVOTS).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r["v"]) for r in some}:
        pivots[dim] = unit_rows(np.array([r["v"] for r in some if len(r["v"]) == dim], np.float64))
    n = vectors.groupBy(F.col("label").alias("of"), F.col("dim").alias("d")).agg(F.least(F.lit(PIVOTS), F.ceil(4 * F.count("*") / tile)).cast("int").alias("cells"))
    sized = vectors.join(n, (F.col("label") == F.col("of")) & (F.col("dim") == F.col("d"))).drop("of", "d")

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.assign(cell=np.int32(0))
            for dim, part in pdf.groupby("dim"):
                if dim in pivots:
                    dots = unit_rows(np.stack(part["v"].to_list()).astype(np.float64)) @ pivots[dim].T
                    dots[np.arange(dots.shape[1])[None, :] >= part["cells"].to_numpy()[:, None]] = -2.0
                    pdf.loc[part.index, "cell"] = dots.argmax(axis=1).astype(np.int32)
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields)
    celled = cut(sized.mapInPandas(nearest, f"{kinds}, cell int").drop("cells"), "cells")
    parts = celled.groupBy(F.col("label").alias("of"), F.col("dim").alias("d"), F.col("cell").alias("c")).agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
    met = celled.join(parts, (F.col("label") == F.col("of")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))).drop("of", "d", "c")
    placed = met.withColumn("tile", F.col("cell") + PIVOTS * F.pmod(F.xxhash64("node"), F.col("parts"))).drop("cell", "parts")

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        if dim in pivots:
            along = unit_rows(np.stack(pdf["v"].to_list()).astype(np.float64)) @ pivots[dim].T
            low, high = along.min(axis=0).tolist(), along.max(axis=0).tolist()
        else:
            low = high = []
        return pd.DataFrame([(pdf["label"].iloc[0], dim, int(pdf["tile"].iloc[0]), low, high)], columns=["label", "dim", "tile", "low", "high"])

    kind = vectors.schema["label"].dataType.simpleString()
    return placed, cut(placed.groupBy("label", "dim", "tile").applyInPandas(span, f"label {kind}, dim int, tile long, low array<double>, high array<double>"), "tiles")


def tile_pairs(tiles: DataFrame, cosine: float) -> DataFrame:
    """label, dim, i, j (i <= j): the pairs of tiles that may hold a link; those further apart than gap() along a direction can't."""
    a = tiles.select("label", "dim", F.col("tile").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    b = tiles.select("label", "dim", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    apart = F.zip_with("low_i", "high_j", lambda x, y: x - y > gap(cosine)), F.zip_with("low_j", "high_i", lambda x, y: x - y > gap(cosine))
    far = F.exists(apart[0], lambda x: x) | F.exists(apart[1], lambda x: x)
    return a.join(b, ["label", "dim"]).where((F.col("i") <= F.col("j")) & ~far).select("label", "dim", "i", "j")


def vector_links(vectors: DataFrame, cosine: float, projections: int, tile: int, seed: int) -> DataFrame:
    """Links among `vectors` (label, dim, node, v: distinct unit vectors, node a unique long): rows (node, n_links, other).

    Rows with other = node carry the count, the rest are the forest (n_links 0).
    A label's vectors are gathered into tiles, and each pair of tiles that are near enough is compared by a task of its
    own; a label of any size only makes more of them. A task emits for each vector how many copies it links with
    (n_links), and a spanning forest of its links (other), so its output is linear in the tile. copies: the column of how
    many rows a vector stands for.
    """
    placed, tiles = place(vectors, tile, seed)
    pairs = cut(tile_pairs(tiles, cosine), "pairs")
    sides = pairs.select("label", "dim", F.col("i").alias("tile"), "i", "j").unionByName(pairs.where("i <> j").select("label", "dim", F.col("j").alias("tile"), "i", "j"))
    met = placed.join(sides, ["label", "dim", "tile"]).select("label", "dim", "node", "copies", "v", F.col("tile").alias("own"), "i", "j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = pdf[pdf["own"] == i]
        b = a if i == j else pdf[pdf["own"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["node", "n_links", "other"]).astype("int64")
        left = unit_rows(np.stack(a["v"].to_list()).astype(np.float64))
        right = left if i == j else unit_rows(np.stack(b["v"].to_list()).astype(np.float64))
        nodes_a, nodes_b = a["node"].to_numpy(), b["node"].to_numpy()
        copies_a, copies_b = a["copies"].to_numpy(), b["copies"].to_numpy()
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        comp_a, comp_b = np.arange(len(a)), (np.arange(len(a)) if i == j else np.arange(len(b)) + len(a))
        if i == j:
            comp_b = comp_a
        forest: list[tuple[int, int]] = []
        for x, y in candidate_pairs(left, right, i == j, cosine, projections, seed):
            for k in range(0, len(x), 100_000):
                p, q = x[k : k + 100_000], y[k : k + 100_000]
                ok = np.einsum("ij,ij->i", left[p], right[q]) >= cosine
                p, q = p[ok], q[ok]
                np.add.at(links_a, p, copies_b[q])
                np.add.at(links_b, q, copies_a[p])
                apart = comp_a[p] != comp_b[q]
                while apart.any():
                    s = int(np.flatnonzero(apart)[0])
                    forest.append((int(nodes_a[p[s]]), int(nodes_b[q[s]])))
                    old, now = comp_b[q[s]], comp_a[p[s]]
                    comp_b[comp_b == old] = now
                    comp_a[comp_a == old] = now
                    p, q, apart = p[s + 1 :], q[s + 1 :], apart[s + 1 :]
                    p, q = p[apart], q[apart]
                    apart = comp_a[p] != comp_b[q]
        if i == j:
            links_a = links_a + links_b
            counted = [(v, c) for v, c in zip(nodes_a.tolist(), links_a.tolist(), strict=True) if c]
        else:
            counted = [(v, c) for v, c in [*zip(nodes_a.tolist(), links_a.tolist(), strict=True), *zip(nodes_b.tolist(), links_b.tolist(), strict=True)] if c]
        rows = [(v, c, v) for v, c in counted] + [(u, 0, w) for u, w in forest]
        return pd.DataFrame(rows, columns=["node", "n_links", "other"]).astype("int64")

    return met.groupBy("label", "dim", "i", "j").applyInPandas(compare, "node long, n_links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, projections: int = PROJECTIONS, tile: int = TILE, seed: int = 6) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors of one label (not null) link at cosine or more, in double precision. Equal vectors of a label are compared
    once and count as often as they occur, so copies cost nothing beyond their rows. Null, empty and zero vectors, and
    those that hold null or non-finite components, link with nothing; vectors of different lengths don't link. Rows with
    a null vec_id link and count, but lend no id; a row's component_id is its own vec_id where nothing links. Repeated
    rows are rows of their own. Other columns are ignored; an empty table gives an empty table.
    """
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    good = F.coalesce(v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # 0.0 is added so that -0.0 and 0.0 are one vector
    rows = vectors.select("vec_id", "label", F.when(good, F.transform(v, lambda x: x + F.lit(0.0).cast(kind))).alias("v"))
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = cut(distinct.select("label", "v", "copies", "low", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    found = cut(vector_links(nodes, cosine, projections, tile, seed), "links")
    comp = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = comp.join(nodes.select(F.col("node").alias("at"), "low"), F.col("node") == F.col("at")).select("node", "component", "low")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(least, "component").select("node", F.col("least"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    facts = nodes.select("node", "label", "v", "copies", "low").join(counts, "node", "left").join(linked.withColumn("in_comp", F.lit(True)), "node", "left")
    facts = facts.select(
        F.struct("label", "v").alias("key"),
        F.col("copies").alias("n"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("in_comp"), F.col("least")).otherwise(F.col("low")).alias("component_id"),
    )
    # rows without a vector that may link never meet the others, so they aren't gathered by their null
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    met = join_back(rows.where("v is not null").select("vec_id", F.struct("label", "v").alias("key")), cut(facts, "facts"), "key")
    every = met.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")).unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
