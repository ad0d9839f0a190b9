"""Exact inner-product top-k by best-first search in M-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a tree, entries of a leaf, routing objects of an inner node, queries that meet a tree in one task.
TREE, LEAF, FAN, QUERIES = 8192, 96, 12, 2048
#: Pivots around which rows are gathered into cells: one for every CELL rows, PIVOTS at most.
CELL, PIVOTS = 1024, 256
PAGE = "cell int, tree long, dim int, page int, leaf boolean, n int, norm2 double, ids binary, nones binary, vectors binary, radii binary, to_parent binary, children binary"
LONG = (1 << 63) - 1


def lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """x with a last component that brings every row to the same length; distances to a query then fall as the score rises."""
    own = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - own, 0))[:, None]], axis=1)


def build_pages(ids: np.ndarray, vectors: np.ndarray, nones: np.ndarray | None = None, norm2: float | None = None, seed: int = 9) -> list[dict]:
    """The pages of one M-tree, root first. vectors: whole numbers as int64, a row each; nones: which ids are null.

    norm2: the squared length that rows are lifted to, at least the greatest of theirs, which it is by default.

    An inner page holds routing objects (rows of the tree) with the radius that covers their subtree and their distance
    to the page's own routing object; a leaf holds rows with their distance to it.
    """
    x = vectors.astype(np.float64)
    norm2 = float((x * x).sum(axis=1).max(initial=0.0)) if norm2 is None else norm2
    nones = np.zeros(len(ids), bool) if nones is None else nones
    up = lift(x, norm2)
    rng = np.random.default_rng(seed)
    pages: list[dict] = []

    def dist(rows: np.ndarray, center: np.ndarray | None) -> np.ndarray:
        return np.zeros(len(rows)) if center is None else np.sqrt(((up[rows] - center) ** 2).sum(axis=1))

    def grow(rows: np.ndarray, center: np.ndarray | None) -> int:
        at = len(pages)
        pages.append({})
        if len(rows) <= LEAF:
            pages[at] = {"leaf": True, "ids": ids[rows], "nones": nones[rows], "vectors": vectors[rows], "radii": np.zeros(0), "to_parent": dist(rows, center), "children": np.zeros(0, np.int64)}
            return at
        pivots = rows[rng.choice(len(rows), min(FAN, len(rows)), replace=False)]
        near = np.argmin(np.stack([dist(rows, up[p]) for p in pivots]), axis=0)
        parts = [(p, rows[near == k]) for k, p in enumerate(pivots) if (near == k).any()]
        if len(parts) == 1:  # all rows alike: cut by count
            parts = [(pivots[0], part) for part in np.array_split(rows, FAN)]
        kept, radii, children = [], [], []
        for p, part in parts:
            kept.append(p)
            radii.append(dist(part, up[p]).max())
            children.append(grow(part, up[p]))
        kept = np.array(kept)
        pages[at] = {"leaf": False, "ids": ids[kept], "nones": nones[kept], "vectors": vectors[kept], "radii": np.array(radii), "to_parent": dist(kept, center), "children": np.array(children, np.int64)}
        return at

    grow(np.arange(len(ids)), None)
    return [p | {"page": k, "norm2": norm2} for k, p in enumerate(pages)]


class Tree:
    """Answers queries from the pages of one tree; counts the distances it computes and those the bounds spare it."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        self.norm2 = float(pages["norm2"].iloc[0])
        self.pages = {}
        for p in pages.itertuples():
            v = np.frombuffer(p.vectors, "<i8").reshape(-1, dim)
            self.pages[p.page] = (bool(p.leaf), np.frombuffer(p.ids, "<i8"), v, v.astype(np.float64), np.frombuffer(p.radii, "<f8"), np.frombuffer(p.to_parent, "<f8"), np.frombuffer(p.children, "<i8"), np.frombuffer(p.nones, bool))
        self.top = max((float(np.abs(x[3]).max(initial=0)) for x in self.pages.values()), default=0.0)
        self.dim = dim
        self.computed = self.spared = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int | None]]:
        """The k best (score, vec_id) of all rows whose id isn't `own`, ties to the smaller id, null ids last.

        floor: a score that k rows of other trees reach; rows below it are left out.
        """
        qf = q.astype(np.float64)
        q2 = float(qf @ qf)
        whole = q2 + self.norm2
        slack = 1e-9 * math.sqrt(whole) + 1e-9
        exact = self.top * float(np.abs(qf).max(initial=0)) * self.dim < 2**52
        best: list[tuple[int, bool, int]] = []  # (score, has an id, -id), the worst first
        heap = [(0.0, 0, 0, -1.0)]  # least distance, order, page, distance from the query to its routing object
        order = 0
        while heap:
            least, _, page, from_parent = heapq.heappop(heap)
            far = math.inf
            if len(best) == k or floor is not None:
                # beyond this distance every score is below the k-th
                at_least = best[0][0] if len(best) == k else floor
                far = reach(whole, at_least if floor is None else max(at_least, floor), slack)
                if least > far:
                    break
            leaf, ids, vectors, floats, radii, to_parent, children, nones = self.pages[page]
            if from_parent >= 0 and far < math.inf:
                bound = np.abs(from_parent - to_parent)
                at = np.flatnonzero(bound - slack <= (far if leaf else far + radii))
                self.spared += len(ids) - len(at)
            else:
                at = np.arange(len(ids))
            if not len(at):
                continue
            self.computed += len(at)
            dots = floats[at] @ qf if exact else np.array([sum(a * b for a, b in zip(vectors[i].tolist(), q.tolist(), strict=True)) for i in at], object)
            if leaf:
                for s, i, none in zip(dots.tolist(), ids[at].tolist(), nones[at].tolist(), strict=True):
                    if i == own and not none or floor is not None and s < floor:
                        continue
                    item = (int(s), not none, 0 if none else -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            else:
                d = np.sqrt(np.maximum(whole - 2 * dots.astype(np.float64), 0.0))
                low = np.maximum(d - radii[at] - slack, 0.0)
                for x, y, c in zip(low.tolist(), d.tolist(), children[at].tolist(), strict=True):
                    if x <= far:
                        order += 1
                        heapq.heappush(heap, (x, order, c, y))
        return [(s, -i if known else None) for s, known, i in sorted(best, reverse=True)]


def reach(whole: float, score: float, slack: float) -> float:
    """The distance beyond which every row's score is below `score`; whole: the squared lengths of query and rows together."""
    return math.sqrt(max(whole - 2 * score, 0.0)) * (1 + 1e-9) + slack


def whole_numbers(v: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null where the vector is null, empty or holds a null or non-finite component."""
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return F.when(good, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Cells:
    """Pivots by dimension; a row's cell is its nearest pivot. Rows of a dimension without a pivot are in cell -1."""

    def __init__(self, pivots: dict[int, np.ndarray], norm2: dict[int, float]):
        self.norm2 = norm2
        self.pivots, n = {}, 0
        for dim, x in pivots.items():
            self.pivots[dim] = (n, lift(x.astype(np.float64), norm2[dim]))
            n += len(x)

    def distances(self, up: np.ndarray, dim: int) -> np.ndarray:
        first, at = self.pivots[dim]
        return np.sqrt(np.maximum((up * up).sum(axis=1)[:, None] + (at * at).sum(axis=1) - 2 * up @ at.T, 0))

    def of(self, vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) of each row."""
        if dim not in self.pivots:
            return np.full(len(vectors), -1), np.full(len(vectors), math.inf)
        d = self.distances(lift(np.stack(vectors).astype(np.float64), self.norm2[dim]), dim)
        near = d.argmin(axis=1)
        return self.pivots[dim][0] + near, d[np.arange(len(d)), near]

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of the query's dimension, its distances from their pivots)."""
        if len(q) not in self.pivots:
            return np.array([-1]), np.zeros(1)
        d = self.distances(np.append(q.astype(np.float64), 0.0)[None, :], len(q))[0]
        return self.pivots[len(q)][0] + np.arange(len(d)), d


def choose_cells(vectors: DataFrame, per_cell: int = CELL, pivots: int = PIVOTS, seed: int = 9) -> Cells:
    """Cells around a bounded number of rows of vectors (v), those with the smallest hash."""
    dims = vectors.groupBy(F.size("v").alias("dim")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2"), F.count("*").alias("n"))
    known = dims.orderBy(F.col("n").desc(), "dim").limit(pivots).collect()
    n = min(pivots, -(-sum(r["n"] for r in known) // per_cell))
    some = vectors.select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v")).limit(n).collect()
    norm2 = {r["dim"]: r["norm2"] for r in known}
    by: dict[int, list] = {}
    for r in some:
        if len(r["v"]) in norm2:
            by.setdefault(len(r["v"]), []).append(r["v"])
    return Cells({dim: np.array(x, np.int64) for dim, x in by.items()}, norm2)


def deal(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vectors (vec_id, v) with none (whether vec_id is null; it is 0 then), dim, cell and the distance from the cell's pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.assign(dim=pdf["v"].map(len).astype("int32"), cell=np.int32(-1), away=math.inf)
            for dim, part in pdf.groupby("dim"):
                cell, away = cells.of(part["v"].tolist(), int(dim))
                pdf.loc[part.index, "cell"], pdf.loc[part.index, "away"] = cell.astype(np.int32), away
            yield pdf

    known = vectors.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("none"), "v")
    return known.mapInPandas(run, "vec_id long, none boolean, v array<long>, dim int, cell int, away double")


def build_index(dealt: DataFrame, rows_per_tree: int = TREE) -> DataFrame:
    """The pages (see PAGE) of a forest of M-trees over rows that deal() gives: one row a page, written to the shared folder.

    A cell is one tree, or several dealt by hash where it holds more than rows_per_tree, so a tree is built and searched
    in bounded memory however many rows gather around a pivot. All rows of one length are lifted alike.
    """
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = dealt.groupBy(F.col("dim").alias("of")).agg(F.max(square).alias("norm2"))
    n = dealt.groupBy(F.col("dim").alias("d"), F.col("cell").alias("c")).agg(F.ceil(F.count("*") / rows_per_tree).cast("long").alias("trees"))
    met = dealt.join(n, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))).join(top, F.col("dim") == F.col("of"))
    placed = met.select("vec_id", "none", "v", "dim", "cell", "norm2", F.pmod(F.xxhash64("vec_id", "none", "v"), F.col("trees")).alias("tree"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=pdf["v"].map(bytes_of)).sort_values(["none", "vec_id", "key"], kind="stable")
        pages = build_pages(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.int64), pdf["none"].to_numpy(bool), float(pdf["norm2"].iloc[0]))
        out = pd.DataFrame([{"page": p["page"], "leaf": p["leaf"], "n": len(p["ids"]), "norm2": p["norm2"]} | {c: p[c].astype(t).tobytes() for c, t in (("ids", "<i8"), ("nones", bool), ("vectors", "<i8"), ("radii", "<f8"), ("to_parent", "<f8"), ("children", "<i8"))} for p in pages])
        return out.assign(cell=int(pdf["cell"].iloc[0]), tree=int(pdf["tree"].iloc[0]), dim=int(pdf["dim"].iloc[0]))[[c.split()[0] for c in PAGE.split(", ")]]

    return cut(placed.groupBy("dim", "cell", "tree").applyInPandas(build, PAGE), "mtree")


def bytes_of(v) -> bytes:
    return np.asarray(v, "<i8").tobytes()


FOUND = "query_id long, row long, vec_id long, none boolean, score long, computed long"


def search_trees(pages: DataFrame, asked: DataFrame, k: int, queries_per_task: int) -> DataFrame:
    """What the queries of asked (query_id, row, q, dim, cell, tree, bounded, floor) find in the trees they name: FOUND.

    computed, of a row for each query and tree with a null score, is how many distances it took. A tree meets its queries
    in blocks: a task has the pages of one tree and about queries_per_task queries.
    """
    on = ["dim", "cell", "tree"]
    blocks = cut(asked.groupBy(*on).agg(F.ceil(F.count("*") / queries_per_task).cast("long").alias("blocks")), "blocks")
    left = pages.join(blocks, on).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).drop("blocks")
    right = asked.join(blocks, on).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")

    def answer(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(queries):
            tree = Tree(own, int(own["dim"].iloc[0]))
            for query_id, row, q, bounded, floor in zip(queries["query_id"].tolist(), queries["row"].tolist(), queries["q"], queries["bounded"].tolist(), queries["floor"].tolist(), strict=True):
                before = tree.computed
                got = tree.search(np.asarray(q, np.int64), query_id, k, floor if bounded else None)
                found += [(query_id, row, 0 if i is None else i, i is None, max(-LONG - 1, min(LONG, s)), 0) for s, i in got]
                found.append((query_id, row, 0, False, None, tree.computed - before))
        out = pd.DataFrame(found, columns=["query_id", "row", "vec_id", "none", "score", "computed"])
        return out.astype({c: "int64" for c in ("query_id", "row", "vec_id", "computed")} | {"none": bool, "score": "Int64"})

    return left.groupBy(*on, "block").cogroup(right.groupBy(*on, "block")).applyInPandas(answer, FOUND)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, rows_per_tree: int = TREE, queries_per_task: int = QUERIES, per_cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of `vectors` (vec_id, embedding) by integer inner product.

    Queries: rows whose vec_id is divisible by `every`; candidates: every row but those with the query's vec_id. Vectors
    that are null, empty, or hold null or non-finite components take no part; only vectors of equal length meet. Ties go
    to the smaller vec_id, null ids last (such rows are candidates, never queries). Equal query rows ask once; rows of
    one id with different vectors each ask. A score outside a long stops at its end. Other columns are ignored; empty
    tables give empty tables.
    """
    return ranked(search(vectors, k, every, scale, rows_per_tree, queries_per_task, per_cell), k)


def search(vectors: DataFrame, k: int, every: int, scale: float, rows_per_tree: int, queries_per_task: int, per_cell: int) -> DataFrame:
    """FOUND, for top_k: what each query finds in the trees it visits.

    A query first searches one tree of the nearest cell. Its k-th score there is a floor; then it visits the trees of
    those cells alone whose ball comes near enough to reach the floor, and there the floor prunes from the start. Cells
    are known to the driver by their pivots, radii and numbers of trees, one entry for each of a bounded number.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v")).where("v is not null"), "whole")
    cells = choose_cells(rows, per_cell)
    dealt = cut(deal(rows, cells), "dealt")
    pages = build_index(dealt, rows_per_tree)
    radius = {r["cell"]: r["away"] for r in dealt.where("cell >= 0").groupBy("cell").agg(F.max("away").alias("away")).collect()}
    trees = cut(pages.groupBy(F.col("dim").alias("d"), F.col("cell").alias("c")).agg((F.max("tree") + 1).alias("trees")), "trees")
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").distinct()
    asked = cut(own.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "queries")

    def visits(first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for r in pdf.itertuples(index=False):
                    q = np.asarray(r.q, np.int64)
                    at, away = cells.asked(q)
                    have = np.array([c < 0 or c in radius for c in at.tolist()])
                    at, away = at[have], away[have]
                    if first:
                        at = at[[int(away.argmin())]] if len(at) else at
                    elif r.bounded and at[0] >= 0:
                        whole = float(q.astype(np.float64) @ q.astype(np.float64)) + cells.norm2[len(q)]
                        slack = 1e-6 * math.sqrt(whole) + 1e-6  # distances from pivots are differences of squares
                        at = at[away - np.array([radius[c] for c in at.tolist()]) <= reach(whole, float(r.floor), slack) + slack]
                    out += [(r.query_id, r.row, r.q, r.dim, c, r.bounded, r.floor) for c in at.tolist()]
                yield pd.DataFrame(out, columns=["query_id", "row", "q", "dim", "cell", "bounded", "floor"]).astype({"query_id": "int64", "row": "int64", "dim": "int32", "cell": "int32", "bounded": bool, "floor": "int64"})

        return run

    kind = "query_id long, row long, q array<long>, dim int, cell int, bounded boolean, floor long"
    at = (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))
    mine = F.pmod(F.xxhash64(F.lit(1), "row"), F.col("trees"))
    home = cut(asked.select("*", F.lit(False).alias("bounded"), F.lit(0).cast("long").alias("floor")).mapInPandas(visits(True), kind).join(trees, at).withColumn("tree", mine).drop("d", "c", "trees"), "home")
    near = cut(search_trees(pages, home, k, queries_per_task), "near")
    floor = near.where("score is not null").groupBy(F.col("row").alias("of")).agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    known = asked.join(floor, F.col("row") == F.col("of"), "left")
    again = known.select(*asked.columns, F.col("floor").isNotNull().alias("bounded"), F.coalesce("floor", F.lit(0).cast("long")).alias("floor")).mapInPandas(visits(False), kind)
    every_tree = again.join(trees, at).withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1))).drop("d", "c", "trees")
    rest = every_tree.join(home.select("row", "dim", "cell", "tree"), ["row", "dim", "cell", "tree"], "left_anti")
    return near.unionByName(search_trees(pages, cut(rest, "visits"), k, queries_per_task))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what is found; those of each tree are cut again before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "none", "vec_id"))
    best = found.where("score is not null").select("query_id", rank.alias("rank"), "vec_id", "none", "score").where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")
