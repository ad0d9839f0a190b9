import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from inkmill.llm import collision, common, mtree, simhash  # noqa: E402

from .helpers import Groups, ascii_lower, docs, empty, least_ids  # noqa: E402


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def spread(rng, n, flips):
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    f = base[rng.integers(0, 30, n)].copy()
    for k in range(n):
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            f[k] ^= np.uint64(1) << np.uint64(b)
    return f


def brute_groups(f, radius, group=None):
    g = Groups(len(f))
    for i in range(len(f)):
        for j in range(i):
            if (group is None or group[i] == group[j]) and (int(f[i]) ^ int(f[j])).bit_count() <= radius:
                g.link(i, j)
    return [g.find(i) for i in range(len(f))]


def linked(n, pairs):
    g = Groups(n)
    for i, j in pairs:
        g.link(i, j)
    return [g.find(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    f = spread(rng, 250, 6)
    assert linked(250, simhash.links_large(f, radius)) == brute_groups(f, radius)
    group = np.sort(rng.integers(0, 25, 250))
    assert linked(250, simhash.links_small(f, group, radius)) == brute_groups(f, radius, group)


@pytest.mark.parametrize("tile", [8192, 7])
def test_fingerprint_links(spark, tile):
    rng = np.random.default_rng(9)
    f = np.unique(np.concatenate([spread(rng, 300, 5), np.array([0, 1, 2**64 - 1], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp LONG").repartition(3)
    at = {int(x): k for k, x in enumerate(f.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in simhash.fingerprint_links(df, 3, tile).collect()]
    assert linked(len(f), pairs) == brute_groups(f, 3)


def test_near_duplicates(spark):
    df = docs(spark)
    src = df.collect()
    fps = [brute_fingerprint(r.text) for r in src]
    g = Groups(len(src))
    for i in range(len(src)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                g.link(i, j)
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(src, fps, least_ids([r.doc_id for r in src], g), strict=True)), key=str)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    heads = {c for _, _, c in want}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(heads, key=str)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(1000, k) for k in range(1001, 1100)]
    df = spark.createDataFrame(pairs, "a LONG, b LONG")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500} | {k: 1000 for k in range(1000, 1100)}
    assert common.connected_components(df.limit(0)).count() == 0


def vectors(spark, seed=0, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    base = rng.standard_normal((20, 64))
    for k in range(n):
        v = base[k % 20] + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.25, 0.35, 2.0])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3), "clash"))
    rows += [(n, None, 1, None), (n + 1, [], 1, None), (n + 2, [0.0] * 64, 1, None), (n + 3, [float("nan")] * 64, 1, None), (n + 4, [None] * 64, 1, None), (n + 5, rows[0][1], None, None), (n + 6, rows[0][1][:10], 0, None), (None, rows[0][1], 0, None), (3, rows[3][1], rows[3][2], "clash"), (n + 7, [float("inf")] + [0.0] * 63, 1, None), (n + 8, [1e-30] * 64, 2, None), (n + 9, [1e30] * 64, 2, None)]
    return spark.createDataFrame(rows, T._parse_datatype_string("vec_id LONG, embedding ARRAY<FLOAT>, label INT, kept STRING")).repartition(3), rows


def brute_links(rows, least=0.93):
    import math

    unit = []
    for _, v, label, _ in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            a = np.array(v, float)
            a = a / np.abs(a).max()
            unit.append(a / math.sqrt((a * a).sum()))
        else:
            unit.append(None)
    g, n = Groups(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= least:
                g.link(i, j)
                n[i] += 1
                n[j] += 1
    return n, g


@pytest.mark.parametrize("tile", [4096, 16])
def test_collision_counting(spark, tile):
    df, rows = vectors(spark)
    got = sorted((tuple(r) for r in collision.near_duplicates(df, tile=tile).collect()), key=str)
    n, g = brute_links(rows)
    comp = least_ids([r[0] for r in rows], g)
    want = [(r[0], k, c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, n, comp, strict=True)]
    found, every = sum(x[1] for x in got), sum(n)
    assert every > 300 and found / every > 0.99
    assert sorted(want, key=str) == got
    assert collision.near_duplicates(df.limit(0)).count() == 0


def test_the_count_asked_for_is_met_by_pairs_at_the_threshold():
    half, need = collision.calibrate(0.93)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.standard_normal((4000, 64))
    o -= (o * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * o / np.linalg.norm(o, axis=1, keepdims=True)
    lines = rng.standard_normal((64, collision.PROJECTIONS))
    hits = (np.abs(x @ lines - y @ lines) <= half).sum(axis=1)
    assert (hits >= need).mean() > 0.995 and need > collision.PROJECTIONS // 4


@pytest.mark.parametrize("per_tree,per_task,per_cell", [(8192, 2048, 1024), (50, 2, 40), (20, 3, 100)])
def test_top_k(spark, per_tree, per_task, per_cell):
    import math

    df, rows = vectors(spark, 5, 420)
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for qi, q in {(i, tuple(v)) for i, v in ok if i is not None and i % 60 == 0}:
        if max(map(abs, q)) > 1e12:
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, [max(-(2**63), min(2**63 - 1, x)) for x in v], strict=True)))), math.inf if i is None else i) for i, v in ok if len(v) == len(q) and i != qi)
        want += [(qi, k, None if i == math.inf else i, -s) for k, (s, i) in enumerate(scores[:10], 1)]
    got = sorted((tuple(r) for r in mtree.top_k(df, 10, 60, rows_per_tree=per_tree, queries_per_task=per_task, per_cell=per_cell).collect()), key=str)
    assert got == sorted(want, key=str) and len(want) >= 70
    assert mtree.top_k(df.limit(0)).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 6, (400, 8)) + 1000 * np.array([k == j for j in range(8)]) for k in range(8)]).astype(np.int64)
    import pandas as pd

    pages = mtree.build_pages(np.arange(len(x)), x)
    table = pd.DataFrame([{"page": p["page"], "leaf": p["leaf"], "norm2": p["norm2"]} | {c: p[c].astype(t).tobytes() for c, t in (("ids", "<i8"), ("nones", bool), ("vectors", "<i8"), ("radii", "<f8"), ("to_parent", "<f8"), ("children", "<i8"))} for p in pages])
    tree = mtree.Tree(table, 8)
    for q in (5, 900, 3100):
        best = sorted((-int(x[q] @ x[k]), k) for k in range(len(x)) if k != q)[:10]
        assert tree.search(x[q], q, 10) == [(-s, k) for s, k in best]
    assert tree.computed < 3 * len(x) / 2


def test_few_distances_on_clusters_and_ids_at_the_ends(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 32)) * 20
    rows = [(k, [float(a) for a in centers[k % 40] + rng.standard_normal(32)]) for k in range(4000)]
    rows += [(2**63 - 1, rows[0][1]), (-(2**63), rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    found = mtree.search(df, 10, 100, 1024.0, 8192, 2048, 100).cache()
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    want = []
    for q in [k for k in range(len(rows)) if rows[k][0] is not None and rows[k][0] % 100 == 0]:
        s = x @ x[q]
        best = sorted((k for k in order if k != q), key=lambda k: -s[k])[:10]
        want += [(rows[q][0], n, rows[k][0], int(s[k])) for n, k in enumerate(best, 1)]
    assert sorted(map(tuple, mtree.ranked(found, 10).collect()), key=str) == sorted(want, key=str)
    queries = len({w[0] for w in want})
    # of a scan's distances, a small part
    assert found.agg({"computed": "sum"}).first()[0] < 0.2 * queries * len(rows)


def test_tiles_far_apart_are_left_out_and_no_link_is_lost(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((12, 48)) * 4
    rows = [(k, [float(a) for a in centers[k % 12] + rng.standard_normal(48) * 0.7], k % 2, "x") for k in range(900)]
    df = spark.createDataFrame(rows, T._parse_datatype_string("vec_id LONG, embedding ARRAY<DOUBLE>, label INT, kept STRING"))
    nodes = df.select("label", F.col("embedding").alias("v"), F.lit(1).cast("long").alias("copies"), F.size("embedding").alias("dim"), F.col("vec_id").alias("node"))
    placed, tiles = collision.place(nodes, 60, 6)
    assert placed.count() == 900 and placed.groupBy("label", "tile").count().agg({"count": "max"}).first()[0] <= 120
    n = {r.label: r["count"] for r in tiles.groupBy("label").count().collect()}
    every = sum(k * (k + 1) // 2 for k in n.values())
    assert collision.tile_pairs(tiles, 0.93).count() < every / 2
    links, g = brute_links(rows)
    got = sorted(map(tuple, collision.near_duplicates(df, tile=60).collect()))
    comp = least_ids([r[0] for r in rows], g)
    assert sum(links) > 1000
    assert got == sorted((r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, comp, strict=True))
