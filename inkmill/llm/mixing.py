"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, enter, numbered

#: Documents of one source that one task balances together.
BLOCK = 4096
WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
#: Fractional units that a source's last block keeps for the landing, besides the two that its flight leaves.
LANDING = 14
#: A landing further than this share from a source's target is corrected.
NEAR = 0.005
#: Documents of a block, the longest, that are decided first.
LONG = 64


def flight(size: list[float], psi: list[float], seed: int, copies: list[float] | None = None) -> list[float]:
    """Moves fractional probabilities until at most two stay so; sums of copies * psi and of size * psi don't change.

    Three fractional units u, v, w have a direction in the null space of the rows (c_u, c_v, c_w), their copies, and
    (s_u, s_v, s_w), their sizes: the cross product of the two. A step along it, either way with the odds that keep each
    expectation, lasts until a unit reaches 0 or 1; that unit leaves and the next one comes in.
    """
    rng = random.Random(seed)
    psi = list(psi)
    copies = copies or [1.0] * len(psi)
    hand: list[int] = []
    for k in range(len(psi)):
        if not 0.0 < psi[k] < 1.0:
            continue
        hand.append(k)
        while len(hand) == 3:
            a, b, c = hand
            d = (copies[b] * size[c] - copies[c] * size[b], copies[c] * size[a] - copies[a] * size[c], copies[a] * size[b] - copies[b] * size[a])
            top = max(map(abs, d))
            # where the rows are parallel, what keeps one keeps the other
            d = tuple(x / top for x in d) if top else (copies[b], -copies[a], 0.0)
            up = min((1 - psi[k]) / x if x > 0 else -psi[k] / x for k, x in zip(hand, d, strict=True) if x)
            down = min(psi[k] / x if x > 0 else (psi[k] - 1) / x for k, x in zip(hand, d, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip(hand, d, strict=True):
                p = psi[k] + step * x
                psi[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            hand = [k for k in hand if 0.0 < psi[k] < 1.0]
    return psi


def settle(size: list[float], psi: list[float], seed: int, copies: list[float], units: list[int]) -> list[float]:
    """The flight for some units, in turn: each moves along its projection on the null space of all fractional units.

    There it moves fastest, and all others by a little each, so that a long document is decided against many short ones
    and doesn't stay fractional to the end. Sums of copies * psi and of size * psi don't change, nor do expectations.
    """
    rng = random.Random(seed)
    x, rows = np.array(psi), np.array([copies, size], float)
    for unit in units:
        while 0.0 < x[unit] < 1.0:
            free = np.flatnonzero((x > 0) & (x < 1))
            if len(free) <= 3:
                return x.tolist()
            a = rows[:, free] / np.maximum(np.abs(rows[:, free]).max(axis=1, keepdims=True), 1e-300)
            d = (free == unit) - a.T @ (np.linalg.pinv(a @ a.T) @ a[:, free == unit])[:, 0]
            if abs(d[free == unit][0]) < 1e-9:
                break
            moves = np.abs(d) > 1e-12
            way, now = d[moves], x[free][moves]
            up = np.where(way > 0, 1 - now, -now) / way
            down = np.where(way > 0, now, now - 1) / way
            up, down = float(up.min()), float(down.min())
            x[free] += (up if rng.random() * (up + down) < down else -down) * d
            x[x < 1e-9], x[x > 1 - 1e-9] = 0.0, 1.0
    return x.tolist()


def land(size: list[float], psi: list[float], copies: list[float] | None = None) -> list[float]:
    """The few fractional units rounded: of all roundings, the one whose size stays nearest to the sum, then whose count."""
    left = [k for k, p in enumerate(psi) if 0.0 < p < 1.0]
    out = list(psi)
    if not left:
        return out
    copies = copies or [1.0] * len(psi)
    words, n = sum(size[k] * psi[k] for k in left), sum(copies[k] * psi[k] for k in left)
    sums, counts = np.zeros(1), np.zeros(1)
    for k in left:  # of the roundings so far, without this unit and with it
        sums, counts = np.concatenate([sums, sums + size[k]]), np.concatenate([counts, counts + copies[k]])
    best = int(np.lexsort((np.arange(len(sums)), np.abs(counts - n), np.abs(sums - words).round(6)))[0])
    for i, k in enumerate(left):
        out[k] = float(best >> i & 1)
    return out


def correct(size: list[float], out: list[float], free: list[int], want: float, flips: int = 32) -> list[float]:
    """Where one document is much of its source, its rounding can be more than the others of the landing make up for: up
    to `flips` of the units in `free` change sides then, each time the one whose size is nearest to what is missing."""
    out = list(out)
    miss = want - sum(s * p for s, p in zip(size, out, strict=True))
    for _ in range(flips):
        side = 0.0 if miss > 0 else 1.0
        near = min((k for k in free if out[k] == side), key=lambda k: (abs(size[k] - abs(miss)), k), default=None)
        if near is None or abs(size[near] - abs(miss)) >= abs(miss):
            break
        out[near] = 1.0 - side
        miss += size[near] * (1 if side else -1)
    return out


def spread(size: list[float], free: list[int], n: int = LANDING) -> list[int]:
    """n of the units in `free`, evenly over their sizes: their sums come near any other. None of the longest tenth, which
    nothing would make up for."""
    free = sorted(free, key=lambda k: (-size[k], k))
    free = free[len(free) // 10 :] if len(free) > n else free
    return sorted({free[round(i * (len(free) - 1) / (n - 1))] for i in range(n)}) if len(free) > n else free


def reserve(block: int) -> int:
    """Fractional units that a block leaves undecided for the next round besides its last two."""
    return max(32, block // 32)


def balancer(seed: int, number: int, back: int):
    """The flight phase of one block as a function of its rows, and the landing where a source has no other block.

    A block with others beside it holds back `back` units, so that the last round has some of any size to land with; the
    last block keeps LANDING of them, of all sizes, out of its flight and rounds them together with what that leaves.
    """

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        enter(__name__)
        # large ones first: what is left to land is then small
        pdf = pdf.drop(columns=["block"]).assign(mass=pdf["size"] * pdf["copies"]).sort_values(["mass", "pos", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size, copies = pdf.pop("mass").astype(float).tolist(), pdf["copies"].astype(float).tolist()
        psi = pdf["psi"].tolist()
        free = [k for k, p in enumerate(psi) if 0.0 < p < 1.0]
        last = int(pdf["blocks"].iloc[0]) == 1
        held = set(spread(size, free)) if last else set(pdf["pos"].iloc[free[len(free) // 10 :]].sort_values(kind="stable").index[:back])
        if not last:  # one that the block's others can't make up for meets more of them in the next round
            total = sum(size[k] for k in free)
            held |= {k for k in free if 5 * size[k] > total}
        fly = [k for k in range(len(psi)) if k not in held]
        got = list(psi)
        start = seed * 1_000_003 + number * 7919 + int(pdf["pos"].iloc[0])
        sizes, counts = [size[k] for k in fly], [copies[k] for k in fly]
        long = [i for i in range(min(LONG, len(fly))) if 0.0 < psi[fly[i]] < 1.0]
        moved = flight(sizes, settle(sizes, [psi[k] for k in fly], start, counts, long), start + 1, counts)
        for k, p in zip(fly, moved, strict=True):
            got[k] = p
        if last:
            want = sum(s * p for s, p in zip(size, psi, strict=True))
            got = land(size, got, copies)
            if abs(sum(s * p for s, p in zip(size, got, strict=True)) - want) > NEAR * float(pdf["target"].iloc[0]):
                got = correct(size, got, free, want)
        pdf["psi"] = got
        return pdf

    return balance


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n_units, target for sizes (source, size, copies).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at cap
    times its source's size and the excess is shared again by weight until none is above. The shares are found by
    aggregates over the table of sources; one number a round reaches the driver. The running number of a source comes
    from one sorted pass over that table, a row for each source.
    """
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"), F.count("*").alias("n_units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    own = cut(own.select("source", "source_size", "n_units", weight.alias("weight")), "sources")
    top = F.col("source_size") * float(cap)
    total = own.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * level >= top
        fixed, open_ = own.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not open_:
            break
        now = (total - fixed) / open_
        if now <= level:
            break
        level = now
    return own.select("source", "source_size", "n_units", F.least(top, F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 4) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: how often the mix takes each row of docs, and its words.

    size: words of the text. Every document of a source is expected target / source_size times: the whole part is
    certain, the rest is an inclusion probability. Blocks of one source go through the flight phase in parallel and
    leave two fractional documents and a reserve; those meet in the next round's blocks, until one block a source is
    left, and there the last two land with a few others that were kept fractional. Words and documents of each source
    thus stay at their expected totals but for that landing, and for correct() where one document is much of its source. A hot source has more blocks, not larger ones.

    Null texts have size 0, and a source of size 0 has target 0; null sources are a source of their own, null ids are
    ids like any other. Rows that are equal in doc_id, source and size are one unit and are taken alike. The result
    depends on the rows and the seed alone, not on their order or partitions. Other columns are ignored.
    """
    narrow = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    units = narrow.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    goal = source_targets(units, weights, cap)
    of = goal.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(of, units["source"].eqNullSafe(of["of"])).select("doc_id", "source", "size", "copies", "source_size", "target", "n_units", rate.alias("rate"))
    order = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    # a rate within rounding of a whole number is that number
    whole = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.floor("rate")).cast("int")
    psi = F.when(F.col("rate") - F.col("whole") < 1e-9, F.lit(0.0)).otherwise(F.col("rate") - F.col("whole"))
    level = joined.withColumn("whole", whole).select("doc_id", "source", "size", "copies", "source_size", "target", "whole", psi.alias("psi"), order.alias("pos"), F.ceil(F.col("n_units") / block).cast("long").alias("blocks"))
    schema = level.schema
    done, number = None, 0
    while True:
        # a block of its own for each number; null sources group as well
        at = level.select("*", F.pmod(F.xxhash64(F.lit(seed + 1 + number), "pos"), F.col("blocks")).alias("block"))
        moved = cut(at.groupBy("source", "block").applyInPandas(balancer(seed, number, reserve(block)), schema), "mix")
        open_ = (F.col("psi") > 0) & (F.col("psi") < 1)
        settled = moved.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        if moved.where(open_).isEmpty():
            break
        # a block leaves two and its reserve at most
        level = moved.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * (2 + reserve(block)) / block).cast("long"))
        number += 1
    times = F.col("whole") + F.col("psi").cast("int")
    rows = done.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).cast("long").alias("taken"), F.col("copies"))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy", "copies")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as `mixed` takes it; the columns of docs, whatever their names."""
    plain = numbered(docs)
    key, text, source = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text", "source"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    take = mixed.select("doc_id", "source", "size", "times").distinct().where("times > 0")
    keyed = plain.withColumns({"key": key, "of": source, "words": size})
    met = keyed.join(take, F.col("key").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    return met.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy").toDF(*docs.columns)
