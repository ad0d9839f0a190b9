"""Quality by a sparse rule ensemble, compiled to column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, numbered

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, LEAST = 40, 3, 30
THRESHOLD = 0.7
STATISTICS = ["log_chars", "log_words", "word_length", "distinct_words", "repeats", "upper", "digits", "symbols", "pipes", "bangs", "stops", "line_words", "distinct_lines"]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column __stats of STATISTICS, all doubles, none null; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut_ = df.withColumn("__t", t).withColumn("__w", F.filter(F.split("__t", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).withColumn("__l", F.split("__t", "\n"))
    chars, words, lines = F.char_length("__t").cast("double"), F.size("__w").cast("double"), F.size("__l").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("__t", F.lit(pattern)) / F.greatest(chars, F.lit(1.0))

    least = F.greatest(words, F.lit(1.0))
    repeats = F.size(F.filter("__w", lambda x, i: x.eqNullSafe(F.get("__w", i - 1)))).cast("double")
    of = {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(words),
        "word_length": chars / least,
        "distinct_words": F.size(F.array_distinct("__w")) / least,
        "repeats": repeats / least,
        "upper": share("\\p{Lu}"),
        "digits": share("[0-9]"),
        "symbols": share("[#$%&*@^~=+<>_{}\\[\\]\\\\/]"),
        "pipes": share("\\|"),
        "bangs": share("[!?]"),
        "stops": share("[.,;:]"),
        "line_words": words / lines,
        "distinct_lines": F.size(F.array_distinct("__l")) / lines,
    }
    return cut_.withColumn("__stats", F.struct(*[of[k].cast("double").alias(k) for k in STATISTICS])).drop("__t", "__w", "__l")


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (statistic, True for above / False for at most, threshold) must hold."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.parts:
            out &= (x[:, k] > at) == above
        return out

    def column(self) -> Column:
        s = [F.col("__stats")[STATISTICS[k]] for k, _, _ in self.parts]
        return reduce(lambda a, b: a & b, [c > at if above else c <= at for c, (_, above, at) in zip(s, self.parts, strict=True)])

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {at:.6g}" for k, above, at in self.parts)


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for w, r in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        z = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(float(w))).otherwise(0.0) for w, r in self.rules], F.lit(float(self.bias)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = 48, rate: float = 0.3, seed: int = 10) -> list[Rule]:
    """The paths to all nodes of boosted trees, each grown on half of the rows; thresholds between quantiles."""
    rng = np.random.default_rng(seed)
    edges = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)))
        edges.append((q[1:] + q[:-1]) / 2)
    code = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    z = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        half = rng.random(len(y)) < 0.5
        todo = [(np.ones(len(y), bool), ())]
        while todo:
            inside, parts = todo.pop()
            own = inside & half
            best = (1e-3, None)
            if len(parts) < depth and own.sum() >= 2 * LEAST:
                G, H = g[own].sum(), h[own].sum()
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[own, k]
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[own], h[own], np.ones(len(c))))
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    gain[(nl < LEAST) | (own.sum() - nl < LEAST)] = -1
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (float(gain[at]), (k, float(e[at])))
            if best[1] is None:
                if parts:
                    z[inside] += rate * g[own].sum() / (h[own].sum() + 1)
                continue
            k, at = best[1]
            for above in (False, True):
                path = parts + ((k, above, at),)
                rules.setdefault(Rule(tuple(sorted(path))))
                todo.append((inside & ((x[:, k] > at) == above), path))
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400, beta: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights under an L1 penalty (none on the last column) by accelerated proximal steps."""
    n = len(y)
    beta = np.zeros(r.shape[1]) if beta is None else beta.copy()
    v = np.ones(r.shape[1])
    for _ in range(30):  # the step: the greatest eigenvalue of the curvature's bound
        v = r.T @ (r @ v)
        size = np.linalg.norm(v)
        v /= size or 1.0
    step = 4.0 * n / max(size * 1.05, 1e-12)
    last, t = beta, 1.0
    for _ in range(steps):
        u = 1 + math.sqrt(1 + 4 * t * t)
        at = beta + (t - 1) / (u / 2) * (beta - last)
        grad = r.T @ (1 / (1 + np.exp(-np.clip(r @ at, -30, 30))) - y) / n
        now = at - step * grad
        now[:-1] = np.sign(now[:-1]) * np.maximum(np.abs(now[:-1]) - step * penalty, 0)
        last, beta, t = beta, now, u / 2
    return beta


def fit_ensemble(x: np.ndarray, y: np.ndarray, penalties: tuple = (0.01, 0.003, 0.001, 0.0003)) -> Ensemble:
    """Rules of boosted trees with lasso weights; of the penalties, the one that a fifth of the rows likes best."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return Ensemble(math.log(share / (1 - share)), ())
    rules = grow_rules(x, y)
    on = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    mean = on.mean(axis=0)
    keep = np.flatnonzero((mean > 0.002) & (mean < 0.998))
    # equal columns are one rule, the shortest
    _, first = np.unique(np.packbits(on[:, keep], axis=0), axis=1, return_index=True)
    keep = keep[np.sort(first)]
    rules = [rules[k] for k in keep]
    mean = mean[keep]
    scale = np.sqrt(mean * (1 - mean))
    r = np.concatenate([(on[:, keep] - mean) / np.maximum(scale, 1e-9), np.ones((len(y), 1))], axis=1)
    check = np.arange(len(y)) % 5 == 0
    best = (math.inf, penalties[-1])
    beta = None
    for penalty in penalties:
        beta = lasso(r[~check], y[~check], penalty, beta=beta)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[check] @ beta, -30, 30))), 1e-6, 1 - 1e-6)
        loss = float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()) if check.any() else 0.0
        if loss < best[0] - 1e-5:
            best = (loss, penalty)
    beta = lasso(r, y, best[1])
    w = beta[:-1] / np.maximum(scale, 1e-9)
    return Ensemble(float(beta[-1] - (w * mean).sum()), tuple((float(a), rule) for a, rule in zip(w, rules, strict=True) if abs(a) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Learns from labels (doc_id, quality) whose id isn't held out, joined to docs (doc_id, text).

    At most `sample` labelled rows, those with the smallest hash of their id, are used; only their statistics reach the
    driver. Null labels and ids are left out; an id labelled twice counts as good if one of the labels says so. Without
    labelled rows the score is one half everywhere.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    have = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = cut(have.orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(sample), "labelled")
    # at most `sample` rows of two numbers: a bounded side
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))).select("doc_id", "y", "__stats.*").toPandas()
    rows = rows.sort_values("doc_id")
    return fit_ensemble(rows[STATISTICS].to_numpy(np.float64), (rows["y"] == 1).to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs (doc_id, text), by column expressions alone.

    Empty and null texts have statistics of their own (all zero) and get the ensemble's score for them. Null ids and
    repeated rows pass through; other columns are ignored; empty tables give empty results.
    """
    model = fit(docs, labels, sample)
    got = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))
    return got.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is at least threshold, with all their columns, whatever their names.

    The score passes through a generator of one row. A filter isn't pushed below that, where every rule would carry its
    own copy of the statistics.
    """
    model = fit(docs, labels, sample)
    plain = numbered(docs)
    scored = with_statistics(plain, f"c{docs.columns.index('text')}").withColumn("__score", model.column()).drop("__stats")
    return scored.select("*", F.explode(F.array("__score")).alias("__passed")).where(F.col("__passed") >= threshold).select(*plain.columns).toDF(*docs.columns)
