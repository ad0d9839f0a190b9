"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, cut, fresh_dir, held, held_out, local_path, map_rows, mapped_arrays, numbered, pieces, small_batches, text_bytes, tidy, write_arrays
from .license_scan import TO_WORDS, to_words
from .units import ranges, slices

#: Bounds of what is learned from: labelled examples of either class, and the distinct terms of all of them, summed up.
EXAMPLES, POSTINGS = 20_000, 32_000_000
#: Examples of one index block, terms kept as whole rows too, neighbours that vote, texts whose score a task remembers.
BLOCK, DENSE, NEIGHBOURS, SEEN = 64, 512, 15, 2_000
#: A term is frequent if more than one of OFTEN examples has it.
OFTEN = 16
#: Weight of a term that tells nothing about the classes, beside one that tells all (1).
FLOOR = 1e-6
#: Relative error of single-precision sums of some hundred positive terms, with room to spare.
SLACK = 5e-5
#: Length that the terms of a query that aren't read at first may have.
NEAR = 0.01
#: Lengths of what an example's terms have beyond its shorter and its longer head.
TAILS = (0.01, 0.001)
#: Bytes of text coded at once, queries whose frequent terms are weighed at once.
SLICE, QUERIES = 6_000_000, 192


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of the text, word) of all words of texts, in order."""
    flat = b" ".join([x.translate(TO_WORDS) for x in texts])
    a = np.frombuffer(flat, np.uint8)
    inside = a != 32
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    at = np.flatnonzero(new)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
    return np.searchsorted(np.cumsum(size) - size, at, "right") - 1, words.dictionary_encode()


def term_numbers(texts: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, terms, counts): the terms of text k, ascending by number, and how often each occurs, at first[k] .. first[k + 1] - 1.

    Words that the vocabulary (binary, each once) doesn't have are left out.
    """
    of, words = words_of(texts)
    number = pc.fill_null(pc.index_in(words.dictionary, value_set=vocabulary), -1).to_numpy()[words.indices.to_numpy()]
    known, n = number >= 0, max(len(vocabulary), 1)
    pair, counts = np.unique(of[known] * n + number[known], return_counts=True)
    of, terms = np.divmod(pair, n)
    return np.searchsorted(of, np.arange(len(texts) + 1)), terms, counts


def tfidf(first: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The terms' weights: (1 + log count) times idf, each text's at length 1."""
    w = (1 + np.log(counts)) * idf[terms]
    size = np.diff(first)
    w /= np.repeat(np.sqrt(np.bincount(np.repeat(np.arange(len(size), dtype=np.int32), size), w * w, len(size))), size)
    return w


def stretches(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """x[start[k] : end[k]] of all k, one after another."""
    if not len(start):
        return x[:0]
    raw = x.view(f"V{x.itemsize}")  # numpy joins records as bytes without looking at their fields
    return np.concatenate([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]).view(x.dtype)


def parts(first: np.ndarray, size: int = 300_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows that hold about `size` entries each, one row at least; row k begins at first[k]."""
    a = 0
    while a + 1 < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + size, "right")) - 1)
        yield a, b
        a = b


class BlockMaxIndex:
    """Postings by term, cut into runs of BLOCK examples that each know the term's greatest weight in them.

    given() gives the examples' terms and their counts, those of example k at first[k] .. first[k + 1] - 1; it is asked
    once, and they are let go as soon as they are copied. A term of no more
    than 4 * BLOCK postings has no runs, as most of them would be one. Frequent terms are also kept as whole rows, one weight
    an example. Postings and rows are in single precision: they find the examples that may be among the nearest, whose
    cosines are then taken from their own terms. These are kept by falling weight; an example's heads are what carries
    all of its length but TAILS.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, first: np.ndarray, given: Callable[[], tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        terms, counts = given()
        self.ids, self.labels, self.first, self.idf = ids, labels, first, idf
        self.n = n = len(ids)
        n_terms = len(idf)
        self.blocks = -(-n // BLOCK)
        self.post = np.append(0, np.cumsum(np.bincount(terms, minlength=n_terms)))  # first posting of each term, and the end
        most = int(counts.max(initial=1))
        self.factor = np.append(0.0, 1 + np.log(np.arange(1, most + 1)))  # by count
        self.own = np.empty(len(terms), [("of", "<i4"), ("count", np.min_scalar_type(most))])
        self.scale = np.zeros(n)  # by example: what brings it to length 1
        self.heads = [np.zeros(n, np.int64) for _ in TAILS]
        # some examples, then some terms at a time: what sorting needs beside the result stays small
        for a, b in parts(first):
            size = np.diff(first[a : b + 1])
            of, own = np.repeat(np.arange(b - a), size), self.own[first[a] : first[b]]
            own["of"], own["count"] = terms[first[a] : first[b]], counts[first[a] : first[b]]
            w = self.factor[own["count"]] * idf[own["of"]]
            self.scale[a:b] = 1 / np.sqrt(np.maximum(np.bincount(of, w * w, b - a), 1e-300))
            w *= self.scale[a:b][of]
            order = np.lexsort((-w, of))
            own[:] = own[order]
            square = np.append(0, np.cumsum(w[order] ** 2))
            left = square[np.cumsum(size)][of] - square[:-1]  # of the squared length, from each term on
            for head, tail in zip(self.heads, TAILS, strict=True):
                head[a:b] = np.bincount(of[left > tail**2 - 1e-9], minlength=b - a)
        del terms, counts
        self.postings = np.empty(len(self.own), [("of", "<u2" if n < 1 << 16 else "<u4"), ("w", "<f4")])
        self.most = np.zeros(n_terms, np.float32)  # greatest weight of each term
        runs, block, top = [np.zeros(1, np.int64)], [], []
        for a, b in parts(self.post):
            at = np.flatnonzero((self.own["of"] >= a) & (self.own["of"] < b))
            at = at[np.argsort(self.own["of"][at], kind="stable")]
            own, to, example = self.own[at], self.postings[self.post[a] : self.post[b]], np.searchsorted(first, at, "right") - 1
            term = own["of"]
            to["of"], to["w"] = example, self.factor[own["count"]] * idf[term] * self.scale[example]
            np.maximum.at(self.most, term, to["w"])
            at = np.flatnonzero(np.diff(self.post)[term] > 4 * BLOCK)
            term, to, example = term[at], to[at], example[at] // BLOCK
            new = np.ones(len(at), bool)
            new[1:] = (term[1:] != term[:-1]) | (example[1:] != example[:-1])
            start = np.flatnonzero(new)
            block.append(example[start].astype(np.int32))
            top.append(np.maximum.reduceat(to["w"], start) if len(start) else np.zeros(0, np.float32))
            runs.append(np.bincount(term[start] - a, minlength=b - a))
        self.block, self.top = (np.concatenate([np.zeros(0, np.float32), *x]) for x in (block, top))  # by run
        self.block = self.block.astype(np.int32)
        self.run = np.cumsum(np.concatenate(runs)).astype(np.int32)  # first run of each term, and the end
        often = np.argsort(-np.diff(self.post), kind="stable")[:DENSE]
        often = often[np.diff(self.post)[often] * OFTEN > n]
        self.row = np.full(n_terms, -1, np.int16)  # by term, its row of dense; -1 for a rarer term
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        for r, k in enumerate(often.tolist()):
            some = self.postings[self.post[k] : self.post[k + 1]]
            self.dense[r, some["of"]] = some["w"]
        self.query = np.zeros(n_terms)  # by term, weight in the query times idf; all 0 between searches

    #: What the index consists of; heads goes apart, and what else there is follows from these.
    ARRAYS = ("ids", "labels", "first", "idf", "post", "factor", "own", "scale", "postings", "most", "block", "top", "run", "row", "dense")

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.ARRAYS} | {f"heads{k}": x for k, x in enumerate(self.heads)}

    @classmethod
    def of_arrays(cls, x: dict[str, np.ndarray]) -> BlockMaxIndex:
        """The index that gave arrays(); they are only read, so they may be mapped."""
        self = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(self, name, x[name])
        self.heads = [x[f"heads{k}"] for k in range(len(TAILS))]
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        self.query = np.zeros(len(self.idf))
        return self

    def nearest_of(self, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest() of many queries, given as the examples are; what frequent terms add is one matrix product for some.

        Queries go together by the most frequent term they have, which mostly tells their language, so that they share
        the rows that a product needs.
        """
        size = np.diff(first)
        row = self.row[terms]
        lead = np.full(len(size), len(self.dense))
        np.minimum.at(lead, np.repeat(np.arange(len(size)), size)[row >= 0], row[row >= 0])
        order = np.argsort(lead, kind="stable")
        out: list = [[]] * len(size)
        for q in range(0, len(order), QUERIES):
            some = order[q : q + QUERIES]
            at = ranges(first[some], size[some])
            of, row_, w = np.repeat(np.arange(len(some)), size[some]), row[at], weights[at]
            of, row_, w = of[row_ >= 0], row_[row_ >= 0], w[row_ >= 0]
            used, column = np.unique(row_, return_inverse=True)
            if 2 * len(used) > len(self.dense):  # rather all rows than a copy of most
                used, column, dense = np.arange(len(self.dense)), row_, self.dense
            else:
                dense = self.dense[used]
            frequent = np.zeros((len(some), len(used)), np.float32)
            frequent[of, column] = w
            common = frequent @ dense
            del dense
            for j, part in zip(some.tolist(), common, strict=True):
                own = slice(first[j], first[j + 1])
                out[j] = self._nearest(terms[own], weights[own], k, -1 if without is None else without[j], part)
        return out

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k greatest (cosine, example) above 0, ties to the smaller example; exact. w is at length 1.

        Frequent terms come first, then the rest by falling weight, so each example has a part of its cosine. The k-th
        greatest of the best parts of as many groups of examples is a floor for the k-th cosine. What the terms left can
        add is bounded by their greatest weights over all or in an example's block, and by Cauchy and Schwarz. Examples
        that can't reach the floor are out; once they are few, the others' cosines are taken from their own terms, from
        their heads first and whole where the head leaves them in question.
        """
        return self.nearest_of(np.array([0, len(t)]), t, w, k, [without])[0]

    def facts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ids, self.labels

    def _cosines(self, some: np.ndarray, start: np.ndarray | int, end: np.ndarray) -> np.ndarray:
        """What the terms start[i] .. end[i] - 1 of example some[i] add to its cosine with the query that is set."""
        at, size = self.first[some], end - start
        own = stretches(self.own, at + start, at + end)
        products = np.take(self.query, own["of"], mode="clip") * np.take(self.factor, own["count"], mode="clip")
        if len(size) and size.min() > 0:
            return np.add.reduceat(products, np.cumsum(size) - size) * self.scale[some]
        return np.bincount(np.repeat(np.arange(len(some)), size), products, len(some)) * self.scale[some]

    def _left(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By block, what these terms can add to an example's cosine at most."""
        runs = self.run[t + 1] - self.run[t]
        at = ranges(self.run[t], runs)
        out = np.bincount(self.block[at], np.repeat(w, runs) * self.top[at], self.blocks)
        few = np.flatnonzero(runs == 0)
        postings = stretches(self.postings, self.post[t[few]], self.post[t[few] + 1])
        size = self.post[t[few] + 1] - self.post[t[few]]
        return out + np.bincount(postings["of"] // BLOCK, np.repeat(w[few], size) * postings["w"], self.blocks)

    def _nearest(self, t: np.ndarray, w: np.ndarray, k: int, without: int, part: np.ndarray) -> list[tuple[float, int]]:
        if not len(t) or not self.n:
            return []
        rare = np.flatnonzero(self.row[t] < 0)
        rare = rare[np.argsort(-w[rare], kind="stable")]
        rt, rw = t[rare], w[rare]
        rest = np.append(np.cumsum((rw * self.most[rt])[::-1])[::-1], 0.0)
        length = np.sqrt(np.append(np.cumsum((rw * rw)[::-1])[::-1], 0.0))  # of the query's terms from here on
        size = self.post[rt + 1] - self.post[rt]
        read = np.append(0, np.cumsum(size))
        # terms that leave a tenth of the query's length at most; then, should the examples in question be too many, more
        a, b = 0, int(np.argmax(length <= NEAR))
        while True:
            if b > a:
                postings = stretches(self.postings, self.post[rt[a:b]], self.post[rt[a:b] + 1])
                part[: self.n] += np.bincount(postings["of"], np.repeat(rw[a:b], size[a:b]) * postings["w"], self.n)
                a = b
            if without >= 0:
                part[without] = 0.0
            # groups: every blocks-th example together, which numpy folds fastest
            best = part.reshape(BLOCK, -1).max(axis=0) if self.blocks > k else part
            least = float(np.partition(best, len(best) - k)[len(best) - k]) * (1 - SLACK) if len(best) > k else 0.0
            left = int(read[-1] - read[a])
            low = least - min(rest[a], length[a]) * (1 + SLACK)
            if low > 0 or not left:
                some = np.flatnonzero(part >= max(low, 1e-30))
                have = part[some]
                more = np.minimum(rest[a], length[a] * np.sqrt(np.maximum(1 - have**2 / max(1 - length[a] ** 2, 1e-12), 0))) * (1 + SLACK) + 1e-9
                ok = have * (1 + SLACK) + more >= least
                some, more = some[ok], more[ok]
                if left and int(self.heads[0][some].sum()) > left:
                    inside = self._left(rt[a:], rw[a:]) * (1 + SLACK)
                    some = some[part[some] * (1 + SLACK) + np.minimum(inside[some // BLOCK], more) >= least]
                if not left or int(self.heads[0][some].sum()) <= left + 5_000:
                    break
            b = min(len(rt), max(a + 1, int(np.searchsorted(read, 2 * read[a] + 4000))))
        self.query[t] = w * self.idf[t]
        score, start = np.zeros(len(some)), np.zeros(len(some), np.int64)
        for tail, head in zip(TAILS, self.heads, strict=True):
            if len(some) > k:
                score, start = score + self._cosines(some, start, head[some]), head[some]
                ok = score + tail + 1e-9 >= np.partition(score, len(some) - k)[len(some) - k]
                some, score, start = some[ok], score[ok], start[ok]
        score += self._cosines(some, start, self.first[some + 1] - self.first[some])
        self.query[t] = 0.0
        best = sorted([(-round(s, 12), i) for s, i in zip(score.tolist(), some.tolist(), strict=True) if i != without and s > 0])[:k]
        return [(-s, i) for s, i in best]


def vote(near: list[tuple[float, int]], labels: np.ndarray, prior: float) -> float:
    """Distance-weighted share of label 1 among the neighbours, with one prior vote."""
    w = [1.0 / (1.1 - s) for s, _ in near]
    return (sum(x * labels[i] for x, (_, i) in zip(w, near, strict=True)) + 0.1 * prior) / (sum(w) + 0.1)


def features(near: list[tuple[float, int]], labels: np.ndarray, prior: float) -> list[float]:
    v = min(max(vote(near, labels, prior), 1e-4), 1 - 1e-4)
    return [1.0, math.log(v / (1 - v)), near[0][0] if near else 0.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * np.r_[0.0, beta[1:]]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(len(beta) - 1, ridge)])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(beta)), g)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    shared: Broadcast | str | None  # what index_of() takes the index from; None without examples of both classes
    name: str
    beta: np.ndarray
    prior: float  # share of label 1 among the labelled rows
    bare: float  # score of a text without any term


def built(shared: Broadcast) -> tuple[pa.Array, BlockMaxIndex]:
    """(vocabulary, index) from what fit() broadcasts."""
    x = shared.value
    if hasattr(shared, "_path"):  # the worker may read it again from there: no need to keep it beside the index
        vars(shared).pop("_value", None)
    take = x.pop if hasattr(shared, "_path") else x.get
    index = BlockMaxIndex(x["ids"], x["labels"], x["first"], lambda: (take("terms"), take("counts")), x["idf"])
    pa.default_memory_pool().release_unused()
    return x["vocabulary"], index


def write_index(spark: SparkSession, vectors: str, vocabulary: pa.Array, idf: np.ndarray, at: str) -> None:
    """Builds the index in one task from what vectors() gave (Parquet) and writes it; both folders are local_path()s of the shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted_vectors(pq.read_table(vectors))
        held_ = [rows.pop("terms"), rows.pop("counts")]
        index = BlockMaxIndex(rows["ids"], rows["labels"], rows["first"], lambda: (held_.pop(0), held_.pop(0)), idf)
        size = pc.binary_length(vocabulary).to_numpy()
        words = {"offsets": np.append(0, np.cumsum(size)).astype(np.int32), "words": np.frombuffer(b"".join(vocabulary.to_pylist()), np.uint8)}
        write_arrays(at, index.arrays() | words)
        del index
        yield from batches

    spark.range(0, 1, 1, 1).mapInArrow(alone(run), "id long").collect()


def mapped_index(at: str) -> tuple[pa.Array, BlockMaxIndex]:
    """(vocabulary, index) as write_index() left them, mapped."""
    x = mapped_arrays(at)
    vocabulary = pa.Array.from_buffers(pa.binary(), len(x["offsets"]) - 1, [None, pa.py_buffer(x["offsets"]), pa.py_buffer(x["words"])])
    return vocabulary, BlockMaxIndex.of_arrays(x)


def index_of(shared: Broadcast | str, name: str) -> tuple[pa.Array, BlockMaxIndex]:
    """(vocabulary, index): mapped from a folder, or built from a broadcast once in each Python worker."""
    return held(("toxicity", name), lambda: mapped_index(shared) if isinstance(shared, str) else built(shared))


def sorted_vectors(rows: pa.Table) -> dict[str, np.ndarray]:
    """What an index is built from, of the examples that have terms, by rising id: ids, labels, first, terms, counts."""
    rows = rows.sort_by("doc_id")
    length = pc.list_value_length(rows.column("terms")).to_numpy()
    some = length > 0
    out = {"ids": rows.column("doc_id").to_numpy()[some], "labels": (rows.column("y").to_numpy() == 1).astype(float)[some], "first": np.append(0, np.cumsum(length[some]))}
    out["terms"], counts = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "counts"))
    return out | {"counts": counts.astype(np.min_scalar_type(int(counts.max(initial=1))))}


def class_counts(docs: DataFrame) -> DataFrame:
    """term, n_1, n_0: in how many of docs (text, y) with y = 1 and y <> 1 a term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = text_bytes(b), b.column(1).to_numpy(zero_copy_only=False) == 1
            for rows in slices(texts, SLICE):
                of, words = words_of([texts[k] for k in rows])
                n = len(words.dictionary)
                of, term = np.divmod(np.unique(of * max(n, 1) + words.indices.to_numpy()), max(n, 1))
                one = y[np.array(rows)][of]
                yield pa.RecordBatch.from_arrays([words.dictionary, *(pa.array(np.bincount(term[c], minlength=n), pa.int64()) for c in (one, ~one))], names=["term", "n_1", "n_0"])

    return map_rows(docs, ["text", "y"], run, "term binary, n_1 long, n_0 long").groupBy("term").agg(F.sum("n_1").alias("n_1"), F.sum("n_0").alias("n_0"))


def document_counts(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """term (its number), n: in how many of docs (text) a term of the vocabulary stands; a task sends each term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for part in pieces(b, 2 * SLICE):
                total += np.bincount(term_numbers(text_bytes(part), vocabulary)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    return map_rows(docs, ["text"], run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def least_shingle(text: bytes, words: int = 3) -> int:
    """The smallest hash of the text's word shingles; near copies mostly share it."""
    import xxhash

    w = to_words(text)
    return min(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))), default=xxhash.xxh64_intdigest(b" ".join(w)))


def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b)
        keys = np.array([least_shingle(x) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64()), pa.array([len(set(to_words(x))) for x in texts], pa.int64())], names=["doc_id", "text", "y", "key", "n_terms"])


def telling(a: np.ndarray, b: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """What a term in `a` of n_1 and `b` of n_0 examples tells about the class: phi squared without its bias, 0 to 1 at any number of them.

    It is taken without one of the examples that speak for the term, as such an example's own search would see it.
    """
    n = float(n_1 + n_0)
    toxic = a * n_0 > b * n_1
    a, b = np.where(toxic, a - 1, a), np.where(toxic, b, np.maximum(b - 1, 0))
    phi2 = (a * (n_0 - b) - b * (n_1 - a)) ** 2 / np.maximum(float(n_1) * n_0 * (a + b) * (n - a - b), 1e-9)
    return np.maximum(phi2 - 1 / (n - 1), 0.0)


def chosen_examples(docs: DataFrame, labels: DataFrame, examples: int, postings: int) -> tuple[DataFrame, dict[bool, int]]:
    """(the examples: doc_id, text, y; how many labelled rows each class has), see fit()."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    have = cut(y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.when(F.col("y") == 1, 1).otherwise(0).alias("y")), "labelled")
    order = F.xxhash64(F.lit(8), "doc_id")
    some = have.where("y = 1").orderBy(order, "doc_id").limit(examples).unionByName(have.where("y = 0").orderBy(order, "doc_id").limit(examples))
    size = {r["y"] == 1: r["n"] for r in have.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # at most 2 * examples rows of two numbers: a bounded side
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    keyed = cut(map_rows(texts, ["doc_id", "text", "y"], with_key, "doc_id long, text string, y int, key long, n_terms long"), "examples")
    # of near copies with one label a single example stays, or their every word would look like a sign of it
    single = keyed.groupBy("key", "y").agg(F.min(F.struct("doc_id", "n_terms")).alias("one"))
    # again 2 * examples rows at most
    rows = single.select("one.*", "y", F.xxhash64(F.lit(8), "one.doc_id").alias("order")).toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    n, one = rows.column("n_terms").to_numpy(), rows.column("y").to_numpy() == 1
    fits = np.where(one, np.cumsum(n * one), np.cumsum(n * ~one)) <= postings // 2
    kept = docs.sparkSession.createDataFrame(pa.table({"doc_id": rows.column("doc_id").filter(pa.array(fits))}))
    return keyed.join(F.broadcast(kept), "doc_id").select("doc_id", "text", "y"), size


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, postings: int = POSTINGS) -> Model:
    """Learns from labels (doc_id, toxic) whose id isn't held out, joined to docs (doc_id, text).

    Bounded by its parameters: at most `examples` rows of either class, those with the smallest hash of their id (of
    near copies with one label one counts), and of these as many as have `postings` // 2 distinct terms in all. All
    terms of the examples are indexed, at any number of them; a term weighs its IDF times what it tells about the class.
    Document frequencies for the IDF are counted over all of docs. Labels that are null or whose id is null or not in
    docs are left out; an id labelled twice is toxic if one of the labels says so. Without examples of both classes
    every score is the share of label 1.

    Tasks count the terms and take the examples' vectors, `postings` pairs of term and count at most; the driver holds
    the vocabulary. One task builds the index and writes it to the shared folder, from where all workers of a machine map
    one copy. A shared folder that isn't in the local file system can't be mapped: there the driver holds the vectors
    once, as numbers, and broadcasts them, and each worker builds the index.
    """
    tidy()  # of what ran in the driver before
    sample, size = chosen_examples(docs, labels, examples, postings)
    total = sum(size.values())
    prior = size.get(True, 0) / total if total else 0.0
    n_1, n_0 = (sample.where(F.col("y") == k).count() for k in (1, 0))
    found = class_counts(sample).orderBy("term").toArrow().combine_chunks() if n_1 and n_0 else None
    if found is None or not len(found):
        return Model(None, "", np.zeros(3), prior, prior)
    vocabulary = found.column("term").chunk(0)
    tells = telling(found.column("n_1").to_numpy().astype(float), found.column("n_0").to_numpy().astype(float), n_1, n_0)
    del found
    met = document_counts(docs, vocabulary).toArrow()
    df = np.zeros(len(vocabulary))
    df[met.column("term").to_numpy()] = met.column("n").to_numpy()
    del met
    idf = (np.log((docs.count() + 1) / (df + 1)) + 1) * (tells + FLOOR)
    # telling terms first: what searches look up lies together
    order = np.argsort(-idf, kind="stable")
    vocabulary, idf = vocabulary.take(pa.array(order)), idf[order]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b)
            for rows in slices(texts, SLICE):
                first, terms, counts = term_numbers([texts[k] for k in rows], vocabulary)
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in (0, 2)), *lists], names=["doc_id", "y", "terms", "counts"])

    spark, name = docs.sparkSession, uuid4().hex
    rows = map_rows(sample, ["doc_id", "text", "y"], vectors, "doc_id long, y int, terms array<int>, counts array<int>")
    source: Broadcast | str
    if local_path(at := fresh_dir(spark, "vectors")):
        rows.write.parquet(at)
        source = local_path(fresh_dir(spark, "index"))
        write_index(spark, local_path(at), vocabulary, idf, source)
        facts = spark.read.parquet(at).select("doc_id", "y", (F.size("terms") > 0).alias("some")).toArrow().sort_by("doc_id")
        y, some = facts.column("y").to_numpy() == 1, facts.column("some").to_numpy()
    else:
        rows = rows.toArrow().sort_by("doc_id")
        y, some = rows.column("y").to_numpy() == 1, pc.list_value_length(rows.column("terms")).to_numpy() > 0
        source = spark.sparkContext.broadcast(sorted_vectors(rows) | {"vocabulary": vocabulary, "idf": idf})
    del rows, vocabulary
    y, n = y.astype(float), int(some.sum())

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = index_of(source, name)
        for b in batches:
            own = b.column(0).to_numpy()
            size = index.first[own + 1] - index.first[own]
            first, at = np.append(0, np.cumsum(size)), stretches(index.own, index.first[own], index.first[own + 1])
            found = index.nearest_of(first, at["of"], tfidf(first, at["of"], at["count"], index.idf), neighbours, own.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(near, index.labels, prior) for near in found], pa.list_(pa.float64()))], names=["id", "x"])

    x = spark.range(0, n, 1, -(-n // 512)).mapInArrow(alone(leave_one_out), "id long, x array<double>").toArrow().sort_by("id")
    by = np.where(y == 1, prior * len(y) / n_1, (1 - prior) * len(y) / n_0)
    beta = fit_logistic(np.array(x.column("x").to_pylist()), y[some], by[some])
    return Model(source, name, beta, prior, ((by * y)[~some].sum() + 0.5 * prior) / (by[~some].sum() + 0.5))


def scorer(model: Model, neighbours: int = NEIGHBOURS):
    """A function from texts to their (score, [(cosine, example)]); it remembers what a bounded number of texts got."""
    if model.shared is None:
        return lambda texts: [(model.bare, [])] * len(texts)
    vocabulary, index = index_of(model.shared, model.name)
    seen: OrderedDict[bytes, tuple] = OrderedDict()

    def score(texts: list[bytes]) -> list[tuple[float, list]]:
        keys = [blake2b(x, digest_size=16).digest() for x in texts]
        new = {key: x for key, x in zip(keys, texts, strict=True) if key not in seen}
        first, terms, counts = term_numbers(list(new.values()), vocabulary)
        found = index.nearest_of(first, terms, tfidf(first, terms, counts, index.idf), neighbours)
        for key, near, n in zip(new, found, np.diff(first).tolist(), strict=True):
            z = float(np.dot(features(near, index.labels, model.prior), model.beta))
            at = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if n else model.bare
            seen[key] = at, near
        out = [seen[key] for key in keys]
        while len(seen) > SEEN:
            seen.popitem(last=False)
        return out

    return score


def score_documents(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS, with_evidence: bool = True) -> DataFrame:
    """doc_id, score and, with_evidence, evidence (doc_id, similarity and label of the nearest examples): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model, neighbours)
        ids, labels = index_of(model.shared, model.name)[1].facts() if model.shared else ((), ())
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for b in (part for batch in batches for part in pieces(batch, SLICE)):
            got = score(text_bytes(b))
            cols = [b.column(0), pa.array([x for x, _ in got], pa.float64())]
            if with_evidence:
                named = [[{"doc_id": int(ids[i]), "similarity": s, "label": int(labels[i])} for s, i in near] for _, near in got]
                cols.append(pa.array(named, kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "evidence"][: len(cols)])

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, score double" + ", evidence array<struct<doc_id:long,similarity:double,label:int>>" * with_evidence)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, with_evidence: bool = True, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted and, with_evidence, evidence: a row for each row of docs (doc_id, text).

    A text's score is the calibrated, distance-weighted vote of its nearest labelled examples by TF-IDF cosine; a text
    without any of the examples' words, an empty or null one too, has no neighbours and gets the rate of label 1 among
    examples without words. Null ids and repeated rows pass through; other columns are ignored; empty tables give empty results.
    """
    model = fit(docs, labels, **settings)
    got = score_documents(docs, model, settings.get("neighbours", NEIGHBOURS), with_evidence)
    return got.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["evidence"] * with_evidence)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns, in one pass over the texts.

    The score travels beside the row: whole rows pass through the mapping, so nothing is joined back. Columns are
    numbered on the way, so their names may be any.
    """
    model = fit(docs, labels, **settings)
    neighbours = settings.get("neighbours", NEIGHBOURS)
    small_batches(docs.sparkSession)
    plain, text = numbered(docs), f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model, neighbours)
        for b in (part for batch in batches for part in pieces(batch, SLICE, text)):
            yield b.filter(pa.array([x < threshold for x, _ in score(text_bytes(b, text))], pa.bool_()))

    return plain.mapInArrow(alone(run), plain.schema).toDF(*docs.columns)
