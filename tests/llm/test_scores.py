import mmap
import random
import re

import numpy as np
import pytest

from inkmill.llm import license_scan as L
from inkmill.llm import mixing, quality, toxicity

from .helpers import ascii_lower, docs, empty, key

LABELS = "doc_id LONG, quality INT, toxic INT"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


NOTICES = [
    "Released under the MIT License.",
    "this\n\nfine software is RELEASED under the terms of the mit-license!",
    "released under the mit",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "licensed under the apache license version 3.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the gnu lesser general public license version 3 or later",
    "licensed under the gnu general private license",
    "general public license general public license",
    "Licensed under CC BY-NC 4.0.",
    "mit licenses; amit license",
    None,
    "",
    "é mit license é",
]


def test_license_base_columns(spark):
    df = docs(spark, [(k, t, None, None, "x", "y") for k, t in enumerate(NOTICES)] + [(None, "mit license", None, None, None, None)] + [(99, "a " * 50_000 + "mit license " * 3, None, None, None, None)] * 2)
    got = L.license_scan(df).collect()
    assert len(got) == len(NOTICES) + 3
    text = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        w = words_of(text[r.doc_id])
        places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert L.license_scan(empty(spark)).count() == 0


def test_license_templates():
    compiled = [L.compile_template(*t) for t in L.TEMPLATES]
    found = [L.scan((t or "").encode(), [], compiled)[5] for t in NOTICES]
    assert found == ["mit", "mit", "", "apache", "", "gpl", "gpl", "", "", "cc-by-nc", "", "", "", ""]


def test_automata_equal_a_regular_expression():
    rng = random.Random(1)
    for _ in range(400):
        words = "a b c d".split()
        parts, rx = [], []
        for _ in range(rng.randint(1, 5)):
            kind, w = rng.random(), rng.choice(words)
            if kind < 0.5:
                parts.append(w)
                rx.append(f"{w} ")
            elif kind < 0.7:
                parts.append(f"[[{w} [[x]]]]")
                rx.append(f"(?:{w} (?:x )?)?")
            else:
                n = rng.randint(1, 2)
                parts.append(f"{{{{{n}}}}}")
                rx.append(rf"(?:\w+ ){{0,{n}}}")
        if not any(p in words for p in parts):
            continue
        a = L.compile_template("l", 1.0, " ".join(parts))
        pattern = re.compile(r"(?<!\w)" + "".join(rx))
        for _ in range(20):
            text = [rng.choice([*words, "x"]) for _ in range(rng.randint(0, 9))]
            assert (a.find([t.encode() for t in text]) is not None) == (pattern.search("".join(t + " " for t in text)) is not None), (parts, text)


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    bad = ["vilea", "vileb", "vilec", "viled"]
    rows, labels = [], []
    for k in range(n):
        w = rng.choices(plain, k=rng.randint(5, 80))
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        if low:
            w = [x + rng.choice(["%%%", "$$$", "###"]) for x in w]
        rows.append((k, " ".join(w).capitalize() + ".", "en", "s", "clash", "clash"))
        if rng.random() < 0.7:
            labels.append((k, int(not low), int(toxic)))
    truth = {k: x for k, *x in labels}
    labels += [(0, None, None), (None, 1, 1), (10**9, 1, 1), labels[0]]
    rows += [(n, None, None, None, None, None), (n + 1, "", None, None, None, None), (None, "vilea vileb", None, None, None, None), (n + 2, "w " * 100_000 + "vilea", None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, docs(spark, []).schema).repartition(3), spark.createDataFrame(labels, LABELS), truth


def crc(k, m):
    import zlib

    return zlib.crc32(str(k).encode()) % m


def test_toxicity(spark):
    df, labels, truth = corpus(spark)
    got = toxicity.toxicity(df, labels)
    out = got.collect()
    assert len(out) == df.count() and dict(got.dtypes)["predicted"] == "int"
    by = {r.doc_id: r for r in out}
    held = [k for k in truth if crc(k, 5) == 0]
    assert all(by[k].held_out == (crc(k, 5) == 0) for k in truth) and not by[None].held_out
    assert np.mean([by[k].predicted == truth[k][1] for k in held]) > 0.97
    assert by[None].predicted == 1 and by[None].evidence and by[900].score == by[901].score < 0.5
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(k, q, 1 - t if crc(k, 5) == 0 else t) for k, (q, t) in truth.items()], LABELS)
    again = {r.doc_id: r.score for r in toxicity.toxicity(df, flipped).collect()}
    assert again == {k: r.score for k, r in by.items()}
    clean = toxicity.keep_clean(df, labels)
    assert clean.columns == df.columns
    assert sorted(map(tuple, clean.collect()), key=key) == sorted((tuple(r) for r in df.collect() if by[r.doc_id].predicted == 0), key=key)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0}


def test_toxicity_of_a_small_table(spark):
    df, labels, truth = corpus(spark, 60, 1)
    by = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    toxic = [k for k in truth if truth[k][1] == 1]
    assert len(truth) < 45 and np.mean([by[k].predicted for k in toxic]) > 0.7
    assert np.mean([by[k].predicted for k in truth if truth[k][1] == 0]) < 0.1
    # every text with a word of an example has neighbours, whatever the word tells
    assert all(by[k].evidence for k in truth)


@pytest.mark.parametrize("n,v,share", [(500, 30, 0.15), (3000, 200, 0.05), (40, 3000, 0.4)])
def test_block_max_search_is_exact(n, v, share):
    rng = np.random.default_rng(n)
    counts = (rng.random((n, v)) < share * rng.random(v) * 2) * rng.integers(1, 9, (n, v))
    counts[: n // 12] = counts[n // 12 : 2 * (n // 12)]
    idf = np.where(rng.random(v) < 0.5, 1e-6, rng.random(v) ** 4 + 1e-4)
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    w /= np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1e-300)
    example, term = np.nonzero(counts)
    index = toxicity.BlockMaxIndex(np.arange(n), np.zeros(n), np.searchsorted(example, np.arange(n + 1)), lambda: (term, counts[example, term]), idf)
    for k in range(60):
        q = counts[rng.integers(n)] if k % 2 else rng.integers(0, 4, v) * (rng.random(v) < 0.2)
        t = np.flatnonzero(q)
        if not len(t):
            continue
        first, without = np.array([0, len(t)]), k if k % 3 else -1
        x = toxicity.tfidf(first, t, q[t], idf)
        s = w[:, t] @ x
        want = sorted(((round(float(a), 12), i) for i, a in enumerate(s) if a > 0 and i != without), key=lambda a: (-a[0], a[1]))[:10]
        got = index.nearest(t, x, 10, without)
        assert [i for _, i in got] == [i for _, i in want] or np.allclose([a for a, _ in got], [a for a, _ in want], atol=1e-10)
        assert len(got) == len(want)


def test_quality(spark):
    df, labels, truth = corpus(spark, seed=2)
    got = quality.quality(df, labels)
    out = got.collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out}
    held = [k for k in truth if crc(k, 4) == 2]
    assert all(by[k].held_out == (crc(k, 4) == 2) for k in truth)
    assert np.mean([by[k].predicted == truth[k][0] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    flipped = spark.createDataFrame([(k, 1 - q if crc(k, 4) == 2 else q, t) for k, (q, t) in truth.items()], LABELS)
    again = {r.doc_id: r.score for r in quality.quality(df, flipped).collect()}
    assert again == {k: r.score for k, r in by.items()}
    good = quality.keep_good(df, labels)
    assert good.columns == df.columns
    assert sorted(map(tuple, good.collect()), key=key) == sorted((tuple(r) for r in df.collect() if by[r.doc_id].predicted == 1), key=key)
    assert quality.quality(empty(spark), labels).count() == 0
    assert {r.score for r in quality.quality(df, labels.limit(0)).collect()} == {0.5}


def test_compiled_rules_equal_the_model(spark):
    df, labels, _ = corpus(spark, seed=4)
    model = quality.fit(df, labels)
    rows = quality.with_statistics(df.select("doc_id", "text")).select("__stats.*", model.column().alias("s")).toPandas()
    assert np.allclose(model.predict(rows[quality.STATISTICS].to_numpy()), rows["s"]) and 0 < len(model.rules) < 400


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if w[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), "en", rng.choice(["a", "b", "b", "b", "b", "é", "", None]), "clash", "clash") for k in range(3000)]
    rows += [rows[7], rows[7], (None, "x y", None, "a", None, None), (3001, None, None, "zero", None, None), (3002, "w " * 5000, None, "a", None, None)]
    df = docs(spark, rows)
    got = mixing.mix(df, block=128)
    out = got.collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.times and r.source_size == sizes[r.source]
    want = brute_targets(sizes)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(200, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(df.repartition(7), block=128).collect()
    assert sorted(map(tuple, again), key=key) == sorted(map(tuple, out), key=key)
    mixed = mixing.apply_mix(df, got)
    assert mixed.columns == df.columns and mixed.count() == sum(r.times for r in out)
    assert mixing.mix(empty(spark)).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 999):
        size = [float(rng.choice([0, 1, 5, 5, 100])) for _ in range(n)]
        psi = [rng.random() for _ in range(n)]
        out = mixing.flight(size, psi, 5)
        assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
        assert abs(sum(out) - sum(psi)) < 1e-6 and abs(sum(a * b for a, b in zip(size, out)) - sum(a * b for a, b in zip(size, psi))) < 1e-4
        assert all(p in (0.0, 1.0) for p in mixing.land(size, out))
    hits = np.mean([mixing.flight([3.0, 1.0, 4.0, 1.0, 5.0], [0.3] * 5, s) for s in range(4000)], axis=0)
    assert np.allclose(hits, 0.3, atol=0.03)  # each keeps its expectation


def test_flight_and_mix_count_repeated_rows(spark):
    rng = random.Random(3)
    n = 600
    copies = [float(rng.choice([1, 1, 2, 7])) for _ in range(n)]
    size = [c * rng.choice([0, 1, 5, 100, 3000]) for c in copies]
    psi = [rng.random() for _ in range(n)]
    out = mixing.flight(size, psi, 5, copies)
    assert sum(0 < p < 1 for p in out) <= 2
    for row in (copies, size):
        assert abs(sum(a * b for a, b in zip(row, out)) - sum(a * b for a, b in zip(row, psi))) < 1e-3
    done = mixing.land(size, out, copies)
    assert all(p in (0.0, 1.0) for p in done)
    # every row of a group of copies is one: documents and words of each source come near their expectation
    rows = []
    for k in range(1500):
        text = " ".join(["w"] * rng.choice([1, 3, 10, 40, 200]))
        rows += [(k, text, "en", f"s{k % 2}", "x", "y")] * rng.choice([1, 1, 1, 5])
    got = mixing.mix(docs(spark, rows), block=256).collect()
    for source in ("s0", "s1"):
        of = [r for r in got if r.source == source]
        rate = of[0].target / of[0].source_size
        assert abs(sum(r.taken for r in of) - of[0].target) <= 0.001 * of[0].target
        assert abs(sum(r.times for r in of) - rate * len(of)) <= 25, (sum(r.times for r in of), rate * len(of))


def test_workers_map_one_index(spark, monkeypatch):
    df, labels, _ = corpus(spark, 300, 4)
    model = toxicity.fit(df, labels)
    vocabulary, index = toxicity.index_of(model.shared, model.name)
    for name in [x for x in index.ARRAYS if getattr(index, x).size]:
        x = getattr(index, name)
        while isinstance(x.base, np.ndarray):
            x = x.base
        assert isinstance(x.base, mmap.mmap), name  # no worker holds a copy of its own
    assert len(vocabulary) == len(index.idf)
    got = sorted(map(tuple, toxicity.score_documents(df, model).collect()), key=key)
    # a store that can't be mapped: each worker builds the same index
    monkeypatch.setattr(toxicity, "local_path", lambda _: None)
    apart = toxicity.fit(df, labels)
    assert np.array_equal(apart.beta, model.beta) and not isinstance(apart.shared, str)
    assert sorted(map(tuple, toxicity.score_documents(df, apart).collect()), key=key) == got


def test_written_arrays_come_back(tmp_path):
    from inkmill.llm.common import mapped_arrays, write_arrays

    arrays = {"a": np.zeros((0, 3), np.float32), "b": np.array([(1, 2.5)], [("of", "<u2"), ("w", "<f4")]), "c": np.arange(5)}
    for _ in range(2):  # a task may run twice
        write_arrays(f"{tmp_path}/x", arrays)
    got = mapped_arrays(f"{tmp_path}/x")
    assert all(np.array_equal(got[k], x) and got[k].dtype == x.dtype and got[k].shape == x.shape for k, x in arrays.items())
    assert [p.name for p in tmp_path.iterdir()] == ["x"]
