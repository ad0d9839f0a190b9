"""License scans by template-markup matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, certainty, text). [[...]] is optional, {{n}} stands for up to n words of any kind; the rest must match word
#: for word. The wording is that of the published licenses and of the notices that they ask for.
TEMPLATES = [
    ("mit", 0.8, "[[this {{3}} is]] released under the [[terms of the]] mit license"),
    ("mit", 0.8, "licensed under the [[terms of the]] mit license"),
    (
        "mit",
        1.0,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("apache", 0.8, "licensed under the apache license version 2 0 [[the license]]"),
    (
        "apache",
        1.0,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http https]] {{1}} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", 0.8, "licensed under the [[terms of the]] gnu [[affero]] [[lesser]] general public license [[as published by the free software foundation]] [[version {{1}} [[or later]]]]"),
    (
        "gpl",
        1.0,
        "{{3}} is free software you can redistribute it and or modify it under the terms of the gnu [[affero]] [[lesser]] general public license as published by the free software foundation either version {{2}} of the license or at your option any later version",
    ),
    ("cc-by-nc", 0.8, "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-nc", 0.9, "licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 international [[public]] license"),
    ("cc-by", 0.9, "licensed under [[a]] [[the]] creative commons attribution 4 0 international [[public]] license"),
    (
        "bsd",
        1.0,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {{1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        1.0,
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
]

#: Bytes to words: A-Z lower-cased, all ASCII but letters and digits to spaces, the rest as it is.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PHRASE_SCORE = 0.5
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")


def to_words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n; on[s] are the (word or None for any, next state) steps of s, closed over optional regions."""

    label: str
    certainty: float
    on: tuple[tuple[tuple[bytes | None, int], ...], ...]
    final: frozenset[int]
    anchor: bytes  # a word that every match holds

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """(start, end) of a match that begins first and, of those, is accepted first; a mandatory word must be equal."""
        active: dict[int, int] = {}
        best: tuple[int, int] | None = None
        for k, w in enumerate(words):
            if best is None:
                active[0] = min(active.get(0, k), k)
            now: dict[int, int] = {}
            for s, start in active.items():
                for need, to in self.on[s]:
                    if (need is None or need == w) and now.get(to, start) >= start:
                        now[to] = start
            for s, start in now.items():
                if s in self.final and (best is None or start < best[0]):
                    best = (start, k + 1)
            active = now if best is None else {s: x for s, x in now.items() if x < best[0]}
            if best is not None and not active:
                return best
        return best


def compile_template(label: str, certainty: float, text: str) -> Automaton:
    """The automaton of a template's markup; regions nest."""
    steps: list[list[tuple[bytes | None, int]]] = [[]]
    skips: dict[int, list[int]] = {}
    opened: list[int] = []
    mandatory: list[bytes] = []
    for token in _MARKUP.findall(text.lower()):
        here = len(steps) - 1
        if token == "[[":
            opened.append(here)
        elif token == "]]":
            skips.setdefault(opened.pop(), []).append(here)
        elif token.startswith("{{"):
            for _ in range(int(token[2:-2])):
                here = len(steps) - 1
                steps[here].append((None, here + 1))
                steps.append([])
                skips.setdefault(here, []).append(here + 1)
        else:
            for w in to_words(token.encode()):
                here = len(steps) - 1
                steps[here].append((w, here + 1))
                steps.append([])
                if not opened:
                    mandatory.append(w)
    if opened or not mandatory:
        raise ValueError(f"template without an end or mandatory wording: {text}")

    def closure(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in skips.get(todo.pop(), []):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    closed = [closure(s) for s in range(len(steps))]
    on = tuple(tuple(dict.fromkeys(step for t in sorted(closed[s]) for step in steps[t])) for s in range(len(steps)))
    final = frozenset(s for s in range(len(steps)) if len(steps) - 1 in closed[s])
    return Automaton(label, certainty, on, final, max(mandatory, key=len))


def scan(text: bytes, phrases: list[tuple[tuple[bytes, ...], str]], automata: list[Automaton]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    flat = text.translate(TO_WORDS)
    words = flat.split()
    places: list[int] = []
    base = set()
    for phrase, label in phrases:
        if phrase[-1] not in flat:
            continue
        at, n, last = -1, len(phrase), phrase[-1]
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if at + 1 >= n and tuple(words[at - n + 1 : at + 1]) == phrase:
                places.append(at - n + 1)
                base.add(label)
    labels, score = set(base), PHRASE_SCORE if base else 0.0
    for a in automata:
        if a.anchor in flat and a.find(words):
            labels.add(a.label)
            score = max(score, a.certainty)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs.

    Base columns count the places of the phrases; labels holds theirs and those of the templates whose automaton accepts
    a run of the text's words: optional regions may be missing, replaceable ones may hold anything up to their length,
    mandatory wording must match exactly. score is the greatest certainty among what was found, 0 where nothing was.
    Null texts are empty: 0 words, no places, empty labels. Null ids and repeated rows pass through, other columns are
    ignored, and an empty table gives an empty table. One pass without a shuffle, over whole texts.
    """
    compiled = [compile_template(*t) for t in templates]
    split = [(tuple(to_words(p.encode())), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [scan(x, split, compiled) for x in text_bytes(b)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
