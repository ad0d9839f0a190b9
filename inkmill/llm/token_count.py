"""Token counts by overlap resynchronisation."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes
from .units import encoder, slices

#: A text of more characters than a window and its overlap is encoded in windows of WINDOW characters that share OVERLAP
#: with the next one.
WINDOW, OVERLAP = 16_384, 256
#: White space that ends a pre-token in any context (see units.py).
STABLE = frozenset("\t\n\x0b\x0c\r ")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_windows int, n_widened int"


def count_huge(lib, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, windows, times an overlap was widened) of one text, never encoding more than about a window at once.

    Neighbouring windows are encoded with offsets. They are spliced at the last place of their overlap that starts a
    token in both and follows white space: there the tokenizer cuts in any context, so what either window has on its own
    side of that place is what the whole text has. Where an overlap has no such place, it doubles.
    """

    def starts(a: int, b: int) -> list[int]:
        return [a + x for x, _ in lib.encode(text[a:b], add_special_tokens=False).offsets]

    n, total, windows, widened = len(text), 0, 1, 0
    begin, end = 0, min(n, window + overlap)
    here = starts(begin, end)
    while end < n:
        lap, start = overlap, max(begin + 1, end - overlap)
        while True:
            stop = min(n, start + window + lap)
            there = starts(start, stop)
            common = set(here).intersection(there)
            places = [p for p in common if start < p < end and text[p - 1] in STABLE]
            if places or stop >= n and end >= n:
                break
            widened += 1
            lap *= 2
            end = min(n, end + lap)
            here = starts(begin, end)
            if end >= n:
                break
        if not places:
            break
        at = max(places)
        total += bisect.bisect_left(here, at)
        here = there[bisect.bisect_left(there, at) :]
        begin, end, windows = at, stop, windows + 1
    return total + len(here), windows, widened


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_windows, n_widened: one row for each row of docs (doc_id, text).

    Null texts count as empty: 0 bytes, 0 tokens. Null ids, ties and repeated rows are kept as they are; other columns
    of docs, whatever their names, are ignored. An empty table gives an empty table. One pass without a shuffle; a
    worker holds a batch of texts, and of a text longer than one window the tokens of two windows. A text of one window
    has nothing to splice; such texts are encoded many at a time.
    tokenizer: path of a file of the tokenizers library, there on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = text_bytes(b)
            n_tokens, n_windows, n_widened = [0] * len(texts), [1] * len(texts), [0] * len(texts)
            small = []
            for k, x in enumerate(texts):
                if len(x) > window + overlap and len(s := x.decode("utf-8", "replace")) > window + overlap:
                    n_tokens[k], n_windows[k], n_widened[k] = count_huge(enc.lib, s, window, overlap)
                else:
                    small.append(k)
            for part in slices([texts[k] for k in small]):
                rows = [small[k] for k in part]
                for k, n in zip(rows, enc.counts([texts[k] for k in rows]), strict=True):
                    n_tokens[k] = n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_()), pa.array(n_windows, pa.int32()), pa.array(n_widened, pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_windows", "n_widened"],
            )

    return map_rows(docs, ["doc_id", "text"], run, SCHEMA)
