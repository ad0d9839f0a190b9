"""Structure-aware splitting of normalised blocks into chunks under a token budget, with overlap."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np

from inkmill.schemas import EngineError

#: Unicode White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
LIGHT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!\"#%&'()*,-./:;?@[\\]_{}")
_WEIGHT = {c: 0 for c in WHITE} | {c: 3 for c in LIGHT}
OTHER, SCALE = 15, 10
#: Where a text is best cut: after the last of the first of these that a window holds; white space comes after them.
CUTS = (("\n\n",), ("\n",), ("。", "！", "？"), ("；", "，"), (".", "?", "!"))
_MARKER = re.compile(r"(?:[-*+]|[0-9]{1,9}[.)])(?=[ \t]|\Z)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_LAST_SPACE = re.compile(f"[{WHITE}](?=[^{WHITE}]*\\Z)")


_TABLE = np.full(max(map(ord, _WEIGHT)) + 2, OTHER, np.int64)
for _c, _w in _WEIGHT.items():
    _TABLE[ord(_c)] = _w


def weights(text: str) -> np.ndarray:
    """Each character's weight."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def weigh(text: str) -> int:
    return int(weights(text).sum())


def estimate(text: str) -> int:
    """Estimated tokens: the weights' sum in tenths, rounded up."""
    return -(-weigh(text) // SCALE)


@dataclass(frozen=True)
class Unit:
    """A piece of one block. divisible: cut from running text, so a tail of it may serve as overlap."""

    text: str
    path: tuple
    first: int
    last: int
    divisible: bool = False


class Meter:
    """Sizes of texts. The built-in estimate is additive and joins add white space alone, so sums of weights do; any
    other estimator is asked about the joined text."""

    def __init__(self, estimator: Callable[[str], int] | None = None):
        self.estimator = estimator
        self.known: dict[str, int] = {}

    def weight(self, text: str) -> int:
        got = self.known.get(text)
        if got is None:
            got = self.known[text] = weigh(text)
        return got

    def size(self, units: list[Unit], sep: str = "\n\n") -> int:
        if self.estimator:
            return self.estimator(sep.join(u.text for u in units))
        return -(-sum(self.weight(u.text) for u in units) // SCALE)

    def text(self, text: str) -> int:
        return self.estimator(text) if self.estimator else -(-self.weight(text) // SCALE)

    def windows(self, text: str, budget: int) -> Callable[[int], int]:
        """A function from a start to the end of the longest window within budget, of one character at least."""
        n = len(text)
        if self.estimator is None:
            sums = np.concatenate([[0], np.cumsum(weights(text))])
            return lambda i: max(i + 1, int(np.searchsorted(sums, sums[i] + budget * SCALE, "right")) - 1)

        def gallop(i: int) -> int:
            step, fits = 1, i
            while fits < n:
                end = min(i + step, n)
                if self.estimator(text[i:end]) > budget:
                    inside = range(fits + 1, end)
                    return max(i + 1, fits + bisect.bisect_left(inside, True, key=lambda e: self.estimator(text[i:e]) > budget))
                fits, step = end, step * 2
            return n

        return gallop


def cut_at(window: str) -> int:
    for marks in CUTS:
        at = max(window.rfind(m) for m in marks)
        if at >= 0:
            return at + len(marks[0])
    m = _LAST_SPACE.search(window)
    return m.end() if m else len(window)


def split_text(text: str, budget: int, meter: Meter) -> Iterator[str]:
    """Parts of running text. Each window is cut at its best place, the last one too, even if all of it would fit."""
    text = text.strip(WHITE)
    end_of = meter.windows(text, budget)
    i = 0
    while i < len(text):
        cut = i + cut_at(text[i : end_of(i)])
        if part := text[i:cut].strip(WHITE):
            yield part
        i = cut
        while i < len(text) and text[i] in WHITE:
            i += 1


def line_at(block: dict, offset: int) -> int:
    first, last = block["start_line"], block["end_line"]
    if first <= 0:
        return first
    return min(first + offset, last) if last >= first else first + offset


def _runs(pieces: list[Unit], budget: int, meter: Meter, lead: str = "", may_flush: Callable[[list[Unit]], bool] = bool) -> Iterator[list[Unit]]:
    """Consecutive pieces, as many as fit (with lead before them); a piece that fits nowhere is a run of its own."""
    run: list[Unit] = []
    held = base = 0 if meter.estimator else meter.weight(lead)
    for p in pieces:
        if meter.estimator:
            over = meter.estimator(lead + "\n".join(x.text for x in [*run, p])) > budget
        else:
            over = held + meter.weight(p.text) > budget * SCALE
        if run and over and may_flush(run):
            yield run
            run, held = [], base
        run.append(p)
        held += 0 if meter.estimator else meter.weight(p.text)
    if run:
        yield run


def _merge(run: list[Unit], lead: str = "", first: int | None = None) -> Unit:
    return replace(run[0], text=lead + "\n".join(u.text for u in run), first=run[0].first if first is None else first, last=run[-1].last)


def split_table(block: dict, whole: Unit, budget: int, meter: Meter) -> list[Unit]:
    """Rows in order, the two heading lines before each part."""
    lines = block["content"].split("\n")
    if len(lines) <= 2:
        return [whole]
    rows = [replace(whole, text=t, first=line_at(block, k), last=line_at(block, k)) for k, t in enumerate(lines[2:], 2)]
    lead = lines[0] + "\n" + lines[1] + "\n"
    return [_merge(run, lead, line_at(block, 0)) for run in _runs(rows, budget, meter, lead)]


def raw_item_spans(block: dict, n: int) -> list[tuple[int, int]] | None:
    """Source lines of the n outermost items, or None if the source shows another number of them."""
    raw = block["raw_content"].split("\n")
    marked = []
    for k, line in enumerate(raw):
        body = line.lstrip(" \t")
        if _MARKER.match(body):
            marked.append((sum(4 if c == "\t" else 1 for c in line[: len(line) - len(body)]), k))
    starts = [k for indent, k in marked if indent == min(marked)[0]]
    if len(starts) != n:
        return None
    spans = []
    for a, b in zip(starts, [*starts[1:], len(raw)], strict=True):
        while b - 1 > a and not raw[b - 1].strip(WHITE):
            b -= 1
        spans.append((line_at(block, a), line_at(block, b - 1)))
    return spans


def split_list(block: dict, whole: Unit, budget: int, meter: Meter) -> list[Unit]:
    """Outermost items in order, never cut inside."""
    lines = block["content"].split("\n")
    heads = [k for k, line in enumerate(lines) if _MARKER.match(line)]
    if len(heads) <= 1 or heads[0] != 0:
        return [whole]
    spans = [(line_at(block, a), line_at(block, b - 1)) for a, b in zip(heads, [*heads[1:], len(lines)], strict=True)]
    if (block.get("raw_content") or "").strip(WHITE):
        spans = raw_item_spans(block, len(heads)) or [(block["start_line"], block["end_line"])] * len(heads)
    items = [replace(whole, text="\n".join(lines[a:b]), first=s[0], last=s[1]) for a, b, s in zip(heads, [*heads[1:], len(lines)], spans, strict=True)]
    return [_merge(run) for run in _runs(items, budget, meter)]


def code_lines(block: dict) -> tuple[int, int]:
    """First and last source line of the code itself, without fences."""
    first, last = block["start_line"], block["end_line"]
    raw = (block.get("raw_content") or "").split("\n")
    m = _FENCE.match(raw[0])
    if len(raw) < 2 or not m:
        return first, last
    close = re.fullmatch(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[{WHITE}]*", raw[-1])
    return first + (first > 0), last - bool(last > 0 and close)


def split_code(block: dict, whole: Unit, budget: int, meter: Meter) -> list[Unit]:
    """Whole lines in order; lines of white space alone never make a part."""
    first, last = code_lines(block)
    lines = block["content"].split("\n")
    numbers = [min(first + k, last) if last >= first else first + k for k in range(len(lines))]
    units = [replace(whole, text=t, first=n, last=n) for t, n in zip(lines, numbers, strict=True)]
    return [_merge(run) for run in _runs(units, budget, meter, may_flush=lambda run: any(u.text.strip(WHITE) for u in run))]


def units_of(block: dict, budget: int, meter: Meter) -> list[Unit]:
    whole = Unit(block["content"], tuple(block["heading_path"]), block["start_line"], block["end_line"])
    if meter.text(whole.text) <= budget:
        return [whole]
    special = {"table": split_table, "list": split_list, "code": split_code}.get(block["type"])
    if special:
        parts = special(block, whole, budget, meter)
    else:
        parts = [replace(whole, text=t, divisible=True) for t in split_text(whole.text, budget, meter)]
    return [p for p in parts if p.text.strip(WHITE)] or [whole]


def tail(unit: Unit, target: int, meter: Meter) -> Unit | None:
    """The longest tail of a unit's text within target, if it says anything."""
    text, i = unit.text, len(unit.text)
    if target <= 0:
        return None
    if meter.estimator:
        i = bisect.bisect_left(range(len(text)), True, key=lambda k: meter.estimator(text[k:].strip(WHITE)) <= target)
    else:
        room = target * SCALE
        while i and (w := _WEIGHT.get(text[i - 1], OTHER)) <= room:
            room -= w
            i -= 1
    best = text[i:].strip(WHITE)
    if any(c not in WHITE and not unicodedata.category(c).startswith("P") for c in best):
        return replace(unit, text=best)
    return None


def overlap(before: list[Unit], fresh: Unit, budget: int, target: int, meter: Meter) -> list[Unit]:
    """What the chunk before lends to the one that begins with fresh."""
    need = meter.size([fresh])
    if target <= 0 or not before or need >= budget:
        return []
    k = len(before)
    while k and meter.size(before[k - 1 :]) <= target:
        k -= 1
    lent = before[k:]
    last = before[-1]
    if not lent:
        part = tail(last, target, meter) if last.divisible else last
        lent = [part] if part else []
    while len(lent) > 1 and meter.size([*lent, fresh]) > budget:
        lent = lent[1:]
    if not lent or meter.size([*lent, fresh]) <= budget:
        return lent
    part = tail(lent[-1], min(target, budget - need), meter) if lent[-1].divisible else None
    return [part] if part and meter.size([part, fresh]) <= budget else []


def content_budget(path: tuple | list, size: int, meter: Meter) -> int:
    return max(1, size - meter.text(" > ".join(path)))


def split(blocks: list[dict], size: int = 512, overlap_size: int = 64, estimator: Callable[[str], int] | None = None) -> list[dict]:
    """Chunks (chunk_index, content, heading_path, start_line, end_line) of a document's normalised blocks, in order.

    A chunk never spans two heading paths, and holds at least one unit that no chunk before it had.
    """
    if size <= 0 or not 0 <= overlap_size < size:
        raise EngineError("DOCUMENT_SPLIT_FAILED", "invalid chunk settings")
    meter = Meter(estimator)
    units = [u for b in blocks if b["content"].strip(WHITE) for u in units_of(b, content_budget(b["heading_path"], size, meter), meter)]
    out: list[dict] = []
    for path, group in groupby(units, key=lambda u: u.path):
        todo = list(group)
        budget = content_budget(path, size, meter)
        chunk: list[Unit] = []
        k = 0
        while k < len(todo):
            chunk = [*overlap(chunk, todo[k], budget, overlap_size, meter), todo[k]]
            k += 1
            while k < len(todo) and meter.size([*chunk, todo[k]]) <= budget:
                chunk.append(todo[k])
                k += 1
            starts = [u.first for u in chunk if u.first] or [0]
            out.append({"chunk_index": len(out), "content": "\n\n".join(u.text for u in chunk), "heading_path": list(path), "start_line": min(starts), "end_line": max(u.last for u in chunk)})
    return out
