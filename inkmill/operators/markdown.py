"""Markdown to typed blocks, and their canonical text.

A block parser for the CommonMark subset with GFM tables, strikethrough and task lists: ATX and Setext headings,
paragraphs, nested lists, quotes, pipe tables, fenced and indented code, HTML blocks, thematic breaks, and inline code,
emphasis, links, images, autolinks and raw HTML. Backslash escapes and entities stay as written. Link reference
definitions, over one line or several, are read for [text][label] and [label] links and vanish from the text.

Everything here is plain Python over one text; plans.ingest runs it in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from inkmill.operators.splitter import WHITE

SPACES = re.compile(r"[\t-\r \x85\xa0  -     　]+")

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*([^\s]*)(.*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?=[ \t]|$)")
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TITLE = r"(?:\"[^\"]*\"|'[^']*'|\([^()]*\))"
#: A link definition at the beginning of a paragraph's text; destination and title may stand on lines of their own.
_DEFINITION = re.compile(rf" {{0,3}}\[([^\[\]]+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE})?[ \t]*(?:\n|$)")
#: The same without a title, for a next line that only looks like one.
_BARE_DEFINITION = re.compile(r" {0,3}\[([^\[\]]+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)")
# Tag names that open an HTML block.
_HTML_NAMES = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_TAG = r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"
#: (opening, closing or None for the next blank line, may it interrupt a paragraph)
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->"), True),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>"), True),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf" {{0,3}}</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf" {{0,3}}{_TAG}[ \t]*$"), None, False),
]


@dataclass
class Node:
    """A block. first, last: lines of its text (0: none); at: the line it opened on."""

    kind: str
    at: int
    first: int = 0
    last: int = 0
    lines: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    level: int = 0  # of a heading; start number of an ordered list
    ordered: bool = False
    info: str = ""
    rows: list[list[str]] = field(default_factory=list)
    align: list[str] = field(default_factory=list)

    def span(self) -> tuple[int, int]:
        own = [(self.first, self.last)] if self.first else []
        own += [s for c in self.children if (s := c.span())[0]]
        return (min(a for a, _ in own), max(b for _, b in own)) if own else (0, 0)


def _expand(line: str) -> str:
    """Leading tabs to spaces, to stops of four."""
    out, k = "", 0
    while k < len(line) and line[k] in " \t":
        out += " " * (4 - len(out) % 4) if line[k] == "\t" else " "
        k += 1
    return out + line[k:]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _opens_block(line: str) -> bool:
    """Whether a line may not go on with a paragraph above it."""
    if not line.strip() or _ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line):
        return True
    if m := _ITEM.match(line):
        rest = line[m.end() :].strip()
        return bool(rest) and (m[2] in "-*+" or m[2][:-1] == "1")
    return any(o.match(line) and interrupts for o, _, interrupts in _HTML)


def _cells(row: str) -> list[str]:
    """A table row's cells; a bar after a backslash belongs to the cell."""
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    parts = re.split(r"(?<!\\)\|", row)
    if len(parts) > 1 and not parts[-1].strip() and re.search(r"(?<!\\)\|$", row):
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def _paragraph_open(nodes: list[Node]) -> bool:
    """Whether the last leaf is a paragraph that a lazy line may go on with."""
    while nodes:
        last = nodes[-1]
        if last.kind == "paragraph":
            return True
        nodes = last.children
    return False


class BlockParser:
    def __init__(self) -> None:
        self.labels: set[str] = set()

    def parse(self, lines: list[tuple[int, str]]) -> list[Node]:
        """Blocks of lines (number, text without its end)."""
        out: list[Node] = []
        k = 0
        while k < len(lines):
            number, line = lines[k][0], _expand(lines[k][1])
            if not line.strip():
                k += 1
            elif _indent(line) >= 4:
                k = self._indented(lines, k, out)
            elif m := _FENCE.match(line):
                k = self._fenced(lines, k, m, out)
            elif m := _ATX.match(line):
                text = m[2] or ""
                out.append(Node("heading", number, number, number, [re.sub(r"^#+$", "", text)], level=len(m[1])))
                k += 1
            elif _RULE.match(line):
                out.append(Node("thematic_break", number))
                k += 1
            elif _QUOTE.match(line):
                k = self._quote(lines, k, out)
            elif _ITEM.match(line):
                k = self._list(lines, k, out)
            elif (html := next((h for h in _HTML if h[0].match(line)), None)) is not None:
                k = self._html(lines, k, html[1], out)
            else:
                k = self._paragraph(lines, k, out)
        return out

    def _indented(self, lines: list[tuple[int, str]], k: int, out: list[Node]) -> int:
        node = Node("code", lines[k][0], lines[k][0])
        end = k
        while k < len(lines) and (not lines[k][1].strip() or _indent(_expand(lines[k][1])) >= 4):
            end = k + 1 if lines[k][1].strip() else end
            k += 1
        start = next(i for i, x in enumerate(lines) if x[0] == node.at)
        node.lines = [_expand(t)[4:] for _, t in lines[start:end]]
        node.last = lines[end - 1][0]
        out.append(node)
        return end

    def _fenced(self, lines: list[tuple[int, str]], k: int, m: re.Match, out: list[Node]) -> int:
        node = Node("fenced", lines[k][0], info=m[3])
        indent, mark, size = len(m[1]), m[2][0], len(m[2])
        close = re.compile(rf" {{0,3}}{re.escape(mark)}{{{size},}}\s*$")
        k += 1
        while k < len(lines):
            number, line = lines[k]
            k += 1
            if close.match(line):
                break
            node.lines.append(line[min(indent, _indent(line)) :])
            node.first, node.last = node.first or number, number
        out.append(node)
        return k

    def _quote(self, lines: list[tuple[int, str]], k: int, out: list[Node]) -> int:
        inner: list[tuple[int, str]] = []
        at = lines[k][0]
        while k < len(lines):
            line = _expand(lines[k][1])
            if m := _QUOTE.match(line):
                inner.append((lines[k][0], line[m.end() :]))
            elif _opens_block(line) or not _paragraph_open(BlockParser().parse(inner)):
                break
            else:
                inner.append((lines[k][0], line.lstrip()))
            k += 1
        out.append(Node("quote", at, children=self.parse(inner)))
        return k

    def _list(self, lines: list[tuple[int, str]], k: int, out: list[Node]) -> int:
        m = _ITEM.match(_expand(lines[k][1]))
        kind = m[2][-1]
        ordered = m[2][0].isdigit()
        node = Node("list", lines[k][0], ordered=ordered, level=int(m[2][:-1]) if ordered else 0)
        while k < len(lines):
            line = _expand(lines[k][1])
            m = _ITEM.match(line)
            if not m or m[2][-1] != kind or _RULE.match(line):
                break
            rest = line[m.end() :]
            pad = _indent(rest)
            width = m.end() + (pad if rest.strip() and 1 <= pad <= 4 else 1)
            inner = [(lines[k][0], line[width:] if rest.strip() else "")]
            at = lines[k][0]
            k += 1
            blanks = 0
            while k < len(lines):
                line = _expand(lines[k][1])
                if not line.strip():
                    blanks += 1
                    if blanks == 1 and len(inner) == 1 and not inner[0][1].strip():
                        break  # an item may begin with one blank line at most
                    inner.append((lines[k][0], ""))
                elif _indent(line) >= width:
                    inner.append((lines[k][0], line[width:]))
                    blanks = 0
                elif not blanks and not _ITEM.match(line) and not _opens_block(line) and _paragraph_open(BlockParser().parse(inner)):
                    inner.append((lines[k][0], line.lstrip()))
                else:
                    break
                k += 1
            item = Node("item", at, children=self.parse(inner))
            node.children.append(item)
        while k > 0 and not lines[k - 1][1].strip():  # blank lines after the list aren't its own
            k -= 1
        out.append(node)
        return k

    def _html(self, lines: list[tuple[int, str]], k: int, close: re.Pattern | None, out: list[Node]) -> int:
        node = Node("html", lines[k][0], lines[k][0])
        while k < len(lines):
            if close is None and not lines[k][1].strip():
                break
            node.lines.append(lines[k][1])
            node.last = lines[k][0]
            k += 1
            if close is not None and close.search(lines[k - 1][1]):
                break
        out.append(node)
        return k

    def _paragraph(self, lines: list[tuple[int, str]], k: int, out: list[Node]) -> int:
        node = Node("paragraph", lines[k][0], lines[k][0])
        while k < len(lines):
            line = _expand(lines[k][1])
            if node.lines:
                if (m := _SETEXT.match(line)) and _indent(line) < 4:
                    node.kind, node.level = "heading", 1 if m[1][0] == "=" else 2
                    k += 1
                    break
                if len(node.lines) == 1 and _DELIMITER_ROW.match(line) and ("|" in node.lines[0] or "|" in line) and len(_cells(line)) == len(_cells(node.lines[0])):
                    return self._table(lines, k, node, out)
                if _indent(line) < 4 and _opens_block(line) or not line.strip():
                    break
            elif n := self._definition(lines, k):
                return k + n
            node.lines.append(line.strip(" ") if not line.endswith("  ") else line.lstrip(" "))
            node.last = lines[k][0]
            k += 1
        out.append(node)
        return k

    def _definition(self, lines: list[tuple[int, str]], k: int) -> int:
        """How many lines a link definition takes from line k on, 0 if there is none; its label becomes known."""
        if not re.match(r" {0,3}\[", lines[k][1]):
            return 0
        end = k
        while end < len(lines) and lines[end][1].strip():
            end += 1
        text = "\n".join(t for _, t in lines[k:end])
        m = _DEFINITION.match(text) or _BARE_DEFINITION.match(text)
        if not m:
            return 0
        self.labels.add(" ".join(m[1].lower().split()))
        return m[0].count("\n") + (not m[0].endswith("\n"))

    def _table(self, lines: list[tuple[int, str]], k: int, head: Node, out: list[Node]) -> int:
        node = Node("table", head.at, head.first, head.first, rows=[_cells(head.lines[0])])
        for cell in _cells(lines[k][1]):
            node.align.append({(True, True): ":---:", (True, False): ":---", (False, True): "---:", (False, False): "---"}[cell.startswith(":"), cell.endswith(":")])
        width = len(node.align)
        k += 1
        while k < len(lines) and lines[k][1].strip() and not _opens_block(_expand(lines[k][1])):
            cells = _cells(lines[k][1])
            node.rows.append((cells + [""] * width)[:width])
            node.last = lines[k][0]
            k += 1
        out.append(node)
        return k


_INLINE = re.compile(
    rf"""(?P<code>`+)|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{{1,31}}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>)|(?P<html>{_TAG}|<!--(?:.|\n)*?-->|<\?(?:.|\n)*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[(?:.|\n)*?\]\]>)|(?P<escape>\\[!-/:-@\[-`{{-~])|(?P<open>!?\[)|(?P<close>\])|(?P<run>\*+|_+|~+)""",
    re.X,
)
#: The characters that any of these begins with.
_SPECIAL = re.compile(r"[`<\\!\[\]*_~]")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_LABEL = re.compile(r"\[([^\[\]]*)\]")


def inline(text: str, labels: set[str]) -> list[tuple[str, str]]:
    """(kind, visible text) pieces: text, image, html. Links give their text, images their alt, markup itself nothing."""
    out: list[list] = []  # kind, text, run facts
    opened: list[tuple[int, bool]] = []

    def put(kind: str, s: str, run=None) -> None:
        out.append([kind, s, run])

    k = near = 0
    while special := _SPECIAL.search(text, near):
        near = special.start()
        m = _INLINE.match(text, near)
        if not m:
            near += 1
            continue
        if near > k:
            put("text", text[k:near])
        k = m.end()
        if m["code"]:
            close = re.compile(rf"(?<!`){m['code']}(?!`)").search(text, k)
            if close:
                code = text[k : close.start()].replace("\n", " ")
                if code.startswith(" ") and code.endswith(" ") and code.strip():
                    code = code[1:-1]
                put("text", code)
                k = close.end()
            else:
                put("text", m["code"])
        elif m["auto"]:
            put("text", m["auto"][1:-1])
        elif m["html"]:
            put("html", m["html"])
        elif m["escape"]:
            put("text", m["escape"])
        elif m["open"]:
            opened.append((len(out), m["open"] == "![", m.end()))
            put("text", m["open"])
        elif m["close"]:
            if not opened:
                put("text", "]")
                near = k
                continue
            at, image, begin = opened.pop()
            inner = text[begin : m.start()]
            if t := _TARGET.match(text, k):
                k = t.end()
            elif (t := _LABEL.match(text, k)) and " ".join((t[1] or inner).lower().split()) in labels:
                k = t.end()
            elif " ".join(inner.lower().split()) not in labels:
                put("text", "]")
                near = k
                continue
            _emphasis(out, at + 1)
            if image:
                alt = "".join(p[1] for p in out[at + 1 :] if p[0] != "html")
                del out[at:]
                put("image", alt)
            else:
                del out[at]
        else:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            put("text", m["run"], _flank(m["run"], before, after))
        near = k
    if k < len(text):
        put("text", text[k:])
    _emphasis(out, 0)
    return [(kind, s) for kind, s, _ in out]


def _flank(run: str, before: str, after: str) -> tuple[bool, bool]:
    """(can open, can close) of a run of delimiters."""
    space = lambda c: not c or c.isspace()
    punct = lambda c: bool(c) and not c.isalnum() and not c.isspace()
    left = not space(after) and (not punct(after) or space(before) or punct(before))
    right = not space(before) and (not punct(before) or space(after) or punct(after))
    if run[0] == "_":
        return left and (not right or punct(before)), right and (not left or punct(after))
    if run[0] == "~" and len(run) > 2:
        return False, False
    return left, right


def _emphasis(out: list[list], start: int) -> None:
    """Removes the delimiters that pair up among out[start:]; the rest stay as text."""
    runs = [p for p in out[start:] if p[2]]
    stack: list[list] = []
    for r in runs:
        mark, (opens, closes) = r[1][:1], r[2]
        size = len(r[1])
        while closes and r[1]:
            for j in range(len(stack) - 1, -1, -1):
                o = stack[j]
                if o[1][:1] != mark or not o[1]:
                    continue
                if mark == "~" and len(o[1]) != len(r[1]):
                    continue
                both = (o[2][1] or r[2][0]) and (len(o[1]) + size) % 3 == 0 and not (len(o[1]) % 3 == 0 and size % 3 == 0)
                if mark in "*_" and both:
                    continue
                n = len(r[1]) if mark == "~" else 2 if len(o[1]) >= 2 and len(r[1]) >= 2 else 1
                o[1], r[1] = o[1][n:], r[1][n:]
                del stack[j + 1 :]
                if not o[1]:
                    stack.pop()
                break
            else:
                break
        if opens and r[1]:
            stack.append(r)
    for r in runs:
        r[2] = None


def _visible(lines: list[str], labels: set[str]) -> str:
    """The visible text of a paragraph's lines; a line that ends in two spaces or a backslash breaks like any other."""
    text = "\n".join(x.rstrip(" ") if k + 1 < len(lines) else x.rstrip() for k, x in enumerate(lines))
    text = re.sub(r"\\\n", "\n", text)
    return "".join(s for kind, s in inline(text, labels) if kind != "html")


_TASK = re.compile(r"\[[ xX]\][ \t]+")


def node_text(node: Node, labels: set[str]) -> str:
    if node.kind in ("code", "fenced"):
        return "".join(x + "\n" for x in node.lines)
    if node.kind == "html":
        return "\n".join(node.lines)
    parts: list[str] = []

    def fresh() -> None:
        if parts and not parts[-1].endswith("\n"):
            parts.append("\n")

    def walk(n: Node, task: bool = False) -> None:
        if n.kind in ("paragraph", "heading"):
            lines = [_TASK.sub("", n.lines[0], count=1), *n.lines[1:]] if task and n.lines and _TASK.match(n.lines[0]) else n.lines
            if text := _visible(lines, labels):
                parts.append(text)
            fresh()
        elif n.kind in ("code", "fenced"):
            if n.lines:
                fresh()
                parts.append("".join(x + "\n" for x in n.lines))
        elif n.kind == "table":
            for row in n.rows:
                parts.extend(_visible([c], labels) + "\t" for c in row)
                fresh()
        elif n.kind != "html":
            for k, c in enumerate(n.children):
                walk(c, n.kind == "item" and k == 0)
            if n.kind == "item":
                fresh()

    walk(node)
    return "".join(parts).strip("\n")


def collapse(text: str) -> str:
    return SPACES.sub(" ", text).strip(" ")


def _kind(node: Node, labels: set[str]) -> str:
    if node.kind == "paragraph":
        found = {kind for kind, s in inline("\n".join(node.lines), labels) if kind != "text" or s.strip()}
        return "image" if found == {"image"} else "raw_html" if found == {"html"} else "paragraph"
    return {"html": "raw_html", "fenced": "code"}.get(node.kind, node.kind)


def parse_blocks(text: str) -> list[dict]:
    """The document's blocks (schemas.BLOCK), one for each top-level node but headings, which set the heading path."""
    source = text.split("\n")
    if len(source) > 1 and source[-1] == "":
        source.pop()
    parser = BlockParser()
    nodes = parser.parse(list(enumerate(source, 1)))
    path: dict[int, str] = {}
    out: list[dict] = []
    for node in nodes:
        if node.kind == "heading":
            path = {k: v for k, v in path.items() if k < node.level}
            path[node.level] = collapse(_visible(node.lines, parser.labels))
            continue
        first, last = node.span()
        if not first:
            first = last = node.at
        if node.kind == "fenced":
            first = node.at
            last = first + len(node.lines)
            if last < len(source):
                last += 1  # the closing fence
        out.append(
            {
                "ordinal": len(out),
                "type": _kind(node, parser.labels),
                "heading_path": [path[k] for k in sorted(path) if path[k]],
                "raw_content": "\n".join(source[first - 1 : last]),
                "content": node_text(node, parser.labels),
                "start_line": first,
                "end_line": last,
            }
        )
    return out


def keep_indexable(blocks: list[dict]) -> list[dict]:
    """Without raw HTML, rules and blank blocks; ordinals stay."""
    return [b for b in blocks if b["type"] not in ("raw_html", "thematic_break") and b["content"].strip(WHITE)]


def _fence(code: str) -> str:
    return "`" * max(3, 1 + max((len(x) for x in re.findall("`+", code)), default=0))


def _code(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text[:-1] if text.endswith("\n") else text


def _list_lines(node: Node, labels: set[str], indent: str = "") -> list[str]:
    out: list[str] = []
    for n, item in enumerate(node.children):
        marker = f"{node.level + n}." if node.ordered else "-"
        deeper = indent + " " * (len(marker) + 1)
        own: list[str] = []
        first_is_list = None
        for k, c in enumerate(item.children):
            if c.kind in ("html", "thematic_break"):
                continue
            if c.kind == "list":
                lines = _list_lines(c, labels, deeper)
                first_is_list = first_is_list if own else True
            elif c.kind in ("code", "fenced"):
                code = _code(node_text(c, labels))
                fence = _fence(code)
                lines = [deeper + x for x in [fence + c.info, *(code.split("\n") if code else []), fence]]
            else:
                shown = Node("item", c.at, children=[c]) if k == 0 else c
                value = collapse(node_text(shown, labels))
                lines = [deeper + value] if value else []
            own += lines
        if not own or first_is_list:
            out += [indent + marker, *own]
        else:
            out += [f"{indent}{marker} {own[0][len(deeper) :]}", *own[1:]]
    return out


def normalize(block: dict) -> dict:
    """The block with its canonical content; the input isn't changed."""
    kind, raw = block["type"], block["raw_content"] if "raw_content" in block else ""
    out = block | {"heading_path": [collapse(h) for h in block["heading_path"]]}
    if kind == "code":
        out["content"] = _code(block["content"])
    elif kind in ("table", "list", "quote"):
        parser = BlockParser()
        nodes = parser.parse(list(enumerate(raw.split("\n"), 1)))
        node = next((n for n in nodes if n.kind == kind), None)
        if node is None:
            out["content"] = collapse(raw)
        elif kind == "table":
            rows = [[collapse(_visible([c], parser.labels)).replace("|", "\\|") for c in row] for row in node.rows]
            out["content"] = "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], node.align, *rows[1:]])
        elif kind == "list":
            out["content"] = "\n".join(_list_lines(node, parser.labels))
        else:
            parts = [_code(node_text(c, parser.labels)) if c.kind in ("code", "fenced") else collapse(node_text(c, parser.labels)) for c in node.children if c.kind not in ("html", "thematic_break")]
            out["content"] = "\n".join(p for p in parts if p)
    else:
        out["content"] = collapse(block["content"])
    return out
