"""Markdown in the GitHub dialect to the same tree: CommonMark blocks and spans, tables, task lists, strikethrough, bare links."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.entities import html5

from .strings import is_word, slug
from .tree import Node, el, txt

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_HR = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|([0-9]{1,9})[.)])(?=[ \t]|$)")
_TASK = re.compile(r"\[([ xX])\](?=[ \t])[ \t]")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r""" {0,3}\[((?:\\.|[^\[\]\\])+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))(?:(?:[ \t]+|[ \t]*\n[ \t]*)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|$)""")
# Elements that open an HTML block, from the CommonMark specification.
_BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
_TAG = r"""<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"""
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}{_TAG}\s*$"), None),
]
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,47});")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_SPECIAL = re.compile(r"[\\`*_~\[\]!<&\n]|https?://|www\.|(?<=\S)@")
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_INLINE_HTML = re.compile(rf"{_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]+")
_MAIL_NAME = re.compile(r"[\w.+-]+$")
_MAIL_HOST = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_FENCE_END = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*$")
#: Fixed value: containers inside each other, at most; what is deeper is text.
_DEPTH = 128


def _unescape(s: str) -> str:
    return _ESCAPE.sub(r"\1", s)


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def entity(s: str) -> str:
    """The character of a reference; an unknown name as it is."""
    if s[1] == "#":
        n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"
    return html5.get(s[1:], s)


@dataclass(slots=True, eq=False)
class _Block:
    """An open block. start, end: its first and last line, by which blank lines between blocks are seen."""

    kind: str  # doc, quote, list, item; p, h, hr, code, fence, html, table; gone: a paragraph of definitions only
    start: int
    end: int
    kids: list[_Block] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    offset: int = 0  # columns that an item's lines are indented by, or a fence was
    mark: str = ""  # a list's delimiter, a fence, the mark of a task
    number: int | None = None  # a list's first number, a heading's level, an HTML block's kind


def _indent(s: str, col: int) -> int:
    """Columns of white space at the start of s, which begins in column col: a tab goes to the next multiple of four."""
    if s[:1] not in (" ", "\t"):
        return 0
    at = len(s) - len(s.lstrip(" "))
    if s[at : at + 1] != "\t":
        return at
    at = col
    for c in s:
        if c == " ":
            at += 1
        elif c == "\t":
            at += 4 - at % 4
        else:
            break
    return at - col


def _strip(s: str, col: int, columns: int) -> tuple[str, int]:
    """s without so many columns of white space, or all it has; of a tab that is wider the rest stays, as blanks."""
    if s[:columns] == " " * columns:
        return s[columns:], col + columns
    k, at, to = 0, col, col + columns
    while at < to and k < len(s) and s[k] in " \t":
        at += 1 if s[k] == " " else 4 - at % 4
        k += 1
    return (" " * (at - to) + s[k:], to) if at > to else (s[k:], at)


class _Parser:
    """Blocks line by line: a line is first matched by the open containers, from the outermost in; what is left of it may
    open new ones, continue the paragraph that is open (even where containers don't match, lazily), or close what didn't match."""

    def __init__(self):
        self.definitions: dict[str, tuple[str, str | None]] = {}
        self.headings: list[Node] = []

    def blocks(self, lines: list[str]) -> list[tuple]:
        self.open = [_Block("doc", 0, 0)]
        for n, line in enumerate(lines):
            self.line(n, line)
        self.shut(1)
        return [_plain(b) for b in self.open[0].kids if b.kind != "gone"]

    def shut(self, to: int) -> None:
        """Close the open blocks from the innermost out until ``to`` are left."""
        while len(self.open) > to:
            b = self.open.pop()
            if b.kind == "p":
                self.define(b)
            elif b.kind == "code":
                while b.lines and not b.lines[-1].strip():
                    b.lines.pop()
            above = self.open[-1]
            above.end = max(above.end, b.end)

    def define(self, p: _Block) -> None:
        """Take the definitions off a paragraph's start."""
        last = len(p.lines) - 1
        text = "\n".join(x.strip(" \t") if k == last else x.lstrip(" \t") for k, x in enumerate(p.lines))
        while m := _DEFINITION.match(text):
            title = m[4][1:-1] if m[4] else None
            self.definitions.setdefault(_label(m[1]), (_unescape(m[2] if m[2] is not None else m[3]), title and _unescape(title)))
            text = text[m.end() :]
        p.lines = [text] if text.strip() else []
        if not p.lines:
            p.kind = "gone"

    def add(self, kind: str, n: int, **fields) -> _Block:
        b = _Block(kind, n, n, **fields)
        above = self.open[-1]
        above.kids.append(b)
        above.end = max(above.end, n)
        self.open.append(b)
        return b

    # --- one line -----------------------------------------------------------------

    def line(self, n: int, s: str) -> None:
        col, depth, fresh = 0, 1, False
        for b in self.open[1:]:
            got = self.goes_on(b, n, s, col)
            if got == "end":  # a fence that closes
                return
            if got is None:
                break
            s, col = got
            depth += 1
        tip = self.open[-1]
        if depth == len(self.open) and tip.kind in ("fence", "html", "table", "code"):
            self.take(tip, n, s)
            return
        while (got := self.opens(n, s, col, depth)) is not None:
            if got == "done":
                return
            s, col = got
            depth, fresh = len(self.open), True
        tip = self.open[-1]
        if tip.kind == "p" and s.strip() and not fresh:
            tip.lines.append(s)
            tip.end = n
            return
        self.shut(depth)
        if s.strip():
            self.leave_list()
            self.add("p", n, lines=[s])

    def goes_on(self, b: _Block, n: int, s: str, col: int):
        """What is left of the line if the block continues on it; None if not."""
        if b.kind == "list":
            return s, col
        blank = not s.strip()
        if b.kind == "p":
            return None if blank else (s, col)
        wide = _indent(s, col)
        if b.kind == "quote":
            if wide > 3 or s.lstrip(" \t")[:1] != ">":
                return None
            b.end = n
            s, col = _strip(s, col, wide)
            return _strip(s[1:], col + 1, 1)
        if b.kind == "item":
            if blank:
                return ("", col) if b.kids else None
            return _strip(s, col, b.offset) if wide >= b.offset else None
        if b.kind == "fence":
            m = _FENCE_END.match(" " * wide + s.lstrip(" \t"))
            if m and m[1][0] == b.mark[0] and len(m[1]) >= len(b.mark):
                b.end = n
                self.shut(self.open.index(b))
                return "end"
            return _strip(s, col, b.offset)
        if b.kind == "code":
            return _strip(s, col, 4) if wide >= 4 or blank else None
        if b.kind == "html":
            return None if blank and _HTML[b.number][1] is None else (s, col)
        if b.kind == "table":
            return None if blank or self.interrupts(s, col) else (s, col)
        return s, col

    def take(self, b: _Block, n: int, s: str) -> None:
        """A line of a block of lines."""
        b.lines.append(s)
        if s.strip() or b.kind == "fence":
            b.end = n
        if b.kind == "html" and (stop := _HTML[b.number][1]) and stop.search(s):
            self.shut(self.open.index(b))

    def interrupts(self, s: str, col: int) -> bool:
        """Whether the line would end a paragraph."""
        wide = _indent(s, col)
        x = " " * wide + s.lstrip(" \t")
        m = _ITEM.match(x)
        return wide < 4 and bool(_HR.match(x) or _ATX.match(x) or _FENCE.match(x) or x.lstrip()[:1] == ">" or (m and x[m.end() :].strip() and m[3] in (None, "1")) or _html_kind(x, True) is not None)

    def opens(self, n: int, s: str, col: int, depth: int):
        """Open the block that the rest of the line starts: what is left of the line, ``done`` if nothing, None if no block starts."""
        wide = _indent(s, col)
        bare = s.lstrip(" \t")
        p = self.open[depth - 1] if self.open[depth - 1].kind == "p" else None
        if not bare:
            return None
        if wide >= 4:
            if self.open[-1].kind == "p":  # it continues a paragraph, lazily if need be
                return None
            self.shut(depth)
            self.leave_list()
            self.add("code", n, lines=[_strip(s, col, 4)[0]])
            return "done"
        if bare[0].isalpha():  # no block starts with a letter
            return None
        x = " " * wide + bare
        room = len(self.open) < _DEPTH

        def base() -> None:
            """Close what didn't match, and a paragraph that did: what comes stands beside it."""
            self.shut(depth - 1 if p else depth)

        if bare[0] == ">" and room:
            base()
            self.leave_list()
            self.add("quote", n)
            return _strip(bare[1:], col + wide + 1, 1)
        if bare[0] == "#" and (m := _ATX.match(x)):
            base()
            self.leave_list()
            body = (m[2] or "").strip()
            self.add("h", n, lines=["" if body.strip("#") == "" else body], number=len(m[1]))
        elif bare[0] in "`~" and (m := _FENCE.match(x)):
            base()
            self.leave_list()
            self.add("fence", n, offset=len(m[1]), mark=m[2], lines=[m[3]])
            return "done"
        elif (kind := _html_kind(x, self.open[-1].kind == "p")) is not None:
            base()
            self.leave_list()
            self.take(self.add("html", n, number=kind), n, s)
            return "done"
        elif p and (m := _SETEXT.match(x)) and self.heading(p, n, 1 if m[1][0] == "=" else 2):
            return "done"
        else:
            if p and p.kind == "gone":
                depth, p = depth - 1, None
            if bare[0] in "-*_" and _HR.match(x):
                base()
                self.leave_list()
                self.add("hr", n)
            elif (m := _ITEM.match(x)) and room and not (p and (not x[m.end() :].strip() or m[3] not in (None, "1"))):
                base()
                mark, after, at = m[2][-1], bare[len(m[2]) :], col + wide + len(m[2])
                if self.open[-1].kind != "list" or self.open[-1].mark != mark:
                    self.leave_list()
                    self.add("list", n, mark=mark, number=int(m[3]) if m[3] else None)
                gap = _indent(after, at)
                pad = gap if 1 <= gap <= 4 and after.strip() else 1
                item = self.add("item", n, offset=wide + len(m[2]) + pad)
                s, col = _strip(after, at, pad)
                if task := _TASK.match(s):
                    item.mark = task[1]
                    s, col = s[task.end() :], col + task.end()
                return s, col
            elif p and "|" in bare and _TABLE.match(x) and "|" in p.lines[-1] and len(_cells(p.lines[-1])) == len(_cells(bare)):
                head = p.lines.pop()
                if p.lines:
                    p.end -= 1
                    self.shut(depth - 1)
                else:
                    self.open.pop()
                    self.open[-1].kids.pop()
                self.add("table", n, lines=[head, s]).start = n - 1
                return "done"
            else:
                return None
        self.shut(len(self.open) - 1)
        return "done"

    def leave_list(self) -> None:
        if self.open[-1].kind == "list":
            self.shut(len(self.open) - 1)

    def heading(self, p: _Block, n: int, level: int) -> bool:
        """Make the open paragraph a heading, unless it holds definitions only."""
        self.define(p)
        if p.kind == "gone":
            self.open.pop()
            p.end = n - 1
            return False
        p.kind, p.number, p.end = "h", level, n
        p.lines = [p.lines[0].strip()]
        self.shut(len(self.open) - 1)
        return True

    # --- nodes ----------------------------------------------------------------------

    def fill(self, parent: Node, blocks: list[tuple], loose: bool, tight: bool = False) -> None:
        """Append blocks: newlines between them, and all around them in a loose parent."""
        count = 0
        for b in blocks:
            if b[0] == "p" and tight:
                parent.add(*self.inline(b[1]))
                continue
            if count or loose:
                parent.add(txt("\n"))
            parent.add(self.node(b))
            count += 1
        if loose and count:
            parent.add(txt("\n"))

    def node(self, b: tuple) -> Node:
        match b:
            case ("p", text):
                return el("p", {}, *self.inline(text))
            case ("h", level, text):
                self.headings.append(h := el(f"h{level}", {}, *self.inline(text)))
                return h
            case ("hr",):
                return el("hr")
            case ("html", text):
                return Node("raw", value=text)
            case ("code", language, text):
                code = el("code", {"className": ["language-" + language.encode()[:118].decode(errors="ignore")]} if language else {})
                return el("pre", {}, code.add(*([txt(text)] if text else [])))
            case ("quote", inner):
                q = el("blockquote")
                self.fill(q, inner, True)
                return q
            case ("table", lines):
                return self.table(lines)
        _, start, loose, items = b
        node = el("ul" if start is None else "ol", {"start": float(start)} if start not in (None, 1) else {})
        for task, inner in items:
            li = el("li")
            if task is not None:
                li.add_class("task-list-item")
                if "className" not in node.props:
                    node.add_class("contains-task-list")
                li.add(el("input", {"type": "checkbox"} | ({} if task == " " else {"checked": True}) | {"disabled": True}), txt(" "))
            self.fill(li, inner, loose, not loose)
            li.children = _joined(li.children)
            node.add(txt("\n"), li)
        return node.add(txt("\n"))

    def table(self, lines: list[str]) -> Node:
        aligns = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c[0] == ":", c[-1] == ":")) for c in _cells(lines[1])]

        def row(line: str, tag: str) -> Node:
            cells = (_cells(line) + [""] * len(aligns))[: len(aligns)]
            tr = el("tr")
            for c, a in zip(cells, aligns):
                tr.add(txt("\n"), el(tag, {"align": a} if a else {}, *self.inline(c.replace("\\|", "|"))))
            return tr.add(txt("\n"))

        table = el("table", {}, txt("\n"), el("thead", {}, txt("\n"), row(lines[0], "th"), txt("\n")), txt("\n"))
        if len(lines) > 2:
            body = el("tbody")
            for x in lines[2:]:
                body.add(txt("\n"), row(x, "td"))
            table.add(body.add(txt("\n")), txt("\n"))
        return table

    def inline(self, text: str) -> list[Node]:
        return _Spans(self, text).nodes()


def _html_kind(x: str, in_paragraph: bool) -> int | None:
    if not x.lstrip(" ").startswith("<"):
        return None
    return next((k for k, (start, _) in enumerate(_HTML) if start.match(x) and not (k == 6 and in_paragraph)), None)


def _plain(b: _Block) -> tuple:
    """A closed block as (kind, ...)."""
    kids = lambda b: [_plain(k) for k in b.kids if k.kind != "gone"]
    match b.kind:
        case "p" | "h":
            return ("p", b.lines[0]) if b.kind == "p" else ("h", b.number, b.lines[0])
        case "hr":
            return ("hr",)
        case "html":
            return ("html", "".join(x + "\n" for x in b.lines))
        case "code":
            return ("code", "", "".join(x + "\n" for x in b.lines))
        case "fence":
            info = b.lines[0].split()
            return ("code", _unescape(info[0]) if info else "", "".join(x + "\n" for x in b.lines[1:]))
        case "table":
            return ("table", b.lines)
        case "quote":
            return ("quote", kids(b))
    parted = lambda blocks: any(y.start - x.end > 1 for x, y in zip(blocks, blocks[1:]))
    loose = parted(b.kids) or any(parted(item.kids) for item in b.kids)
    return ("list", b.number, loose, [(item.mark or None, kids(item)) for item in b.kids])


def _cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|")
    if inner.endswith("|") and not inner.endswith("\\|"):
        inner = inner[:-1]
    return [c.strip() for c in re.split(r"(?<!\\)\|", inner)]


def _joined(nodes: list[Node]) -> list[Node]:
    """Adjacent text as one node."""
    out: list[Node] = []
    for n in nodes:
        if n.type == "text" and n.value != "\n" and out and out[-1].type == "text" and out[-1].value != "\n":
            out[-1] = txt(out[-1].value + n.value)
        elif n.type != "text" or n.value:
            out.append(n)
    return out


@dataclass
class _Mark:
    """A run of * _ or ~ that may open or close emphasis, or a bracket that may start a link."""

    node: Node
    char: str
    count: int = 0
    opens: bool = False
    closes: bool = False
    active: bool = True
    size: int = 0
    at: int = 0
    items: list = field(default_factory=list)


class _Spans:
    def __init__(self, parser: _Parser, text: str):
        self.p, self.text = parser, text
        self.out: list = []  # nodes, and marks that are not settled yet
        self.marked = False  # whether there was any mark

    def nodes(self) -> list[Node]:
        text, i = self.text, 0
        while i < len(text):
            m = _SPECIAL.search(text, i)
            if not m:
                self.say(text[i:])
                break
            self.say(text[i : m.start()])
            i = self.step(m.start(), m[0])
        return _joined(self.settled(0))

    def say(self, s: str) -> None:
        if s:
            self.out.append(txt(s.replace("\0", "\ufffd")))

    def step(self, i: int, what: str) -> int:
        text, c = self.text, what[0]
        if what[-1] in "/." and len(what) > 1 or c == "@":
            return self.bare(i, c)
        if c == "\\":
            if text[i + 1 : i + 2] == "\n":
                self.out.append(el("br"))
                return self._skip(i + 2)
            m = _ESCAPE.match(text, i)
            self.say(m[1] if m else "\\")
            return m.end() if m else i + 1
        if c == "`":
            return self.code(i)
        if c == "\n":
            last = self.out[-1] if self.out else None
            if isinstance(last, Node) and last.type == "text":
                hard = last.value.endswith("  ")
                last.value = last.value.rstrip(" ")
                self.out.append(el("br") if hard else txt("\n"))
            else:
                self.say("\n")
            return self._skip(i + 1)
        if c == "&":
            m = _ENTITY.match(text, i)
            self.say(entity(m[0]) if m else "&")
            return m.end() if m else i + 1
        if c == "<":
            if m := _ANGLE.match(text, i):
                said = m[1] or m[2]
                self.out.append(el("a", {"href": said if m[1] else "mailto:" + said}, txt(said)))
                return m.end()
            m = _INLINE_HTML.match(text, i)
            self.say(m[0] if m else "<")
            return m.end() if m else i + 1
        if c in "*_~":
            return self.run(i, c)
        if c == "!" and text[i + 1 : i + 2] != "[":
            self.say("!")
            return i + 1
        if c in "![":
            size = 2 if c == "!" else 1
            self.marked = True
            self.out.append(_Mark(txt(text[i : i + size]), c, at=i + size))
            return i + size
        return self.close_bracket(i)

    def _skip(self, i: int) -> int:
        while self.text[i : i + 1] == " ":
            i += 1
        return i

    def code(self, i: int) -> int:
        run = re.compile("`+").match(self.text, i)[0]
        m = re.compile(rf"(?<!`){run}(?!`)").search(self.text, i + len(run))
        if not m:
            self.say(run)
            return i + len(run)
        body = self.text[i + len(run) : m.start()].replace("\n", " ")
        if body.strip(" ") and body[0] == body[-1] == " ":
            body = body[1:-1]
        self.out.append(el("code", {}, txt(body)))
        return m.end()

    def bare(self, i: int, c: str) -> int:
        text = self.text
        if c == "@":
            last = self.out[-1] if self.out else None
            name = _MAIL_NAME.search(last.value) if isinstance(last, Node) and last.type == "text" else None
            host = _MAIL_HOST.match(text, i)
            if not name or not host or host[0][-1] in "-_":
                self.say("@")
                return i + 1
            last.value = last.value[: name.start()]
            said = name[0] + host[0]
            self.out.append(el("a", {"href": "mailto:" + said}, txt(said)))
            return host.end()
        m = _BARE.match(text, i)
        before = text[i - 1] if i else " "
        if not m or is_word(before) or "." not in m[0]:
            self.say(text[i])
            return i + 1
        said = m[0]
        while said:
            if said[-1] in "?!.,:*_~'\"" or (said[-1] == ")" and said.count(")") > said.count("(")):
                said = said[:-1]
            elif tail := re.search(r"&[A-Za-z0-9]+;$", said):
                said = said[: tail.start()]
            else:
                break
        self.out.append(el("a", {"href": said if said[0] == "h" else "http://" + said}, txt(said)))
        return i + len(said)

    def run(self, i: int, c: str) -> int:
        text, end = self.text, i
        while text[end : end + 1] == c:
            end += 1
        before, after = text[i - 1 : i] or " ", text[end : end + 1] or " "
        punct = lambda x: not x.isspace() and not is_word(x)
        left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        opens, closes = left, right
        if c == "_":
            opens, closes = left and (not right or punct(before)), right and (not left or punct(after))
        if c == "~" and end - i > 2:
            opens = closes = False
        self.marked = True
        self.out.append(_Mark(txt(text[i:end]), c, end - i, opens, closes, size=end - i))
        return end

    def close_bracket(self, i: int) -> int:
        at = next((k for k in range(len(self.out) - 1, -1, -1) if isinstance(self.out[k], _Mark) and self.out[k].char in "![" and self.out[k].node), None)
        if at is None:
            self.say("]")
            return i + 1
        mark = self.out[at]
        target = self.target(i + 1, self.text[mark.at : i]) if mark.active else None
        if not target:
            self.out[at] = mark.node
            self.say("]")
            return i + 1
        href, title, end = target
        inner = _joined(self.settled(at + 1))
        image = mark.char == "!"
        node = el("img" if image else "a")
        if href:
            node.props["src" if image else "href"] = href
        if title:
            node.props["title"] = title
        if image:
            node.children = [el(n.tag) for n in inner if n.type == "element"]
            node.props["alt"] = "".join(n.props.get("alt", "") if n.tag == "img" else n.text() for n in inner)
        else:
            node.children = inner
            for x in self.out[:at]:
                if isinstance(x, _Mark) and x.char == "[":
                    x.active = False
        self.out[at:] = [node]
        return end

    def target(self, i: int, label: str) -> tuple[str, str | None, int] | None:
        """(href, title, end) of what follows a closing bracket."""
        text = self.text
        if text[i : i + 1] == "(":
            m = re.compile(r"""\(\s*(?:<((?:\\.|[^<>\n\\])*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\]|\([^\s()]*\))*\))*))(?:\s+("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)""").match(text, i)
            if m:
                return _unescape(m[1] if m[1] is not None else m[2]), _unescape(m[3][1:-1]) if m[3] else None, m.end()
        m = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(text, i)
        name, end = (m[1] if m and m[1].strip() else label), (m.end() if m else i)
        found = self.p.definitions.get(_label(name))
        return (*found, end) if found else None

    def settled(self, start: int) -> list[Node]:
        """Nodes from start on, with emphasis resolved and what is left of marks as text."""
        items = self.out[start:]
        del self.out[start:]
        i = 0 if self.marked else len(items)
        while i < len(items):
            c = items[i]
            if isinstance(c, _Mark) and c.char in "*_~" and c.closes and c.count:
                k = next((k for k in range(i - 1, -1, -1) if self._pairs(items[k], c)), None)
                if k is not None:
                    o = items[k]
                    n = min(2, o.count, c.count) if c.char != "~" else c.count
                    tag = "del" if c.char == "~" else "strong" if n == 2 else "em"
                    inner = [x.node if isinstance(x, _Mark) else x for x in items[k + 1 : i]]
                    node = el(tag, {}, *_joined([x for x in inner if x.type != "text" or x.value]))
                    o.count -= n
                    c.count -= n
                    o.node, c.node = txt(o.char * o.count), txt(c.char * c.count)
                    items[k + 1 : i] = [node]
                    i = k + 2
                    if c.count:
                        continue
                    i += 1
                    continue
            i += 1
        return [n for n in (x.node if isinstance(x, _Mark) else x for x in items) if n.type != "text" or n.value]

    @staticmethod
    def _pairs(o, c: _Mark) -> bool:
        if not isinstance(o, _Mark) or o.char != c.char or not o.opens or not o.count:
            return False
        if c.char == "~":
            return o.count == c.count
        return not ((o.closes or c.opens) and (o.size + c.size) % 3 == 0 and (o.size % 3 or c.size % 3))


def parse_markdown(text: str | None) -> Node:
    p = _Parser()
    root = Node("root")
    blocks = p.blocks((text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    p.fill(root, blocks, False)
    for n in p.headings:
        name = slug(n.text().encode()[:1024].decode(errors="ignore"))
        if name:
            n.props["id"] = name
    return root
