"""Block structure: lines in, a tree with references, footnotes, messages and front matter out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

from . import vocab
from .inline import parse_inline, protocol_allowed
from .strings import JS_SPACE, is_page, normal_link, slug, utf16_length
from .tree import Node, el, txt


@dataclass(frozen=True)
class Options:
    documents: bool = False
    frontmatter: bool = True
    frontmatter_fence: str = "+++"
    document_wrapper: str = "article"
    autolink: bool = True
    sanitize: bool = True
    max_heading: int = 6
    line_offset: int = 0
    shortcodes: Mapping[str, str] = field(default_factory=dict)  # more of them, name to picture; they go before the built-in ones


@dataclass(slots=True)
class Line:
    text: str  # without its indentation
    indent: int  # in columns, tabs to the next fourth
    number: int
    units: int  # UTF-16 length of the whole line

    @property
    def blank(self) -> bool:
        return not self.text


@dataclass(slots=True)
class Message:
    rule: str
    reason: str
    pos: tuple[int, int, int, int] | None = None


@dataclass(slots=True)
class Note:
    id: str
    content: str
    number: int = 0
    refs: int = 0


_HR = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r"(?:(=+)|-{4,})[ \t]*$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})(.*)$", re.S)
_MARKER = re.compile(r"(?:[-*+]|([0-9]+)[.)])(?:[ \t]|$)")
_TASK = re.compile(r"\[([ xX])\](?:[ \t]+(.*)|)$", re.S)
_DOCTYPE = re.compile(r"<!doctype(?![A-Za-z0-9_])[^>]*>?[ \t]*$", re.I)
_DEFINITION = re.compile(r"\[\[[ \t]*\^([^ \t\]]+)[ \t]*\]\]:(.*)$", re.S)
_ANY_DEFINITION = re.compile(r"\[\[[ \t]*\^")
_TAG = re.compile(r"<[ \t]*([A-Za-z][A-Za-z0-9-]*)?")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][A-Za-z0-9._:-]*)(?:[ \t]*=[ \t]*(?:"([^"]*)"?|'([^']*)'?|([^ \t>]*)))?""")
_COMMENT = re.compile(r"#(?:[ \t]|$)")
_SEPARATOR = re.compile(r"---[ \t]*$")
_COLUMN = re.compile(r":?-+:?$")
CELLS = 64
MOST = 2**63 - 1  # a list starts at most here


def split_lines(text: str, offset: int = 0) -> list[Line]:
    out = []
    for i, raw in enumerate(text.split("\n")):
        raw = raw.removesuffix("\r")
        body = raw.lstrip(" \t")
        lead = raw[: len(raw) - len(body)]
        tabs = "\t" in lead
        indent = 0 if tabs else len(lead)
        for c in lead if tabs else "":
            indent += 4 - indent % 4 if c == "\t" else 1
        out.append(Line(body, indent, i + 1 + offset, utf16_length(raw)))
    return out


def fence_of(line: Line) -> tuple[str, str] | None:
    """(marks, info) of a line that opens fenced code."""
    m = _FENCE.match(line.text)
    return (m[1], m[2].strip(JS_SPACE)) if m else None


def closes(line: Line, marks: str) -> bool:
    t = line.text.rstrip(JS_SPACE)
    return len(t) >= len(marks) and not t.strip(marks[0])


def split_cells(text: str) -> list[str]:
    inner = text.strip(" \t")
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner.rstrip(" \t")
    inner = inner[:-1] if inner.endswith("|") else inner
    return [c.strip(JS_SPACE) for c in re.split(r"(?<!\\)\|", inner)[:CELLS]]


class Document:
    """One source while it is parsed, and all that it gives."""

    def __init__(self, text: str, options: Options = Options()):
        self.options = options
        self.root = Node("root")
        self.messages: list[Message] = []
        self.references: list[tuple[int, str, str]] = []
        self.matters: list[tuple[str | None, int, int]] = []
        self.footnotes: list[tuple[int, Note]] = []
        self.notes: dict[str, Note] = {}
        self.heading_slugs: dict[str, int] = {}
        self.in_order: list[Note] = []  # as they are referred to
        self.index = self.numbered = 0
        self._seen: set[tuple[int, str, str]] = set()
        lines = split_lines(text, options.line_offset)
        if not options.documents:
            self._document(lines, self.root)
            return
        section: list[Line] = []
        for line in [*lines, None]:
            if line is not None and not (line.indent == 0 and _SEPARATOR.match(line.text)):
                section.append(line)
                continue
            if any(not x.blank for x in section):
                parent = el(options.document_wrapper) if options.document_wrapper else self.root
                self._document(section, parent)
                if parent is not self.root:
                    self.root.add(parent)
                self.index += 1
            section = []

    def _document(self, lines: list[Line], parent: Node) -> None:
        """Front matter, then comments, then footnote definitions, then blocks: the order shows."""
        self.notes, self.numbered, self.in_order = {}, 0, []
        lines = without_comments(self._front_matter(lines))
        self._collect_definitions(lines)
        self.blocks(parent, lines, 0)
        self._footnote_section(parent)
        self.footnotes += [(self.index, n) for n in self.notes.values()]

    # --- what is written down ----------------------------------------------------

    def collect(self, kind: str, name: str) -> None:
        key = (self.index, kind, name)
        if key not in self._seen:
            self._seen.add(key)
            self.references.append(key)

    def warn(self, rule: str, reason: str, line: Line | None = None) -> None:
        self.messages.append(Message(rule, reason, place(line, line) if line else None))

    def _front_matter(self, lines: list[Line]) -> list[Line]:
        fence = re.compile(re.escape(self.options.frontmatter_fence) + r"[ \t]*$")
        hits = [i for i, x in enumerate(lines) if x.indent == 0 and fence.match(x.text)] if self.options.frontmatter else []
        if len(hits) < 2 or any(not x.blank for x in lines[: hits[0]]):
            self.matters.append((None, 0, 0))
            return lines
        a, b = hits[:2]
        inner = [" " * x.indent + x.text for x in lines[a + 1 : b]]
        while inner and not inner[0]:  # leading empty lines aren't rejoined
            inner.pop(0)
        self.matters.append(("\n".join(inner), lines[a].number, lines[b].number))
        return lines[b + 1 :]

    # --- footnotes -----------------------------------------------------------------

    @property
    def _prefix(self) -> str:
        return f"user-content-{self.index}-" if self.index else "user-content-"

    def _collect_definitions(self, lines: list[Line]) -> None:
        i = 0
        while i < len(lines):
            m = _DEFINITION.match(lines[i].text)
            if not m or len(lines[i].text.encode()) < 8:
                i += 1
                continue
            end = i + 1
            while end < len(lines) and not lines[end].blank and not _ANY_DEFINITION.match(lines[end].text):
                end += 1
            parts = [p for p in (m[2].strip(JS_SPACE), *(x.text for x in lines[i + 1 : end])) if p]
            content = " ".join(parts).strip(JS_SPACE)
            if m[1] in self.notes:
                self.notes[m[1]].content = content  # the last definition of an id holds, at the first one's place
            else:
                self.notes[m[1]] = Note(m[1], content)
            for k in range(i, end):
                lines[k] = replace(lines[k], text="")
            i = end

    def footnote_reference(self, name: str) -> Node | None:
        note = self.notes.get(name)
        if not note:
            return None
        if not note.number:
            self.numbered += 1
            note.number = self.numbered
            self.in_order.append(note)
        note.refs += 1
        again = f"-{note.refs}" if note.refs > 1 else ""
        props = {"href": f"#{self._prefix}fn-{note.id}", "id": f"{self._prefix}fnref-{note.id}{again}", "dataFootnoteRef": True, "ariaDescribedBy": "footnote-label"}
        return el("sup", {}, el("a", props, txt(str(note.number))))

    def _footnote_section(self, parent: Node) -> None:
        if not self.numbered:
            return
        items = el("ol", {}, txt("\n"))
        for note in self.in_order:  # grows while it is read: a note's text may refer to further notes
            p = el("p", {}, *parse_inline(self, note.content))
            for k in range(1, note.refs + 1):
                props = {"href": f"#{self._prefix}fnref-{note.id}" + (f"-{k}" if k > 1 else ""), "dataFootnoteBackref": True, "ariaLabel": "Back to content", "className": ["data-footnote-backref"]}
                back = el("a", props, txt("↩"))
                if note.refs > 1:
                    back.add(el("sup", {}, txt(str(k))))
                p.add(txt(" "), back)
            items.add(el("li", {"id": f"{self._prefix}fn-{note.id}"}, txt("\n"), p, txt("\n")), txt("\n"))
        title = el("h2", {"className": ["sr-only"], "id": "footnote-label"}, txt("Footnotes"))
        section = el("section", {"dataFootnotes": True, "className": ["footnotes"]}, txt("\n"), title, txt("\n"), items, txt("\n"))
        inside = parent.type == "element"
        if inside and not (parent.children and parent.children[-1].type == "text" and parent.children[-1].value == "\n"):
            parent.add(txt("\n"))
        parent.add(section)
        if inside:
            parent.add(txt("\n"))

    # --- blocks ----------------------------------------------------------------------

    def blocks(self, parent: Node, lines: list[Line], base: int) -> None:
        """Parse a run of lines into parent. A stack holds the runs that are open, so depth is no matter."""
        stack = [self._run(parent, lines, base)]
        while stack:
            inner = next(stack[-1], None)
            if inner is None:
                stack.pop()
            else:
                stack.append(self._run(*inner))

    def _run(self, parent: Node, lines: list[Line], base: int) -> Iterator[tuple[Node, list[Line], int]]:
        """Yields each run (parent, lines, base) inside, to be parsed before this one goes on.

        Children of an element, not of the root, have newlines around them.
        """
        apart = parent.type == "element"
        # rules that may hold further runs are generators
        rules = ((self._indented, True), (self._rule, False), (self._heading, False), (self._fenced, False), (self._element, True), (self._table, False), (self._list, True), (self._paragraph, False))
        i, produced = 0, False
        while i < len(lines):
            if lines[i].blank:
                i += 1
                continue
            for rule, deep in rules:
                taken = (yield from rule(lines, i, base)) if deep else rule(lines, i, base)
                if taken is not None:
                    nodes, i = taken
                    produced |= rule != self._paragraph or bool(nodes)
                    for n in nodes:
                        parent.add(*([txt("\n")] if apart else []), n)
                    break
        if produced and apart:
            parent.add(txt("\n"))

    def _indented(self, lines, i, base):
        if lines[i].indent <= base:
            return None
        end = i
        while end < len(lines) and (lines[end].blank or lines[end].indent > base):
            end += 1
        while lines[end - 1].blank:
            end -= 1
        levels = max(1, (min(x.indent for x in lines[i:end] if not x.blank) - base) // 2)
        top, innermost = self._steps(levels, place(lines[i], lines[end - 1]))
        yield innermost, lines[i:end], base + 2 * levels
        return [top], end

    def _steps(self, levels: int, where: tuple[int, int, int, int]) -> tuple[Node, Node]:
        """Divs inside each other: the outermost and the innermost."""
        top = innermost = Node("element", "div", "", {}, [], where)
        for _ in range(levels - 1):
            top = Node("element", "div", "", {}, [txt("\n"), top, txt("\n")], where)
        return top, innermost

    def _rule(self, lines, i, base):
        if not _HR.match(lines[i].text):
            return None
        return [placed(el("hr"), lines[i])], i + 1

    def _heading(self, lines, i, base):
        text = lines[i].text
        if not text.startswith("="):
            return None
        body = text.lstrip("=")
        depth, top = len(text) - len(body), self.options.max_heading or 6
        if depth > top:
            self.warn("heading-depth", f"Heading level {depth} is deeper than h{top}, clamping", lines[i])
        h = el(f"h{min(depth, top)}", {}, *parse_inline(self, body.rstrip("=").strip(JS_SPACE)))
        self._identify(h)
        return [placed(h, lines[i])], i + 1

    def _identify(self, h: Node) -> None:
        base = slug(h.text().encode()[:1024].decode(errors="ignore"))
        if not base:
            return
        before = self.heading_slugs.get(base, 0)
        self.heading_slugs[base] = before + 1
        h.props["id"] = f"{base}-{before}" if before else base

    def _fenced(self, lines, i, base):
        opener = fence_of(lines[i])
        if not opener:
            return None
        marks, info = opener
        end = next((j for j in range(i + 1, len(lines)) if closes(lines[j], marks)), len(lines))
        body = "".join(" " * max(0, x.indent - lines[i].indent) + x.text + "\n" for x in lines[i + 1 : end])
        code = el("code")
        language = re.split(r"[ \t]", info)[0]
        if language:
            code.add_class("language-" + language)
        if body:
            code.add(txt(body))
        pre = el("pre", {}, code)
        pre.pos = code.pos = place(lines[i], lines[min(end, len(lines) - 1)])
        return [pre], min(end + 1, len(lines))

    # --- elements -----------------------------------------------------------------

    def _element(self, lines, i, base):
        line = lines[i]
        if not line.text.startswith("<"):
            return None
        if _DOCTYPE.match(line.text):
            return [] if self.options.sanitize else [Node("doctype")], i + 1
        m = _TAG.match(line.text)
        written = (m[1] or "div").lower()
        tag, end = written, self._children_end(lines, i)
        if self.options.sanitize and written in vocab.STRIPPED_TAGS:
            self.warn("sanitize", f"`<{written}>` is not allowed, dropping it and its content", line)
            return [], end
        if self.options.sanitize and written not in vocab.ALLOWED_TAGS:
            self.warn("sanitize", f"`<{written}>` is not allowed, using `<div>` instead", line)
            tag = "div"
        node = el(tag)
        content = self._attributes(node, written, line, m.end())
        content = None if content is None else content.strip(JS_SPACE)
        if tag in vocab.VOID:
            if content or end > i + 1:
                self.warn("void-element", f"`<{tag}>` cannot have content, ignoring it", line)
            return [placed(node, line)], i + 1
        node.pos = place(line, lines[end - 1])
        under = [x for x in lines[i + 1 : end] if not x.blank]
        if tag in vocab.RAW_TEXT:
            text = "\n".join([content] * bool(content) + [" " * max(0, x.indent - line.indent - 2) + x.text for x in under])
            if text:
                node.add(txt(text))
            return [node], end
        if content:
            node.children = parse_inline(self, content)
        if under:
            yield node, lines[i + 1 : end], min(x.indent for x in under)
        return [node], end

    @staticmethod
    def _children_end(lines, i) -> int:
        end = i + 1
        for j in range(i + 1, len(lines)):
            if lines[j].blank:
                continue
            if lines[j].indent <= lines[i].indent:
                break
            end = j + 1
        return end

    def _attributes(self, node: Node, tag: str, line: Line, at: int) -> str | None:
        """Set the attributes from ``at`` on; what follows a closing ``>``, or None."""
        text = line.text
        while at < len(text):
            if text[at] == ">":
                return text[at + 1 :]
            m = _ATTRIBUTE.match(text, at)
            if not m:
                at += 1
                continue
            at = m.end()
            name, value = m[1], next((v for v in m.groups()[1:] if v is not None), None)
            if self.options.sanitize:
                name = name.lower()
                if not attribute_allowed(tag, name):
                    self.warn("sanitize", f"`{name}` is not allowed on `<{tag}>`, dropping it", line)
                    continue
                if value is not None and not protocol_allowed(name, value):
                    self.warn("sanitize", f"`{name}` points at a protocol that is not allowed, dropping it", line)
                    continue
            prop = vocab.property_of(name)
            if value is None:
                node.props[prop] = True
            elif tag == "a" and prop == "href" and is_page(value) and len(value.encode()) < 1024:
                node.props[prop] = normal_link(value)
                self.collect("link", node.props[prop])
            elif prop == "className":
                node.props[prop] = [c for c in re.split(r"[ \t]+", value) if c]
            else:
                node.props[prop] = value
        return None

    # --- tables -------------------------------------------------------------------

    def _columns(self, lines, i) -> list[str] | None:
        """Alignments if a table's header is at i and its delimiter row below."""
        if i + 1 >= len(lines) or "|" not in lines[i].text or lines[i].blank or lines[i + 1].blank:
            return None
        marks = split_cells(lines[i + 1].text)
        if len(marks) != len(split_cells(lines[i].text)) or not all(map(_COLUMN.match, marks)):
            return None
        return [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c[0] == ":", c[-1] == ":"), "") for c in marks]

    def _captioned(self, lines, i) -> bool:
        if not lines[i].text.startswith("|") or i + 2 >= len(lines):
            return False
        cells = split_cells(lines[i].text)
        return len(cells) == 1 and bool(cells[0]) and self._columns(lines, i + 1) is not None

    def _table_at(self, lines, i) -> int | None:
        """Where the header is of a table that starts at i, with or without a caption."""
        if "|" not in lines[i].text:
            return None
        head = i + 1 if self._captioned(lines, i) else i
        return head if self._columns(lines, head) is not None else None

    def _table(self, lines, i, base):
        head = self._table_at(lines, i)
        if head is None:
            return None
        aligns = self._columns(lines, head)
        end = head + 2
        while end < len(lines) and not lines[end].blank and lines[end].indent < base + 2 and lines[end].text[0] not in "<=" and not _HR.match(lines[end].text):
            end += 1
        table = placed(el("table", {}, txt("\n")), lines[i], lines[end - 1])
        if head > i:
            caption = el("caption", {}, *parse_inline(self, split_cells(lines[i].text)[0].replace("\\|", "|")))
            table.add(placed(caption, lines[i]), txt("\n"))
        table.add(placed(el("thead", {}, txt("\n"), self._row(lines[head], "th", aligns), txt("\n")), lines[head]), txt("\n"))
        if end > head + 2:
            body = placed(el("tbody", {}, txt("\n")), lines[head + 2], lines[end - 1])
            for x in lines[head + 2 : end]:
                body.add(self._row(x, "td", aligns), txt("\n"))
            table.add(body, txt("\n"))
        return [table], end

    def _row(self, line: Line, tag: str, aligns: list[str]) -> Node:
        cells = split_cells(line.text)
        row = placed(el("tr"), line)
        for k, align in enumerate(aligns):
            text = cells[k].replace("\\|", "|") if k < len(cells) else ""
            cell = el(tag, {"style": f"text-align: {align}"} if align else {}, *parse_inline(self, text))
            row.add(txt("\n"), placed(cell, line))
        return row.add(txt("\n"))

    # --- lists --------------------------------------------------------------------

    def _list(self, lines, i, base):
        m = _MARKER.match(lines[i].text)
        if not m:
            return None
        ordered, indent, start = m[1] is not None, lines[i].indent, i

        def mine(line: Line) -> bool:
            k = _MARKER.match(line.text)
            return bool(k) and (k[1] is not None) == ordered and line.indent == indent

        node = el("ol" if ordered else "ul", {}, txt("\n"))
        loose, tasks = self._loose(lines, i, mine, indent), False
        while i < len(lines):
            at = i
            while at < len(lines) and lines[at].blank:
                at += 1
            if at >= len(lines) or not mine(lines[at]):
                break
            item, i, task = yield from self._item(lines, at, indent, loose)
            tasks |= task
            node.add(item, txt("\n"))
        if tasks:
            node.add_class("contains-task-list")
        digits = (m[1] or "1").lstrip("0") or "0"
        number = min(int(digits), MOST) if len(digits) < 20 else MOST
        if number != 1:
            node.props["start"] = float(number)
        return [placed(node, lines[start], lines[i - 1])], i

    @staticmethod
    def _loose(lines, i, mine, indent) -> bool:
        gap = False
        for x in lines[i:]:
            if x.blank:
                gap = True
            elif mine(x):
                if gap:
                    return True
            elif x.indent <= indent:
                return False
        return False

    def _item(self, lines, i, indent, loose):
        def opens(x: Line) -> bool:
            return bool(_MARKER.match(x.text)) or x.text[0] in "<="

        end = i + 1
        while end < len(lines):
            x = lines[end]
            if x.blank:
                peek = next((j for j in range(end, len(lines)) if not lines[j].blank), len(lines))
                if peek == len(lines) or lines[peek].indent <= indent:
                    break
                end = peek
            elif x.indent > indent or not (opens(x) or _HR.match(x.text)):
                end += 1
            else:
                break
        item = el("li")
        body = lines[i].text[_MARKER.match(lines[i].text).end() :].strip(JS_SPACE)
        task = _TASK.match(body)
        if task:
            body = task[2] or ""
            item.add_class("task-list-item")
        plain = i + 1
        while plain < end and not lines[plain].blank and not opens(lines[plain]):
            plain += 1
        text = " ".join([body, *(x.text for x in lines[i + 1 : plain])])
        holder = el("p") if loose else item
        if task:
            box = el("input", {"type": "checkbox", "checked": task[1] != " ", "disabled": True})
            holder.add(placed(box, lines[i]), *([txt(" ")] if text else []))
        holder.add(*parse_inline(self, text))
        if loose:
            item.add(txt("\n"), placed(holder, lines[i], lines[end - 1]), txt("\n"))
        if end > plain:
            inner = min(x.indent for x in lines[plain:end] if not x.blank)
            yield item, lines[plain:end], min(inner, lines[plain].indent)
        return placed(item, lines[i], lines[end - 1]), end, bool(task)

    # --- paragraphs ----------------------------------------------------------------

    def _ends_paragraph(self, lines, j, base) -> bool:
        x = lines[j]
        return x.blank or x.indent > base or x.text[0] in "=<" or bool(fence_of(x) or _MARKER.match(x.text) or _HR.match(x.text)) or self._table_at(lines, j) is not None

    def _paragraph(self, lines, i, base):
        end = i + 1
        while end < len(lines) and not self._ends_paragraph(lines, end, base):
            end += 1
        text = ""
        for x in lines[i:end]:
            text += (" " if text else "") + x.text.rstrip(JS_SPACE)
        text = text.rstrip(JS_SPACE)
        if not text:
            return [], end
        under = _SETEXT.match(lines[end].text) if end < len(lines) and lines[end].indent == base and not lines[end].blank else None
        if under:
            h = el("h1" if under[1] else "h2", {}, *parse_inline(self, text))
            self._identify(h)
            return [placed(h, lines[i], lines[end])], end + 1
        return [placed(el("p", {}, *parse_inline(self, text)), lines[i], lines[end - 1])], end


class _Counted(Document):
    """A source of which only the elements are counted: of divs inside each other one is made, the others are a number."""

    def __init__(self, text: str, options: Options = Options()):
        self.not_made = 0
        super().__init__(text, options)

    def _steps(self, levels, where):
        self.not_made += levels - 1
        return super()._steps(1, where)


def count_elements(text: str | None, options: Options = Options()) -> Counter[str]:
    """How many elements of each tag a source holds."""
    d = _Counted(text or "", options)
    found = Counter(n.tag for n, _ in d.root.walk() if n.type == "element")
    if d.not_made:
        found["div"] += d.not_made
    return found


def attribute_allowed(tag: str, name: str) -> bool:
    if re.fullmatch(r"aria-[a-z-]+|data-[A-Za-z0-9_-]+", name):
        return True
    return name in vocab.ALLOWED_ATTRIBUTES["*"] or name in vocab.ALLOWED_ATTRIBUTES.get(tag, ())


def place(first: Line, last: Line) -> tuple[int, int, int, int]:
    return first.number, 1, last.number, last.units + 1


def placed(node: Node, first: Line, last: Line | None = None) -> Node:
    node.pos = place(first, last or first)
    return node


def without_comments(lines: list[Line]) -> list[Line]:
    """Lines but for comments; what fenced code holds is no comment."""
    if not any(_COMMENT.match(x.text) for x in lines):
        return list(lines)
    out, fence = [], None
    for x in lines:
        if fence and not closes(x, fence[0]) and (x.blank or x.indent >= fence[1]):
            out.append(x)
            continue
        if fence and closes(x, fence[0]):
            fence = None
            out.append(x)
            continue
        fence = None
        if opener := fence_of(x):
            fence = (opener[0], x.indent)
        elif _COMMENT.match(x.text):
            continue
        out.append(x)
    return out


def parse(text: str | None, options: Options = Options()) -> Document:
    return Document(text or "", options)
