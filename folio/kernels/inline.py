"""Inline markup: toggling markers, links, tags, mentions, footnote references, typography, pictures."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import TYPE_CHECKING

from . import vocab
from .strings import JS_SPACE, is_page, is_word, normal_link, slug, uri_component
from .tree import Node, el, txt
from .urls import find_links

if TYPE_CHECKING:
    from .blocks import Document

# Markers, arrows, where names link to.
MARKERS = {"!!": "strong", "**": "strong", "//": "em", "__": "u", "~~": "del", "??": "mark", "^^": "sup", ",,": "sub", "``": "code"}
RAW = "``"
ARROWS = {"<-->": "↔", "<==>": "⇔", "-->": "→", "<--": "←", "==>": "⇒", "<==": "⇐"}
NAMES = {"#": ("tag", "/tags/"), "@": ("mention", "/users/")}

_ARROW = re.compile("|".join(map(re.escape, sorted(ARROWS, key=len, reverse=True))))
_FACE = "|".join(map(re.escape, sorted(vocab.EMOTICONS, key=len, reverse=True)))
_FACE_AT = re.compile(_FACE)
_SHORTCODE = re.compile(r":([A-Za-z0-9_+-]{1,64}):")
_FACES_START = frozenset(f[0] for f in vocab.EMOTICONS)
_A_FACE = f"(?=[{''.join(map(re.escape, sorted(_FACES_START)))}])(?={_FACE})"
#: Where something other than plain text may start; a face only after a blank, which is taken with it. Every part begins with a
#: plain character, so that a search skips what can't begin any.
_NEXT = re.compile("|".join([*map(re.escape, ("\\", "[[", "--", "==", "<-", "<=", "..", "#", "@", *MARKERS)), r":(?=[A-Za-z0-9_+-]{1,64}:)", *(b + _A_FACE for b in (" ", "\\t", "\\n", "\\r"))]))
_BLANKS = " \t\n\r"
#: Fixed value: links found in one run of text, at most.
RUN_LINKS = 512
_DRAWN = "-<=>"


def _ends_word(text: str, at: int) -> bool:
    return at >= len(text) or not is_word(text[at])


class _Run:
    """One pass over a text: handlers are tried in order at each place that could start markup."""

    def __init__(self, doc: Document, text: str):
        self.doc, self.text, self.at = doc, text, 0
        self.out: list[Node] = []
        self.plain: list[str] = []
        self.close = self.line_end = -1  # the next end of a wiki link, and of a line
        self.boundary = True  # whether a word may start here: what came before decides, not the text
        self.links = find_links(text, RUN_LINKS) if doc.options.autolink else []
        self.starts = {k.start: k for k in self.links}
        self.firsts = sorted(self.starts)
        self.ends = list(accumulate((k.end for k in sorted(self.links, key=lambda k: k.start)), max))

    def nodes(self) -> list[Node]:
        text, size = self.text, len(self.text)
        while self.at < size:
            if not any(getattr(self, step)() for step in _STEPS.get(text[self.at], ())) and not self.url():
                # all that can't start markup is taken at once, up to the next link
                stop = _NEXT.search(text, self.at + (text[self.at] not in _BLANKS))
                end = size if not stop else stop.start() + (text[stop.start()] in _BLANKS)
                k = bisect_right(self.firsts, self.at)
                end = min(end, self.firsts[k]) if k < len(self.firsts) else end
                self.say(text[self.at : end], text[end - 1] in _BLANKS)
                self.at = end
        self.flush()
        return self.out

    def say(self, s: str, boundary: bool = False) -> None:
        self.plain.append(s)
        self.boundary = boundary

    def flush(self) -> None:
        if whole := "".join(self.plain):
            self.out.append(txt(whole))
        self.plain = []

    def emit(self, node: Node, boundary: bool) -> None:
        self.flush()
        self.out.append(node)
        self.boundary = boundary

    def in_link(self, i: int) -> int:
        """The end of the links that cover i, or 0."""
        k = bisect_right(self.firsts, i) - 1
        return self.ends[k] if k >= 0 and i < self.ends[k] else 0

    # each returns whether it took something

    def escape(self) -> bool:
        if self.text[self.at] != "\\" or self.at + 1 >= len(self.text):
            return False
        self.say(self.text[self.at + 1])
        self.at += 2
        return True

    def wiki(self) -> bool:
        text, at = self.text, self.at
        if not text.startswith("[[", at):
            return False
        if self.close < at + 2:  # looked up again only when passed, so that unclosed openers cost nothing more
            self.close = text.find("]]", at + 2)
            if self.close < 0:
                self.close = len(text) + 1
        if self.line_end < at:
            self.line_end = text.find("\n", at)
            if self.line_end < 0:
                self.line_end = len(text) + 1
        close = self.close
        if close > len(text) or self.line_end < close:
            return False
        body = text[at + 2 : close].strip(JS_SPACE)
        if body.startswith("^"):
            made = self.doc.footnote_reference(body[1:])
            if made is None:
                return False
            self.emit(made, False)
        elif not body or not self.page_link(body):
            return False
        self.at = close + 2
        return True

    def page_link(self, body: str) -> bool:
        pipe = re.match(r"((?:\\.|[^\\|])*)\|(.*)", body, re.S)
        label, target = (pipe[1].strip(JS_SPACE), pipe[2].strip(JS_SPACE)) if pipe else (body, None)
        if not label:
            return False
        if target is None:
            target = slug(re.sub(r"\\(.)", r"\1", label, flags=re.S))
            if not target:
                return False
        link = el("a")
        if self.doc.options.sanitize and not protocol_allowed("href", target):
            self.doc.warn("sanitize", f"`[[{label}]]` points at a protocol that is not allowed, dropping the link")
        elif is_page(target) and len(target.encode()) < 1024:
            link.props["href"] = normal_link(target)
            self.doc.collect("link", link.props["href"])
        else:
            link.props["href"] = target
        link.children = _unlinked(parse_inline(self.doc, label))
        self.emit(link, True)
        return True

    def marker(self) -> bool:
        text, at = self.text, self.at
        seq = text[at : at + 2]
        if seq not in MARKERS or self.in_link(at):
            return False
        close = text.find(seq, at + 2) if seq == RAW else self.closer(seq, at + 2)
        end = close if close >= 0 else len(text)
        inner = text[at + 2 : end]
        node = el(MARKERS[seq])
        if inner:
            node.children = [txt(inner)] if seq == RAW else parse_inline(self.doc, inner)
        self.emit(node, True)
        self.at = end + 2 if close >= 0 else end
        return True

    def closer(self, seq: str, at: int) -> int:
        """Where the pair stands next, outside escapes and links."""
        for m in re.compile(r"\\|" + re.escape(seq[0])).finditer(self.text, at):
            i = m.start()
            if i < at:
                continue
            if m[0] == "\\":
                at = i + 2
            elif self.text.startswith(seq, i) and not self.in_link(i):
                return i
        return -1

    def shortcode(self, name: str) -> str | None:
        return self.doc.options.shortcodes.get(name) or vocab.shortcode(name)

    def picture(self) -> bool:
        text, at = self.text, self.at
        if (m := _SHORTCODE.match(text, at)) and (found := self.shortcode(m[1].lower())):
            self.say(found, True)
            self.at = m.end()
            return True
        if not self.boundary or not _FACE_AT.match(text, at):
            return False
        for size in range(5, 1, -1):
            found = vocab.EMOTICONS.get(text[at : at + size])
            if found and at + size <= len(text) and _ends_word(text, at + size):
                self.say(found, True)
                self.at = at + size
                return True
        return False

    def drawn(self) -> bool:
        text, at = self.text, self.at
        c, before = text[at], text[at - 1] if at else ""
        seq = ""
        if c in "-<=" and (not before or before not in _DRAWN) and (m := _ARROW.match(text, at)):
            after = text[m.end() : m.end() + 1]
            if not after or after not in _DRAWN:
                seq, pic = m[0], ARROWS[m[0]]
        if not seq and c in ".-" and before != c:
            run = len(text) - at - len(text[at:].lstrip(c)) if text.startswith(c * 4, at) else next(n for n in (3, 2, 1) if text.startswith(c * n, at))
            if run == {".": 3, "-": 2}[c]:
                seq, pic = c * run, "…" if c == "." else "—"
        if not seq:
            return False
        self.say(pic)
        self.at += len(seq)
        return True

    def name(self) -> bool:
        text, at = self.text, self.at
        if text[at] not in NAMES or (at and (text[at - 1] == "_" or is_word(text[at - 1]))):
            return False
        end = at + 1
        while end < len(text) and (text[end] in "-_" or is_word(text[end])):
            end += 1
        word = text[at + 1 : end].rstrip("-")
        if not word or not (word[0] == "_" or is_word(word[0])) or "0" <= word[0] <= "9":
            return False
        kind, where = NAMES[text[at]]
        self.doc.collect(kind, word)
        self.emit(el("a", {"href": where + uri_component(word)}, txt(text[at] + word)), False)
        self.at += 1 + len(word)
        return True

    def url(self) -> bool:
        link = self.starts.get(self.at)
        if not link:
            return False
        said = self.text[link.start : link.end]
        self.emit(el("a", {"href": ("mailto:" if link.mailto else "") + said}, txt(said)), True)
        self.at = link.end
        return True


#: What may start with a character, in the order in which it is tried. Links come last, wherever they are.
_STEPS: dict[str, list[str]] = {}
for _step, _chars in (("escape", "\\"), ("wiki", "["), ("marker", {m[0] for m in MARKERS}), ("picture", {":", *_FACES_START}), ("drawn", "-<=."), ("name", "#@")):
    for _c in _chars:
        _STEPS.setdefault(_c, []).append(_step)


def _unlinked(nodes: list[Node]) -> list[Node]:
    """Links replaced by what they hold, at any depth: a link can't hold another."""
    out: list[Node] = []
    for n in nodes:
        n.children = _unlinked(n.children)
        out += n.children if n.tag == "a" else [n]
    return out


def protocol_allowed(attr: str, value: str) -> bool:
    """Whether an attribute may hold the link: relative, or with a scheme of its list."""
    allowed = vocab.PROTOCOLS.get(attr)
    head = re.match(r"([^:/?#]*):", value)
    return not allowed or not head or head[1].lower() in allowed


def parse_inline(doc: Document, text: str) -> list[Node]:
    return _Run(doc, text).nodes() if text else []
