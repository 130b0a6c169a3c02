"""Links in plain text: http, https, ftp, mailto, protocol-relative, and bare e-mail addresses.

Character classes follow Unicode general categories; the grammar is written as regular expressions over
translated text (one class letter per character would lose the text, so classes are built once as sets of ranges).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple


_ATOMS = frozenset("-!#$%&'*+/=?^_`{|}~abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Link(NamedTuple):
    start: int
    end: int
    mailto: bool = False


_BEYOND = 0x20000  # from here on, no plane has blanks or punctuation


def _class(test) -> str:
    """A regex class body of all characters below _BEYOND that pass, as ranges."""
    out, start = [], None
    for cp in range(_BEYOND + 1):
        hit = cp < _BEYOND and test(chr(cp), unicodedata.category(chr(cp)))
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{cp - 1:08x}" if cp - 1 > start else ""))
            start = None
    return "".join(out)


class _Grammar:
    """Compiled on first use: building the classes walks all of Unicode once per process."""

    def __init__(self):
        blank = _class(lambda ch, c: c[0] == "Z" or c == "Cc")
        point = _class(lambda ch, c: c[0] == "P")
        stop = f"{blank}{point}><｜"
        # all but these, said by what it holds: a search in ranges beyond 16 bits comes last, and few letters get there
        letters = _class(lambda ch, c: c[0] not in "ZP" and c != "Cc" and ch not in "><｜") + f"\\U{_BEYOND:08x}-\\U0010ffff"
        self.letter = letter = f"[{letters}]"
        xn = r"[xX][nN]--[A-Za-z0-9-]{1,59}"
        word = rf"{letter}(?:[-{letters}]{{0,61}}{letter})?"
        label = rf"(?:{xn}|{word})"
        self.label = re.compile(label)
        self.root = re.compile(rf"(?:{xn}|{letter}{{1,63}})")
        host = rf"(?:(?>{xn})\.|(?>{word})\.){{0,10}}{label}"  # a shorter label has no dot behind it
        self.mail_host = re.compile(rf"(?:{label}\.){{0,4}}{label}")
        port = r"(?::(?:6(?:[0-4]\d{3}|5(?:[0-4]\d{2}|5(?:[0-2]\d|3[0-5])))|[1-5]?\d{1,4})(?!\d))?"
        self.port = re.compile(port, re.A)
        over = rf"(?=$|[{stop}])(?!-|_|:\d|\.-|\.{letter})"
        self.over = re.compile(over + r"|\Z", re.A)
        end = rf"[{blank}]|$"
        inside = f"[^{blank}"
        pairs = []
        for a, b in ("[]", "()", "{}"):
            q, e = re.escape(a), re.escape(b)
            body = rf"{inside}{q}{e}]"
            nested = f"{q}{body}{{0,1000}}{e}"
            for _ in range(4):
                nested = f"{q}(?:{body}|{nested}){{0,1000}}{e}"
            pairs.append(nested)
        item = "|".join(
            [
                letter,  # most of a path; no other item begins with one, but for single characters
                *pairs,
                rf'"{inside}"]{{0,100}}"',
                rf"'{inside}']{{0,100}}'",
                rf"'(?=-|{letter})",
                r"\.{2,20}:?[a-zA-Z0-9%/&]",
                rf"\.(?!\.|{end})",
                r"-{1,20}",
                rf"[,;](?!{end})",
                rf"!{{1,20}}(?!!|{end})",
                rf"\?(?!\?|{end})",
                r"[\\/:%@#&=_~*]",
            ]
        )
        path = rf"(?:[/?#](?:{item}){{0,10000}})?"
        self.path = re.compile(path, re.S)
        self.before = re.compile(f"[{stop}]")
        atom = r"[-!#$%&'*+/=?^_`{|}~a-zA-Z0-9]"
        self.mail_name = re.compile(rf"{atom}+(?:\.{atom}+)*")
        self.mail_back = re.compile(rf"{atom}+(?:\.{atom}+)*\Z")
        # Every start begins with one of a few characters, which a search skips to. A link of a scheme and a host is matched whole, each
        # part as the ones above take it (no part gives back what it took); before its first character is no letter and no _
        alone = rf"(?<!{letter}[hHfF])(?<!_[hHfF])"
        scheme = rf"(?:(?<=[hH]){alone}[tT][tT][pP][sS]?:|(?<=[fF]){alone}[tT][pP]:)"
        self.start = re.compile(rf"[hHfFmM/@](?:{scheme}(?P<web>//(?>{host})(?>(?a:{port}))(?a:{over}|\Z){path})|(?<=[mM])[aA][iI][lL][tT][oO]:|(?<=/)/|(?<=@))", re.S)

    def ends(self, text: str, at: int) -> bool:
        return at >= len(text) or bool(self.over.match(text, at))


@lru_cache(maxsize=1)
def _grammar() -> _Grammar:
    return _Grammar()


def _dotted(g: _Grammar, text: str, at: int, most: int) -> int:
    """End of up to ``most`` labels with dots and a root label, taking back labels until a root fits; -1 without."""
    ends = []
    while len(ends) < most and (m := g.label.match(text, at)) and text[m.end() : m.end() + 1] == ".":
        at = m.end() + 1
        ends.append(at)
    for e in reversed(ends):
        if m := g.root.match(text, e):
            return m.end()
    return -1


def _rest(g: _Grammar, text: str, at: int) -> int:
    """End of an optional port and path after a host that ends there; -1 if it doesn't."""
    if (m := g.port.match(text, at)) and m.end() > at:
        at = m.end()
    if not g.ends(text, at):
        return -1
    return g.path.match(text, at).end()


def _end_of(g: _Grammar, text: str, scheme: str, at: int) -> int:
    if scheme == "mailto:":
        name = g.mail_name.match(text, at)
        if not name or text[name.end() : name.end() + 1] != "@":
            return -1
        host = g.mail_host.match(text, name.end() + 1)
        return host.end() if host and g.ends(text, host.end()) else -1
    if at >= 3 and text[at - 3] in ":/":
        return -1
    end = at + 9 if text.startswith("localhost", at) else _dotted(g, text, at, 10)
    return _rest(g, text, end) if end >= 0 else -1


def find_links(text: str, most: int | None = None) -> list[Link]:
    """Links of a text in order, all or up to ``most``."""
    if "@" not in text and "//" not in text and ":" not in text:
        return []
    g, found, at = _grammar(), [], 0
    while (most is None or len(found) < most) and (m := g.start.search(text, at)):
        i = m.start()
        if m["web"]:
            at = m.end()
            found.append(Link(i, at))
            continue
        at, scheme = i + 1, m[0].lower()
        if scheme == "@":
            host = _dotted(g, text, i + 1, 4)
            back = i
            while host >= 0 and back and (text[back - 1] in _ATOMS or text[back - 1] == "."):
                back -= 1
            name = g.mail_back.search(text[back:i])
            if host >= 0 and name and g.ends(text, host):
                found.append(Link(i - len(name[0]), host, True))
                at = host
        elif i == 0 or (text[i - 1] != "_" and g.before.match(text[i - 1])):
            end = _end_of(g, text, scheme, m.end())
            if end >= 0:
                found.append(Link(i, end))
                at = end
    return found
