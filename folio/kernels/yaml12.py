"""YAML 1.2 with the core schema: one document, block and flow collections, all scalar styles.

Not supported, and refused with the line: anchors, aliases, tags, merge keys, explicit keys, directives,
several documents. Mappings keep the order of their keys.
"""

from __future__ import annotations

import math
import re

from .tree import json_string

Value = None | bool | float | str | list | dict


class YamlError(ValueError):
    """``line N: message``, with N counted from 1."""

    def __init__(self, line: int, what: str):
        super().__init__(f"line {line + 1}: {what}")


class _Line:
    """text: from the first character that is no space. empty: nothing but blanks or a comment. Both are asked for several times, and told once."""

    __slots__ = ("text", "indent", "raw", "blank", "empty")

    def __init__(self, text: str, indent: int, raw: str):
        self.text, self.indent, self.raw = text, indent, raw
        self.blank = not text or text.isspace() and not text.strip(" \t")
        self.empty = self.blank or text[0] == "#"


_INT = re.compile(r"[-+]?(?:0o[0-7]+|0x[0-9a-fA-F]+|[0-9]+)\Z")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z")
# Scalars of the core schema, and escapes in double quotes.
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False} | {s: math.nan for s in (".nan", ".NaN", ".NAN")}
_INF = {".inf", ".Inf", ".INF"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "a": "\a", "v": "\v", "e": "\x1b", "/": "/", "\\": "\\", '"': '"', " ": " ", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_HEX = {"x": 2, "u": 4, "U": 8}
_ITEM = re.compile(r"-(?:[ \t]|\Z)")
_COMMENT = re.compile(r"(?:^|(?<=[ \t]))#")
_QUOTED_KEY = re.compile(r"""'(?:''|[^'])*'?|"(?:\\.|[^"\\])*"?""")
_PLAIN_STOP = re.compile(r":(?=[ \t,\]}]|\Z)|[,\]}]|(?<=[ \t])#")
_KEY_STOP = re.compile(r"[\[{\]}]|(?<=[ \t])#|:(?=[ \t]|\Z)")
_BLOCK_HEAD = re.compile(r"([|>])([-+1-9]*)(?=[ \t]|\Z)")
_MARKER = re.compile(r"---(?:[ \t]|\Z)")


def scalar(s: str) -> Value:
    """A plain scalar by the core schema."""
    if s in _WORDS:
        return _WORDS[s]
    if s[0].isalpha():  # no number starts with a letter
        return s
    if _INT.match(s):
        sign, digits = (-1, s[1:]) if s[0] == "-" else (1, s.lstrip("+"))
        base = {"0o": 8, "0x": 16}.get(digits[:2], 10)
        return sign * (float(digits) if base == 10 else _power(digits[2:], base))
    if s.lstrip("+-") in _INF and len(s) <= 5:
        return -math.inf if s[0] == "-" else math.inf
    return float(s) if _FLOAT.match(s) else s


def _power(digits: str, base: int) -> float:
    """The number, infinite where a double can't hold it. Only the decimal base has a limit of digits in Python's int."""
    digits = digits.lstrip("0") or "0"
    return math.inf if len(digits) > 400 else float(int(digits, base)) if int(digits, base) < 2**1023 else math.inf


def _until_comment(s: str) -> str:
    m = _COMMENT.search(s) if "#" in s else None
    return s[: m.start()] if m else s


def _fold(breaks: int) -> str:
    return " " if breaks == 1 else "\n" * (breaks - 1)


class _Reader:
    def __init__(self, text: str):
        self.ends_open = not text.endswith("\n")
        self.lines: list[_Line] = []
        for i, raw in enumerate(text.split("\n")):
            raw = raw.removesuffix("\r")
            body = raw.lstrip(" ")
            if body.startswith("\t"):
                raise YamlError(i, "a tab cannot be used for indentation")
            self.lines.append(_Line(body, len(raw) - len(body), raw))
        self.at = 0

    def document(self) -> Value:
        for i, x in enumerate(self.lines):
            if x.indent:
                continue
            if x.text.startswith("%"):
                raise YamlError(i, "directives are not supported")
            if x.text == "..." or (i and _MARKER.match(x.text)):
                raise YamlError(i, "more than one document in a stream is not supported")
        if not self.lines[0].indent and _MARKER.match(self.lines[0].text):
            self.at = 1
        value = self.node(0)
        left = self.content(self.at)
        if left < len(self.lines):
            raise YamlError(left, "unexpected content after the document")
        return value

    def content(self, at: int) -> int:
        while at < len(self.lines) and self.lines[at].empty:
            at += 1
        return at

    def node(self, indent: int) -> Value:
        at = self.at = self.content(self.at)
        if at >= len(self.lines):
            return None
        if _ITEM.match(self.lines[at].text):
            return self.sequence(indent)
        if self.key_end(self.lines[at].text):
            return self.mapping(indent)
        return self.value(at, 0, max(0, indent - 1))

    def key_end(self, s: str) -> int:
        """Where the colon of a mapping's key is; 0 if the line is none."""
        depth, i = 0, 0
        if s[:1] in ("'", '"'):
            i = _QUOTED_KEY.match(s).end()
        for m in _KEY_STOP.finditer(s[i:]):
            if m[0] in "[{":
                depth += 1
            elif m[0] in "]}":
                depth = max(0, depth - 1)
            elif m[0] == "#":
                return 0
            elif not depth:
                return i + m.start()
        return 0

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (at := self.content(self.at)) < len(self.lines):
            line = self.lines[at]
            if line.indent != indent or _ITEM.match(line.text):
                break
            colon = self.key_end(line.text)
            if not colon:
                raise YamlError(at, "expected `key: value`")
            if line.text[0] == "?":
                raise YamlError(at, "explicit keys are not supported")
            if line.text[0] in "'\"":
                key = self.quoted(at, 0)[0]
            else:
                key = line.text[:colon].rstrip(" \t")
                if key.startswith("<<"):
                    raise YamlError(at, "merge keys are not supported")
            value = self.value(at, colon + 1, indent)
            if key in out:
                raise YamlError(at, "duplicate key in a mapping")
            out[key] = value
        return out

    def sequence(self, indent: int) -> list:
        out: list = []
        while (at := self.content(self.at)) < len(self.lines):
            line = self.lines[at]
            if line.indent != indent or not _ITEM.match(line.text):
                break
            rest = line.text[1:].lstrip(" \t")
            skipped = len(line.text) - len(rest)
            if skipped >= len(_until_comment(line.text)):
                self.at = at + 1
                below = self.content(self.at)
                deeper = below < len(self.lines) and self.lines[below].indent > indent
                out.append(self.node(self.lines[below].indent) if deeper else None)
                continue
            # what follows the dash is read as a line of its own, further in
            self.lines[at] = _Line(rest, indent + skipped, rest)
            self.at = at
            out.append(self.node(indent + skipped))
            self.lines[at] = line
        return out

    def value(self, at: int, col: int, indent: int) -> Value:
        line = self.lines[at]
        visible = _until_comment(line.text)
        start = col + len(line.text[col:]) - len(line.text[col:].lstrip(" \t"))
        if start >= len(visible):
            self.at = at + 1
            below = self.content(self.at)
            if below < len(self.lines):
                x = self.lines[below]
                if x.indent > indent or (x.indent == indent and _ITEM.match(x.text)):
                    self.at = below
                    return self.node(x.indent)
            return None
        c = line.text[start]
        if c in "|>":
            self.at = at
            return self.block_scalar(visible[start:], indent)
        if c in "&*!":
            raise YamlError(at, "tags are not supported" if c == "!" else "anchors and aliases are not supported")
        if c in "[{":
            flow = _Flow(self, at, start)
            out = flow.value()
            self.at = flow.line + 1
            return out
        if c in "'\"":
            out, end, _ = self.quoted(at, start)
            self.at = end + 1
            return out
        return self.plain(at, visible[start:].rstrip(" \t"), indent)

    def plain(self, at: int, text: str, indent: int) -> Value:
        breaks, i = 0, at + 1
        while i < len(self.lines):
            x = self.lines[i]
            more = _until_comment(x.text).rstrip(" \t")
            if x.blank:
                breaks += 1
            elif x.indent <= indent or _ITEM.match(x.text) or self.key_end(x.text):
                break
            elif not more:
                breaks += 1
            else:
                text += _fold(breaks + 1) + more
                breaks = 0
            i += 1
        self.at = i - breaks
        return scalar(text)

    def quoted(self, at: int, col: int) -> tuple[str, int, int]:
        """(value, line, column after the closing quote)."""
        first, quote = at, self.lines[at].text[col]
        out, breaks, i = "", 0, col + 1
        while at < len(self.lines):
            s = self.lines[at].text
            while i < len(s):
                c, after = s[i], s[i + 1 : i + 2]
                if c == quote and not (quote == "'" and after == "'"):
                    return out, at, i + 1
                if breaks:
                    out, breaks = out + _fold(breaks), 0
                if c == quote:
                    out, i = out + "'", i + 2
                elif c == "\\" and quote == '"':
                    if not after:
                        at += 1
                        if at >= len(self.lines):
                            raise YamlError(first, "unterminated double-quoted scalar")
                        s = self.lines[at].text
                        i = len(s) - len(s.lstrip(" \t"))
                        continue
                    size = _HEX.get(after, 0)
                    digits = s[i + 2 : i + 2 + size]
                    if size:
                        if len(digits) < size or not re.fullmatch("[0-9a-fA-F]+", digits):
                            raise YamlError(at, f"bad \\{after} escape")
                        out += chr(int(digits, 16)) if int(digits, 16) < 0x110000 else "\ufffd"
                    elif after in _ESCAPES:
                        out += _ESCAPES[after]
                    else:
                        raise YamlError(at, "unknown escape in a double-quoted scalar")
                    i += 2 + size
                else:
                    out, i = out + c, i + 1
            out, breaks, at, i = out.rstrip(" "), breaks + 1, at + 1, 0
        raise YamlError(first, f"unterminated {'single' if quote == chr(39) else 'double'}-quoted scalar")

    def block_scalar(self, header: str, indent: int) -> str:
        head = _BLOCK_HEAD.match(header)
        if not head:
            raise YamlError(self.at, "bad block scalar header")
        folded, marks = head[1] == ">", head[2]
        digits = [int(d) for d in marks if d.isdigit()]
        chomp = next((m for m in reversed(marks) if m in "-+"), "")
        first = self.at + 1
        if digits:
            inner = indent + digits[-1]
        else:
            full = next((x for x in self.lines[first:] if not x.blank), None)
            inner = full.indent if full and full.indent > indent else 0
        if not inner:
            self.at = first
            return ""
        out, gaps, deeper, i = None, 0, False, first
        while i < len(self.lines):
            x = self.lines[i]
            if x.blank:
                gaps += 1
            elif x.indent < inner:
                break
            else:
                more = x.indent > inner
                if out is None:
                    out = ""
                elif folded and not (more or deeper):
                    out += "\n" * gaps or " "
                else:
                    out += "\n" * (gaps + 1)
                out, gaps, deeper = out + x.raw[inner:], 0, more
            i += 1
        self.at = i
        if out is None:
            return ""
        if i >= len(self.lines) and not self.ends_open and gaps:
            gaps -= 1  # the last line's own end
        return out + {"-": "", "+": "\n" * (gaps + 1)}.get(chomp, "\n")


class _Flow:
    """A cursor over flow collections, which don't care about lines."""

    def __init__(self, reader: _Reader, line: int, col: int):
        self.r, self.line, self.col = reader, line, col

    @property
    def text(self) -> str:
        return self.r.lines[self.line].text

    def peek(self) -> str:
        """The next character after blanks, comments and line ends, or nothing."""
        while True:
            s = self.text
            while self.col < len(s) and s[self.col] in " \t":
                self.col += 1
            if self.col < len(s) and s[self.col] == "#" and (self.col == 0 or s[self.col - 1] in " \t"):
                self.col = len(s)
            if self.col < len(s):
                return s[self.col]
            if self.line + 1 >= len(self.r.lines):
                return ""
            self.line, self.col = self.line + 1, 0

    def value(self) -> Value:
        c = self.peek()
        if c not in ("[", "{"):
            return self.scalar()
        self.col += 1
        pairs, items, close = {}, [], "]" if c == "[" else "}"
        kind = "sequence" if c == "[" else "mapping"
        while (c := self.peek()) != close:
            if not c:
                raise YamlError(self.line, f"unterminated flow {kind}")
            if kind == "sequence":
                items.append(self.value())
            else:
                key = self.scalar()
                if self.peek() != ":":
                    raise YamlError(self.line, "expected `:` in a flow mapping")
                self.col += 1
                pairs[_key(key)] = None if self.peek() in (",", close) else self.value()
            c = self.peek()
            if c == ",":
                self.col += 1
            elif c != close:
                raise YamlError(self.line, "expected `,` or a closing bracket in a flow collection" if c else f"unterminated flow {kind}")
        self.col += 1
        return items if kind == "sequence" else pairs

    def scalar(self) -> Value:
        c = self.peek()
        if c in ("'", '"'):
            out, self.line, self.col = self.r.quoted(self.line, self.col)
            return out
        if c and c in "&*!":
            raise YamlError(self.line, "tags are not supported" if c == "!" else "anchors and aliases are not supported")
        m = _PLAIN_STOP.search(self.text, self.col)
        end = m.start() if m else len(self.text)
        s, self.col = self.text[self.col : end], end
        return scalar(s.rstrip(" \t"))


def _key(v: Value) -> str:
    if isinstance(v, str):
        return v
    return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"{v:g}"


def parse_yaml(text: str | None) -> Value:
    """The value of a document; null for an empty one. Raises YamlError."""
    return _Reader(text or "").document()


def _number(v: float) -> str:
    if math.isnan(v) or math.isinf(v):
        return "null"
    if abs(v) < 9.2e18 and v == int(v):
        return str(int(v))
    return next((s for s in (f"{v:.{d}g}" for d in (15, 16)) if float(s) == v), f"{v:.17g}")


def yaml_json(v: Value) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return json_string(v)
    if isinstance(v, list):
        return "[" + ",".join(map(yaml_json, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json_string(k)}:{yaml_json(x)}" for k, x in v.items()) + "}"
    return _number(v)


def read_yaml(text: str | None) -> tuple[str | None, str | None]:
    """(json, error): one of the two is None."""
    try:
        return yaml_json(parse_yaml(text)), None
    except YamlError as e:
        return None, str(e)
    except RecursionError:
        return None, "line 1: nested too deeply"


def merge(*values: Value) -> dict:
    """Mappings merged left to right, keys of later ones replacing earlier ones in place."""
    out: dict = {}
    for v in values:
        if isinstance(v, dict):
            out.update(v)
    return out
