"""The ordered document tree, and its canonical JSON and HTML forms."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import vocab


@dataclass(slots=True)
class Node:
    """type: root, element, text, doctype, comment or raw. props keep the order they were first set in.

    pos: (line, column, end line, end column), 1-based, columns in UTF-16 units; None without a place.
    """

    type: str
    tag: str = ""
    value: str = ""
    props: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    pos: tuple[int, int, int, int] | None = None

    def add(self, *nodes: Node) -> Node:
        self.children.extend(nodes)
        return self

    def add_class(self, name: str) -> None:
        self.props["className"] = [*self.props.get("className", []), name]

    def text(self) -> str:
        """All text below, joined."""
        return "".join(n.value for n, _ in self.walk() if n.type == "text")

    def copy(self) -> Node:
        def alone(n: Node) -> Node:
            return Node(n.type, n.tag, n.value, {k: list(v) if isinstance(v, list) else v for k, v in n.props.items()}, [], n.pos)

        top = alone(self)
        stack = [(self, top)]
        while stack:
            old, new = stack.pop()
            new.children = [alone(c) for c in old.children]
            stack += zip(old.children, new.children)
        return top

    def walk(self) -> Iterator[tuple[Node, int]]:
        """Every node with its depth, parents first. Trees may be deeper than Python's stack."""
        stack = [(self, 0)]
        while stack:
            n, depth = stack.pop()
            yield n, depth
            if n.children:
                stack += [(c, depth + 1) for c in reversed(n.children)]


def el(tag: str, props: dict | None = None, *children: Node) -> Node:
    return Node("element", tag, "", dict(props or {}), list(children))


def txt(value: str) -> Node:
    return Node("text", value=value)


# --- JSON ---------------------------------------------------------------------

_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNSAFE = re.compile('["\\\\\x00-\x1f]')


def json_string(s: str) -> str:
    return '"' + _UNSAFE.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def json_number(v: float) -> str:
    if not math.isfinite(v):
        return "null"
    return str(int(v)) if v == int(v) else f"{v:.17g}"


def json_value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "[" + ",".join(map(json_string, v)) + "]"
    return json_string(v) if isinstance(v, str) else json_number(v)


def open_json(n: Node) -> str:
    """A node's JSON up to its first child."""
    if n.type == "doctype":
        return '{"type":"doctype"'
    if n.type in ("text", "comment", "raw"):
        return f'{{"type":"{n.type}","value":{json_string(n.value)}'
    if n.type == "root":
        return '{"type":"root","children":['
    props = ",".join(f"{json_string(k)}:{json_value(v)}" for k, v in n.props.items())
    return f'{{"type":"element","tagName":{json_string(n.tag)},"properties":{{{props}}},"children":['


def close_json(n: Node, positions: bool = True) -> str:
    """The rest of it, after its last child."""
    if n.type not in ("root", "element"):
        return "}"
    if not positions or not n.pos:
        return "]}"
    a, b, c, d = n.pos
    return f'],"position":{{"start":{{"line":{a},"column":{b}}},"end":{{"line":{c},"column":{d}}}}}}}'


def to_json(node: Node, positions: bool = True) -> str:
    """Canonical JSON: fixed key order, properties in order, position last."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        out.append(open_json(n))
        stack.append(close_json(n, positions))
        if n.type not in ("root", "element"):
            continue
        for k in range(len(n.children) - 1, -1, -1):
            stack.append(n.children[k])
            if k:
                stack.append(",")
    return "".join(out)


# --- HTML ---------------------------------------------------------------------


def _escaper(chars: str):
    unsafe = re.compile(f"[{re.escape(chars)}]")
    return lambda s: unsafe.sub(lambda m: f"&#x{ord(m[0]):X};", s)


#: What is escaped in text, in an attribute's name, in its value.
escape_text, escape_name, escape_value = _escaper("<&"), _escaper("\t\n\f\r \"&'/<=>`"), _escaper("\"&'`")


def _attribute(name: str, value) -> str:
    attr = vocab.attribute_of(name)
    if name in vocab.BOOLEANS or name in vocab.OVERLOADED:
        if not isinstance(value, str):
            return escape_name(attr) if value or isinstance(value, list) else ""
        if value == attr or (value == "" and name in vocab.OVERLOADED):
            return escape_name(attr)
        if value == "":
            return ""
    if isinstance(value, bool):
        return escape_name(attr) if value else ""
    if isinstance(value, list):
        value = (", " if name in vocab.COMMA_LISTS else " ").join(value)
    elif not isinstance(value, str):
        value = str(int(value)) if value == int(value) else f"{value:g}"
    return f'{escape_name(attr)}="{escape_value(value)}"'


def open_html(n: Node, parent: str, dangerous: bool = True) -> str:
    """What is written of a node before its first child. parent: the tag above it."""
    if n.type == "element":
        if not n.props:
            return f"<{n.tag}>"
        attrs = "".join(f" {a}" for a in (_attribute(k, v) for k, v in n.props.items()) if a)
        return f"<{n.tag}{attrs}>"
    if n.type == "text":
        return n.value if parent in ("script", "style") else escape_text(n.value)
    if n.type == "raw":
        return n.value if dangerous else escape_text(n.value)
    return f"<!--{n.value}-->" if n.type == "comment" else "<!doctype html>" if n.type == "doctype" else ""


def close_html(n: Node, children: int) -> str:
    """And after its last one."""
    return f"</{n.tag}>" if n.type == "element" and (n.tag not in vocab.VOID or children) else ""


def to_html(node: Node, dangerous: bool = True, parent: str = "") -> str:
    """HTML of a tree; raw nodes as they are, or escaped unless ``dangerous``."""
    out: list[str] = []
    stack: list[tuple[Node | str, str]] = [(node, parent)]
    while stack:
        n, parent = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.type not in ("element", "root"):
            out.append(open_html(n, parent, dangerous))
            continue
        out.append(open_html(n, parent, dangerous) if n.props else f"<{n.tag}>" if n.type == "element" else "")
        end = close_html(n, len(n.children))
        if not n.children:
            out.append(end)
            continue
        stack.append((end, ""))
        for c in reversed(n.children):
            stack.append((c, n.tag))
    return "".join(out)
