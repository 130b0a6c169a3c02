"""Template lines to statements of a script. The script is text; nothing here runs it."""

from __future__ import annotations

import re

_LINES = re.compile(r"\r\n|\r|\n")
_CODE = re.compile(r"[ \t]*%(%?)(.*)", re.S)
_ESCAPED = re.compile(r"([ \t]*)\\(%.*)", re.S)
_PIECE = re.compile(r"\\\{\{|\{\{(.*?)\}\}|[\\`$]", re.S)
_QUOTES = "'\"`"


def is_script_line(line: str) -> bool:
    return bool(_CODE.match(line))


class _Brackets:
    """Whether brackets, strings or comments are open after some lines of code. Regular expressions aren't understood."""

    def __init__(self):
        self.depth = 0
        self.modes: list = []  # a quote, "*" in a block comment, or the number of braces open in a ${}

    @property
    def open(self) -> bool:
        return self.depth > 0 or bool(self.modes)

    def feed(self, s: str) -> None:
        i = 0
        while i < len(s):
            mode, two = self.modes[-1] if self.modes else None, s[i : i + 2]
            if mode == "*":
                end = s.find("*/", i)
                if end < 0:
                    return
                self.modes.pop()
                i = end + 2
            elif isinstance(mode, str):
                if s[i] == "\\":
                    i += 1
                elif s[i] == mode:
                    self.modes.pop()
                elif mode == "`" and two == "${":
                    self.modes.append(0)
                    i += 1
                i += 1
            elif two == "//":
                return
            elif two == "/*":
                self.modes.append("*")
                i += 2
            else:
                self._code(s[i], mode)
                i += 1

    def _code(self, c: str, braces: int | None) -> None:
        if c in _QUOTES:
            self.modes.append(c)
        elif c in "([{":
            self.depth += 1
            if c == "{" and braces is not None:
                self.modes[-1] += 1
        elif c in ")]}":
            self.depth = max(0, self.depth - 1)
            if c == "}" and braces is not None:
                if braces:
                    self.modes[-1] -= 1
                else:
                    self.modes.pop()


def code_lines(lines: list[str]) -> list[bool]:
    """Which lines are code: those with a sigil, and what a ``%%`` line takes in until its brackets close."""
    code = [is_script_line(x) for x in lines]
    i = 0
    while i < len(lines):
        m = _CODE.match(lines[i])
        if m and m[1]:
            state = _Brackets()
            state.feed(m[2])
            end = i
            while state.open and end + 1 < len(lines) and not is_script_line(lines[end + 1]):
                end += 1
                state.feed(lines[end])
            if not state.open:
                code[i : end + 1] = [True] * (end + 1 - i)
                i = end
        i += 1
    return code


def _content(line: str) -> str:
    m = _ESCAPED.fullmatch(line)
    line = m[1] + m[2] if m else line

    def piece(m: re.Match) -> str:
        if m[0] == r"\{{":
            return "{{"
        return "\\" + m[0] if m[1] is None else "${" + m[1] + "}"

    return _PIECE.sub(piece, line)


def compile_script(text: str | None) -> tuple[str, list[bool]]:
    """(source, whether each line of the text is code)."""
    lines = _LINES.split(text or "")
    code, out = code_lines(lines), ["const __out = []"]
    for i, (line, is_code) in enumerate(zip(lines, code)):
        m = _CODE.match(line)
        out.append((m[2] if m else line) if is_code else f"__out.push([{i}, `{_content(line)}`])")
    return "\n".join(out), code
