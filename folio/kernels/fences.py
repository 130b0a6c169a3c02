"""Data fences: blocks of YAML in fenced code whose info is the one word ``data``."""

from __future__ import annotations

import re
from dataclasses import dataclass

_OPEN = re.compile(r"([ \t]*)(`{3,}(?=[^`]*\Z)|~{3,})[ \t]*(.*?)[ \t]*\Z", re.S)


@dataclass(frozen=True, slots=True)
class Fence:
    yaml: str
    open_line: int
    close_line: int


def extract_data(text: str | None) -> tuple[list[Fence], str]:
    """(fences, the text without them). Any other fence is passed over whole."""
    lines = (text or "").split("\n")
    fences, kept, i = [], [], 0
    while i < len(lines):
        m = _OPEN.match(lines[i])
        if not m:
            kept.append(lines[i])
            i += 1
            continue
        indent, marks = len(m[1]), m[2]
        shut = re.compile(rf"[ \t]*{re.escape(marks)}{re.escape(marks[0])}*[ \t]*\Z")
        close = next((j for j in range(i + 1, len(lines)) if shut.match(lines[j])), len(lines))
        end = min(close, len(lines) - 1)
        if m[3].lower() == "data":
            inner = [x[min(indent, len(x) - len(x.lstrip(" \t"))) :] for x in lines[i + 1 : close]]
            while inner and not inner[0]:  # leading empty lines aren't rejoined
                inner.pop(0)
            fences.append(Fence("\n".join(inner), i + 1, end + 1))
        else:
            kept += lines[i : end + 1]
        i = end + 1
    return fences, "\n".join(kept)
