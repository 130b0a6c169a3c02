"""String rules shared by the kernels; ``folio.functions.text`` has them as columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The characters that JavaScript trims, and the fewer that a slug turns into hyphens.
JS_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
SLUG_SPACE = " \t\n\r\xa0               　"
_SLUG_SPACES = re.compile(f"[{SLUG_SPACE}]+")
_JS_SPACES = re.compile(f"[{JS_SPACE}]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


@lru_cache(maxsize=65536)
def is_word(c: str) -> bool:
    """A letter or a number, in Unicode's sense."""
    return unicodedata.category(c)[0] in "LN"


def lower(s: str) -> str:
    """Simple lower case: one character for each."""
    return s.lower() if s.isascii() else "".join(c.lower()[:1] for c in s)


def slug(s: str) -> str:
    """Lower case, runs of blanks to a hyphen, then only letters, numbers and - / . _ # stay."""
    dashed = _SLUG_SPACES.sub("-", s)
    return lower("".join(c for c in dashed if c in "-/._#" or is_word(c)))


def normal_link(s: str) -> str:
    return lower(_JS_SPACES.sub("-", s))


def is_page(href: str) -> bool:
    """Whether a link names a page of ours: no fragment, no other host, no scheme."""
    return bool(href) and not href.startswith(("#", "//")) and not _SCHEME.match(href)


def uri_component(s: str) -> str:
    from urllib.parse import quote

    return quote(s, safe="-_.!~*'()")


def utf16_length(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2
