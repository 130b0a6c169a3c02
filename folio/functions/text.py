"""String and line rules as columns: everything here stays in the JVM and is open to the optimizer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import vocab

# The characters that JavaScript trims; the fewer that a slug turns into hyphens.
JS_SPACE = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SLUG_SPACE = r" \t\n\r\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def simple_lower(c: Column) -> Column:
    """Lower case, one character for each; whole-string lower() where that is the same."""
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.substring(F.lower(x), 1, 1)), "")
    return F.when(c.rlike(r"^[\x00-\x7f]*\z"), F.lower(c)).otherwise(each)


def slug(c: Column) -> Column:
    """Where a label points, and a heading's id: blanks to hyphens, then only letters, numbers and - / . _ # stay."""
    dashed = F.regexp_replace(c, f"[{SLUG_SPACE}]+", "-")
    return simple_lower(F.regexp_replace(dashed, r"[^\p{L}\p{N}\-/._#]", ""))


def normalize_link(c: Column) -> Column:
    return simple_lower(F.regexp_replace(c, f"[{JS_SPACE}]+", "-"))


def is_page_link(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.rlike(r"^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)")


def uri_component(c: Column) -> Column:
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def html_text(c: Column) -> Column:
    """Escaped as text of an element."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&#x26;")), F.lit("<"), F.lit("&#x3C;"))


def html_value(c: Column) -> Column:
    """Escaped as an attribute's value."""
    for char, code in (("&", "&#x26;"), ('"', "&#x22;"), ("'", "&#x27;"), ("`", "&#x60;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def json_string(c: Column) -> Column:
    """A JSON string with short escapes, other controls as lower-case unicode escapes, and the rest as it is."""
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(code))
    rare = c
    for n in set(range(32)) - {8, 9, 10, 12, 13}:
        rare = F.replace(rare, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rare).otherwise(c), F.lit('"'))


def json_number(c: Column) -> Column:
    return F.when(c == c.cast("long"), c.cast("long").cast("string")).otherwise(c.cast("string"))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


def indent_width(c: Column) -> Column:
    """Columns of a line's indentation; a tab runs to the next fourth."""
    chars = F.split(F.regexp_extract(c, r"^[ \t]*", 0), "")
    step = lambda a, x: F.when(x == "\t", a + 4 - a % 4).when(x == " ", a + 1).otherwise(a)
    return F.aggregate(chars, F.lit(0), step)


def split_documents(c: Column) -> Column:
    """array<string>: the documents of a stream, cut at lines of three hyphens; at least one, blank ones dropped."""
    whole = F.concat(F.regexp_replace(c, r"\r(?=\n|\z)", ""), F.lit("\n"))
    parts = F.transform(F.split(whole, r"(?md)^---[ \t]*\n", -1), lambda p: F.regexp_replace(p, r"\n\z", ""))
    full = F.filter(parts, lambda p: F.length(F.translate(p, " \t\r\n", "")) > 0)
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit("")))


_MATTER = r"(?s)\A(?:[ \t\r]*\n)*\+\+\+[ \t]*\r?\n(?:(.*?)\n)??\+\+\+[ \t]*\r?(?:\n(.*))?\z"


def front_matter(c: Column) -> Column:
    """struct<matter,body>; matter is null where there is none."""
    has = c.rlike(_MATTER)
    return F.struct(F.when(has, F.regexp_extract(c, _MATTER, 1)).alias("matter"), F.when(has, F.regexp_extract(c, _MATTER, 2)).otherwise(c).alias("body"))


def lines(c: Column) -> Column:
    """array<struct<number,indent,text,blank,units>> of a source."""

    def one(raw, i):
        raw = F.regexp_replace(raw, r"\r\z", "")
        text = F.regexp_replace(raw, r"^[ \t]+", "")
        return F.struct((i + 1).alias("number"), indent_width(raw).alias("indent"), text.alias("text"), (F.length(text) == 0).alias("blank"), utf16_length(raw).alias("units"))

    return F.transform(F.split(c, "\n", -1), one)


def script_lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n", -1)


def is_script_line(c: Column) -> Column:
    return c.rlike(r"^[ \t]*%")


def is_thematic_break(c: Column) -> Column:
    return c.rlike(r"^([-*_])(?:[ \t]*\1){2,}[ \t]*\z")


def is_doctype(c: Column) -> Column:
    return c.rlike(r"(?i)^<!doctype\b[^>]*>?[ \t]*\z")


def is_comment(c: Column) -> Column:
    return c.rlike(r"^[ \t]*#(?:[ \t]|\z)")


def setext_level(c: Column) -> Column:
    return F.when(c.rlike(r"^=+[ \t]*\z"), 1).when(c.rlike(r"^-{4,}[ \t]*\z"), 2)


def task_state(c: Column) -> Column:
    """True or false for a checked or open task item's text, else null."""
    mark = F.regexp_extract(c, r"^\[([ xX])\](?:[ \t]+.*)?\z", 1)
    return F.when(mark == " ", False).when(F.lower(mark) == "x", True)


def link_scheme(c: Column) -> Column:
    """Lower-case scheme of a link, null for a relative one."""
    return F.when(c.rlike(r"^[^:/?#]*:"), F.lower(F.regexp_extract(c, r"^([^:/?#]*):", 1)))


def table_cells(c: Column) -> Column:
    """array<string> of a pipe row."""
    inner = F.regexp_replace(F.regexp_replace(c, r"^[ \t]*\|?", ""), r"\|?[ \t]*\z", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), js_trim)


def names(c: Column, sigil: str) -> Column:
    """array<string>: tags (#) or mentions (@) of text without raw spans, links and escapes."""
    return F.regexp_extract_all(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){sigil}((?:[\p{{L}}_]|(?![0-9])\p{{N}})(?:[\p{{L}}\p{{N}}_\-]*[\p{{L}}\p{{N}}_])?)"), F.lit(1))


def addresses(c: Column) -> Column:
    """array<string>: bare e-mail addresses of a text, whatever stands around them, from left to right.

    A name is taken whole or not at all, from its first character or the end of the address before it, and nothing is given back: length is no matter.
    """
    return F.regexp_extract_all(c, F.lit(r"(?:\G|(?<![A-Za-z0-9.]))[A-Za-z0-9.]++@[a-z0-9]++(?:\.[a-z$]++)++"), F.lit(0))


def typography(c: Column) -> Column:
    """Arrows, ellipses and dashes of text without raw spans."""
    for seq, pic in (("<-->", "↔"), ("<==>", "⇔"), ("-->", "→"), ("<--", "←"), ("==>", "⇒"), ("<==", "⇐")):
        c = F.regexp_replace(c, rf"(?<![-<=>]){seq}(?![-<=>])", pic)
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\.)\.\.\.(?!\.)", "…"), "(?<!-)--(?!-)", "—")


def yaml_scalar(c: Column) -> Column:
    """A flat scalar's type by the core schema: null, bool, int, float or str."""
    return (
        F.when(c.isin("", "~", "null", "Null", "NULL"), "null")
        .when(c.isin("true", "True", "TRUE", "false", "False", "FALSE"), "bool")
        .when(c.rlike(r"^[-+]?(0o[0-7]+|0x[0-9a-fA-F]+|[0-9]+)\z"), "int")
        .when(c.rlike(r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))\z"), "float")
        .otherwise("str")
    )


# --- plain prose: texts that hold no markup at all, told apart and written by columns ---------------------------

#: Emoticons of letters, digits and dashes only. A class in front, so that a search skips what begins none.
_WORDLIKE = sorted(f for f in vocab.EMOTICONS if re.fullmatch(r"[A-Za-z0-9.,-]+", f))
_FACE = f"(?=[{''.join(sorted({f[0] for f in _WORDLIKE}))}])(?:{'|'.join(map(re.escape, _WORDLIKE))})"


def is_plain(text: Column) -> Column:
    """Whether a text is words, commas, full stops and line ends only, so that it parses to paragraphs of one text each and nothing more. False for null and empty texts.

    Searches for single strings come first, then patterns without nested repetition: length is no matter, and most texts with markup are told by their first sign of it.
    """
    never = ("..", ",,", "  ", " \n", "--")
    free = F.lit(True)
    for pair in never:
        free = free & ~text.contains(pair)
    free = free & ~text.endswith(" ") & ~text.rlike(r"[^a-zA-Z \n.,\p{L}\p{N}-]")  # any other character may be markup
    free = free & ~text.rlike(r"\A[^\p{L}]") & ~text.rlike(r"\n[^\p{L}\n]")  # a line begins with a letter
    free = free & F.when(text.contains("-"), ~text.rlike(r"-(?:(?![\p{L}\p{N}])|(?<![\p{L}\p{N}]-))")).otherwise(F.lit(True))  # a dash inside a word
    return F.coalesce((text != "") & free & ~text.rlike(_FACE), F.lit(False))


def _paragraphs(text: Column) -> Column:
    """Of plain prose, without line ends after the last paragraph."""
    return F.regexp_replace(text, r"\n+\z", "")


def plain_html(text: Column) -> Column:
    """HTML of plain prose."""
    return F.concat(F.lit("<p>"), F.translate(F.regexp_replace(_paragraphs(text), r"\n\n+", "</p><p>"), "\n", " "), F.lit("</p>"))


def plain_nodes(text: Column) -> Column:
    """Number of nodes of plain prose: the root, and two for each paragraph."""
    return (F.lit(3) + F.lit(2) * F.regexp_count(_paragraphs(text), F.lit(r"\n\n+"))).cast("long")
