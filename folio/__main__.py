"""``python -m folio [options] FILE...``: one output per file, or of standard input without files.

Small jobs on one machine run the kernels directly; for many files use ``folio.operators.documents.DocFrame``.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .kernels.blocks import Options, parse
from .kernels.markdown import parse_markdown
from .kernels.script import compile_script
from .kernels.tree import to_html, to_json


def report(doc) -> list[str]:
    """Front matter, references and messages as lines."""
    out = [f"front matter {a}-{b}: {s if s is not None else '(none)'}" for s, a, b in doc.matters]
    out += [f"reference {d}:{kind}:{name}" for d, kind, name in doc.references]
    return out + ["message " + ("{}:{}-{}:{}: ".format(*m.pos) if m.pos else "") + m.reason for m in doc.messages]


def output(text: str, a: argparse.Namespace) -> str:
    if a.script:
        return compile_script(text)[0]
    if a.markdown:
        root = parse_markdown(text)
        return to_html(root) if a.html else to_json(root, False)
    doc = parse(text, Options(documents=a.documents, frontmatter=not a.no_frontmatter, autolink=not a.no_autolink, sanitize=not a.no_sanitize))
    if a.messages:
        return "\n".join(report(doc))
    if a.stats:
        return f"{len(text.encode())} bytes, {sum(1 for _ in doc.root.walk())} nodes"
    return to_html(doc.root) if a.html else to_json(doc.root)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("folio", description="Parse documents.")
    for name in ("documents", "no-frontmatter", "no-autolink", "no-sanitize", "stats", "messages", "html", "script", "markdown"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("files", nargs="*")
    a = p.parse_args(args)  # an unknown option ends with status 2
    for f in a.files or ["-"]:
        data = sys.stdin.buffer.read() if f == "-" else Path(f).read_bytes()
        print(output(data.decode("utf-8", "replace"), a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
