"""DocFrame: a DataFrame of sources, and the DataFrames that its texts hold.

Each output runs one narrow kernel per source in Arrow batches, next to the scan: no shuffle, and only the columns
asked for are made. Texts of plain prose never leave the JVM for outputs that columns can make or that they have nothing of. Filters on other columns belong before it. All outputs also work on streams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..kernels import blocks, fences, markdown, script, yaml12
from ..kernels.tree import Node, to_html, to_json
from ..kernels.urls import find_links

PROPS = "array<struct<name:string,kind:string,s:string,n:double,b:boolean,list:array<string>>>"
NODES = f"node_id int, parent_id int, ordinal int, depth int, document int, type string, tag string, value string, props {PROPS}, line int, column int, end_line int, end_column int"
PLACE = "line int, column int, end_line int, end_column int"


def _prop(name: str, v) -> tuple:
    if isinstance(v, bool):
        return name, "bool", None, None, v, None
    if isinstance(v, list):
        return name, "list", None, None, None, v
    return (name, "string", v, None, None, None) if isinstance(v, str) else (name, "number", None, float(v), None, None)


def _node_rows(root: Node, documents: bool, tags: frozenset | None = None, types: frozenset | None = None, content: bool = False, level: int | None = None) -> Iterator[tuple]:
    """Pre-order rows; a stack instead of recursion, so depth is no matter. Only rows that are wanted are made; ids count every node."""
    stack, next_id, document = [(root, None, 0, 0)], 0, 0
    while stack:
        n, parent, ordinal, depth = stack.pop()
        me, next_id = next_id, next_id + 1
        if documents and depth == 1:
            document = ordinal
        if (tags is None or n.tag in tags) and (types is None or n.type in types) and (level is None or depth == level):
            props = [_prop(k, v) for k, v in n.props.items()]
            yield (me, parent, ordinal, depth, document, n.type, n.tag or None, n.value if n.type in ("text", "raw", "comment") else None, props, *(n.pos or (None,) * 4), *([n.text()] if content else []))
        if n.children:
            stack += [(c, me, k, depth + 1) for k, c in zip(range(len(n.children) - 1, -1, -1), reversed(n.children))]


def _plain_nodes(plain: DataFrame, tags: frozenset | None, types: frozenset | None, content: bool, level: int | None = None) -> DataFrame:
    """The same rows of plain prose: the root, and for each stretch of lines between empty ones a paragraph and its text. Columns only."""
    ls = F.col("ls")
    number = F.sequence(F.lit(0), F.size("ls") - 1)
    blank = lambda i: F.coalesce(F.get(ls, i), F.lit("")) == ""
    starts = F.filter(number, lambda i: ~blank(i) & blank(i - 1))
    ends = F.filter(number, lambda i: ~blank(i) & blank(i + 1))
    x = plain.select("source_id", F.split("text", "\n", -1).alias("ls"))
    x = x.select("source_id", "ls", F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("parts"))
    text = lambda p: F.array_join(F.slice(ls, p["s"] + 1, p["e"] - p["s"] + 1), " ")
    none, of = F.lit(None), T.StructType.fromDDL(NODES + (", content string" if content else ""))

    def row(*values) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name) for v, f in zip(values, of)])

    nothing = F.array().cast(of["props"].dataType)
    rows = []
    if (tags is None or "p" in tags) and (types is None or "element" in types) and level in (None, 1):
        rows.append(lambda p, k: row(2 * k + 1, 0, k, 1, 0, "element", "p", none, nothing, p["s"] + 1, 1, p["e"] + 1, X.utf16_length(F.get(ls, p["e"])) + 1, *([text(p)] if content else [])))
    if tags is None and (types is None or "text" in types) and level in (None, 2):
        rows.append(lambda p, k: row(2 * k + 2, 2 * k + 1, 0, 2, 0, "text", none, text(p), nothing, none, none, none, none, *([text(p)] if content else [])))
    below = F.flatten(F.transform("parts", lambda p, k: F.array(*[r(p, k) for r in rows]))) if rows else F.array().cast(T.ArrayType(of))
    if tags is None and (types is None or "root" in types) and level in (None, 0):
        whole = F.array_join(F.transform("parts", text), "")
        below = F.concat(F.array(row(0, none, 0, 0, 0, "root", none, none, nothing, none, none, none, none, *([whole] if content else []))), below)
    return x.select("source_id", F.inline(below))


class DocFrame:
    """options: keyword arguments of kernels.blocks.Options."""

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "source_id", **options):
        self.df = df.select(F.col(id_col).alias("source_id"), F.col(text_col).cast("string").alias("text"))
        self.options = replace(blocks.Options(), **options)

    def _split(self) -> tuple[DataFrame, DataFrame | None]:
        """The sources that need a kernel, and those of plain prose, for which columns do; None where options make a difference to these."""
        o = self.options
        if o.documents or o.line_offset or re.fullmatch(r"[\w.,-]*", o.frontmatter_fence):
            return self.df, None
        plain = X.is_plain(F.col("text"))
        return self.df.where(~plain), self.df.where(plain)

    def _marked_rows(self, schema: str, kernel: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
        """As ``_rows``, for outputs of which plain prose has none."""
        return self._rows(schema, kernel, self._split()[0])

    def _rows(self, schema: str, kernel: Callable[[str | None], Iterable[tuple]], df: DataFrame | None = None) -> DataFrame:
        """A row for each that the kernel gives for a text. Ids pass as they are: they are picked, never converted."""
        id_type = self.df.schema["source_id"].dataType
        out = T.StructType([T.StructField("source_id", id_type), *T.StructType.fromDDL(schema).fields])
        fields = list(to_arrow_schema(out))

        def made(ids: pa.Array, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [ids.take(pa.array(of, pa.int64()))]
            for f, values in zip(fields[1:], zip(*rows) if rows else [()] * (len(fields) - 1)):
                if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type):
                    flat = [x for v in values for x in v]
                    kind = f.type.value_type
                    parts = [pa.array(c, t.type) for c, t in zip(zip(*flat) if flat else [()] * kind.num_fields, kind)]
                    cuts = pa.array([0, *accumulate(map(len, values))], pa.int32())
                    columns.append(pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(parts, fields=list(kind))).cast(f.type))
                else:
                    columns.append(pa.array(values, f.type))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of, rows = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for r in kernel(t):
                        of.append(i)
                        rows.append(r)
                    if len(rows) > 50_000:
                        yield made(b.column(0), of, rows)
                        of, rows = [], []
                yield made(b.column(0), of, rows)

        return (self.df if df is None else df).mapInArrow(run, out)

    def documents(self) -> DataFrame:
        """(document, text, matter, body) of each document of each source: columns only."""
        x = self.df.select("source_id", F.posexplode(X.split_documents(F.col("text"))).alias("document", "text"))
        return x.select("source_id", "document", "text", X.front_matter(F.col("text")).alias("m")).select("source_id", "document", "text", "m.*")

    def lines(self) -> DataFrame:
        return self.df.select("source_id", F.explode(X.lines(F.col("text"))).alias("l")).select("source_id", "l.*")

    def nodes(self, tags: Iterable[str] | None = None, types: Iterable[str] | None = None, content: bool = False, depth: int | None = None) -> DataFrame:
        """The trees' nodes: all, or only elements of some tags, nodes of some types, or those at one depth. A filter after it can't reach the kernel.

        content: a further column with all the text below a node, so that it needs no join with its children.
        """
        o = self.options
        tags, types = (None if x is None else frozenset(x) for x in (tags, types))
        marked, plain = self._split()
        got = self._nodes(lambda t: blocks.parse(t, o).root, o.documents, tags, types, content, marked, depth)
        return got if plain is None else got.unionByName(_plain_nodes(plain, tags, types, content, depth))

    def _nodes(self, tree: Callable[[str | None], Node], documents: bool, tags, types, content: bool, df: DataFrame | None = None, depth: int | None = None) -> DataFrame:
        tags, types = (None if x is None else frozenset(x) for x in (tags, types))
        return self._rows(NODES + (", content string" if content else ""), lambda t: _node_rows(tree(t), documents, tags, types, content, depth), df)

    def element_counts(self, tags: Iterable[str] | None = None) -> DataFrame:
        """How many elements of each tag a source has, of those that it has: counted next to the tree, with no row for an element."""
        o = self.options
        tags = None if tags is None else frozenset(tags)
        marked, plain = self._split()
        got = self._rows("tag string, n long", lambda t: ((k, n) for k, n in blocks.count_elements(t, o).items() if tags is None or k in tags), marked)
        if plain is None or (tags is not None and "p" not in tags):
            return got
        return got.unionByName(plain.select("source_id", F.lit("p").alias("tag"), ((X.plain_nodes(F.col("text")) - 1) / 2).cast("long").alias("n")))

    def links(self) -> DataFrame:
        """Links in the text as plain text: start, end (code points, end exclusive), mailto."""
        return self._marked_rows("ord int, start int, end int, mailto boolean, url string", lambda t: ((i, k.start, k.end, k.mailto, t[k.start : k.end]) for i, k in enumerate(find_links(t or ""))))

    def link_counts(self) -> DataFrame:
        """How many links a text has, of those that have any: counted next to the text, with no row for a link."""
        return self._marked_rows("n long", lambda t: [(n,)] if (n := len(find_links(t or ""))) else [])

    def apply(self, function: Callable[[Node], Iterable[tuple]], schema: str) -> DataFrame:
        """Rows that a function of the user's own makes of each tree."""
        o = self.options
        return self._rows(schema, lambda t: function(blocks.parse(t, o).root))

    def references(self) -> DataFrame:
        """Tags, mentions and page links, once per document, in order of appearance."""
        o = self.options
        return self._marked_rows("document int, ord int, kind string, name string", lambda t: ((d, i, k, n) for i, (d, k, n) in enumerate(blocks.parse(t, o).references)))

    def messages(self) -> DataFrame:
        o = self.options
        return self._marked_rows(f"ord int, rule string, reason string, {PLACE}", lambda t: ((i, m.rule, m.reason, *(m.pos or (None,) * 4)) for i, m in enumerate(blocks.parse(t, o).messages)))

    def footnotes(self) -> DataFrame:
        o = self.options
        return self._marked_rows("document int, id string, number int, refs int, content string", lambda t: ((d, n.id, n.number, n.refs, n.content) for d, n in blocks.parse(t, o).footnotes))

    def front_matter(self) -> DataFrame:
        o = self.options
        return self._rows("document int, source string, open_line int, close_line int", lambda t: ((d, *m) for d, m in enumerate(blocks.parse(t, o).matters)))

    def headings(self) -> DataFrame:
        """Level, id and text of each heading, in order."""
        o = self.options

        def rows(t: str | None) -> Iterable[tuple]:
            hs = (n for n, _ in blocks.parse(t, o).root.walk() if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit() and n.pos)
            return ((i, int(n.tag[1]), n.props.get("id"), n.text(), n.pos[0]) for i, n in enumerate(hs))

        return self._marked_rows("ord int, level int, id string, title string, line int", rows)

    def json(self, positions: bool = True) -> DataFrame:
        o = self.options
        return self._rows("json string", lambda t: [(to_json(blocks.parse(t, o).root, positions),)])

    def html(self, dangerous: bool = True) -> DataFrame:
        o = self.options
        marked, plain = self._split()
        got = self._rows("html string", lambda t: [(to_html(blocks.parse(t, o).root, dangerous),)], marked)
        return got if plain is None else got.unionByName(plain.select("source_id", X.plain_html(F.col("text")).alias("html")))

    def stats(self) -> DataFrame:
        """Bytes of text and number of nodes."""
        o = self.options
        marked, plain = self._split()
        got = self._rows("bytes long, nodes long", lambda t: [(len((t or "").encode()), sum(1 for _ in blocks.parse(t, o).root.walk()))], marked)
        size = F.octet_length("text").cast("long").alias("bytes")
        return got if plain is None else got.unionByName(plain.select("source_id", size, X.plain_nodes(F.col("text")).alias("nodes")))

    def yaml(self) -> DataFrame:
        """The text as YAML: json or error."""
        return self._rows("json string, error string", lambda t: [yaml12.read_yaml(t)])

    def data(self) -> DataFrame:
        """Data fences: (ord, yaml, open_line, close_line)."""
        return self._rows("ord int, yaml string, open_line int, close_line int", lambda t: ((i, f.yaml, f.open_line, f.close_line) for i, f in enumerate(fences.extract_data(t)[0])))

    def without_data(self) -> DataFrame:
        return self._rows("text string", lambda t: [(fences.extract_data(t)[1],)])

    def data_merged(self) -> DataFrame:
        """Front matter and data fences of a source as one mapping, later keys replacing earlier ones: json or error."""

        def rows(t):
            body, parts = t or "", []
            m = blocks.parse(body, replace(blocks.Options(), autolink=False)).matters[0]
            if m[0] is not None:
                parts.append(m[0])
                body = "\n".join(body.split("\n")[m[2] :])
            try:
                values = [yaml12.parse_yaml(y) for y in [*parts, *(f.yaml for f in fences.extract_data(body)[0])]]
                return [(yaml12.yaml_json(yaml12.merge(*values)), None)]
            except yaml12.YamlError as e:
                return [(None, str(e))]

        return self._rows("json string, error string", rows)

    def script(self) -> DataFrame:
        return self._rows("source string, code array<boolean>", lambda t: [script.compile_script(t)])

    # the same sources read as Markdown

    def markdown_nodes(self, tags: Iterable[str] | None = None, types: Iterable[str] | None = None, content: bool = False) -> DataFrame:
        """As ``nodes``."""
        return self._nodes(markdown.parse_markdown, False, tags, types, content)

    def markdown_json(self) -> DataFrame:
        return self._rows("json string", lambda t: [(to_json(markdown.parse_markdown(t), False),)])

    def markdown_html(self, dangerous: bool = True) -> DataFrame:
        return self._rows("html string", lambda t: [(to_html(markdown.parse_markdown(t), dangerous),)])

    def report(self) -> DataFrame:
        """Front matter, references and messages as lines of text, one row each."""
        o = self.options

        def rows(t: str | None) -> Iterable[tuple]:
            d = blocks.parse(t, o)
            for i, (source, first, last) in enumerate(d.matters):
                yield 0, i, f"front matter {first}-{last}: {'(none)' if source is None else source}"
            for i, (document, kind, name) in enumerate(d.references):
                yield 1, i, f"reference {document}:{kind}:{name}"
            for i, m in enumerate(d.messages):
                place = "{}:{}-{}:{}: ".format(*m.pos) if m.pos else ""
                yield 2, i, f"message {place}{m.reason}"

        return self._rows("part int, ord int, said string", rows)
