"""Table functions for SQL text: what documents hold, from any table or query.

    register(spark)
    spark.sql("SELECT name, count(*) FROM markup_references(TABLE(SELECT id, body FROM notes)) GROUP BY name")

Each takes a table whose first two columns are an id (any type that can be a string) and a text, gets it as Arrow batches, and gives source_id as a string and the
output's columns. Without PARTITION BY rows stay in their partitions; with it they are shuffled first, as ever in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels import blocks
from ..kernels.tree import to_html
from ..kernels.urls import find_links
from ..kernels.yaml12 import read_yaml


def _references(text: str | None) -> Iterable[tuple]:
    return ((d, i, k, n) for i, (d, k, n) in enumerate(blocks.parse(text, blocks.Options()).references))


def _html(text: str | None) -> Iterable[tuple]:
    return [(to_html(blocks.parse(text, blocks.Options()).root),)]


def _elements(text: str | None) -> Iterable[tuple]:
    stack, n = [(blocks.parse(text, blocks.Options()).root, None, 0)], 0
    while stack:
        node, above, depth = stack.pop()
        me, n = n, n + 1
        yield me, above, depth, node.type, node.tag or None, node.value if node.type in ("text", "raw", "comment") else None
        stack += [(c, me, depth + 1) for c in reversed(node.children)]


def _headings(text: str | None) -> Iterable[tuple]:
    tags = {f"h{k}": k for k in range(1, 7)}
    return ((tags[n.tag], n.props.get("id"), n.text(), n.pos[0]) for n, _ in blocks.parse(text, blocks.Options()).root.walk() if n.tag in tags and n.pos)


def _links(text: str | None) -> Iterable[tuple]:
    return ((k.start, k.end, (text or "")[k.start : k.end]) for k in find_links(text or ""))


#: Name, result columns after source_id, kernel.
FUNCTIONS: list[tuple[str, str, Callable]] = [
    ("markup_references", "document int, ord int, kind string, name string", _references),
    ("markup_html", "html string", _html),
    ("markup_nodes", "node_id int, parent_id int, depth int, type string, tag string, value string", _elements),
    ("markup_headings", "level int, id string, title string, line int", _headings),
    ("markup_links", "start int, end int, url string", _links),
    ("yaml_values", "json string, error string", lambda t: [read_yaml(t)]),
]


def _function(schema: str, kernel: Callable[[str | None], Iterable[tuple]]):
    full = f"source_id string, {schema}"
    arrow = to_arrow_schema(T.StructType.fromDDL(full))

    @arrow_udtf(returnType=full)
    class Function:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            ids, texts = rows.column(0).cast(pa.string()).to_pylist(), rows.column(1).cast(pa.string()).to_pylist()
            made = [(i, *r) for i, t in zip(ids, texts) for r in kernel(t)]
            yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [()] * len(arrow), arrow)], schema=arrow)

    return Function


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, schema, kernel in FUNCTIONS:
        spark.udtf.register(name, _function(schema, kernel))
