"""Work on node tables: trees back to text, subtree intervals, grafts, and as-of joins.

A node table has a row per node (source_id, node_id, parent_id, ordinal, depth, type, tag, value, props, line, ...), as
``DocFrame.nodes`` gives it; ids number the nodes of a source in pre-order, so that what is below a node is a range of ids. Such tables
can be filtered, joined and edited like any other, and written again as HTML or JSON.

Writers and intervals make one pass over rows sorted by source and id, with a stack as deep as the tree: no source is
gathered as a group, and several may follow each other in one task. The shuffle is by source, since a source's result is one row; a table that is
sorted that way already isn't sorted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels.tree import Node, close_html, close_json, open_html, open_json

_KINDS = {"bool": "b", "list": "list", "string": "s", "number": "n"}


def _sorted(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of each source together and in pre-order."""
    return nodes.select("source_id", "node_id", *columns).repartition("source_id").sortWithinPartitions("source_id", "node_id")


def _over_sources(rows: DataFrame, schema: T.StructType, begin: Callable[[], object], step: Callable, end: Callable) -> DataFrame:
    """Run over sorted rows: begin() a state per source, step(state, row) and end(state) give values of result rows, to which the source's id is put in front."""
    out = T.StructType([T.StructField("source_id", rows.schema["source_id"].dataType), *schema.fields])
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, made, size = None, None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [()] * len(fields), fields)], schema=fields)

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or k != key:
                    if state is not None:
                        made += [(key, *r) for r in end(state)]
                    state, key = begin(), k
                made += [(key, *r) for r in step(state, row)]
                if len(made) > 20_000:
                    yield batch()
                    made = []
        if state is not None:
            made += [(key, *r) for r in end(state)]
        if made:
            yield batch()

    return rows.mapInArrow(run, out)


# --- writers --------------------------------------------------------------------


class _Open:
    """A node whose end isn't written yet."""

    __slots__ = ("children", "id", "node")

    def __init__(self, id: int, node: Node):
        self.id, self.node, self.children = id, node, 0


def _node(type: str, tag: str | None, value: str | None, props: list | None, place: list) -> Node:
    values = {p["name"]: p[_KINDS[p["kind"]]] for p in props or ()}
    return Node(type, tag or "", value or "", values, [], tuple(place) if place and place[0] is not None else None)


_PLACE = ["line", "column", "end_line", "end_column"]


def _write(nodes: DataFrame, name: str, opened: Callable, closed: Callable, between: str, place: list[str]) -> DataFrame:
    def begin():
        return [], []  # what is written, the open nodes

    def shut(out: list, stack: list, to: int) -> None:
        while len(stack) > to:
            top = stack.pop()
            out.append(closed(top.node, top.children))

    def step(state, row):
        out, stack = state
        node_id, parent_id, type_, tag, value, props, *where = row
        if parent_id is None:
            shut(out, stack, 0)
        else:
            k = len(stack)
            while k and stack[k - 1].id != parent_id:
                k -= 1
            if not k:
                return ()  # its parent isn't there: it went with it
            shut(out, stack, k)
            if stack[-1].children:
                out.append(between)
            stack[-1].children += 1
        node = _node(type_, tag, value, props, where)
        out.append(opened(node, stack[-1].node.tag if stack else ""))
        stack.append(_Open(node_id, node))
        return ()

    def end(state):
        out, stack = state
        shut(out, stack, 0)
        return [("".join(out),)]

    rows = _sorted(nodes, ["parent_id", "type", "tag", "value", "props", *place])
    return _over_sources(rows, T.StructType([T.StructField(name, T.StringType())]), begin, step, end)


def to_html(nodes: DataFrame, dangerous: bool = True) -> DataFrame:
    """(source_id, html) of the trees in a node table, whatever was done to it.

    Rows of a source are taken in the order of node_id; a node whose parent has no row goes with all below it, so that
    removing a row removes its subtree. A source whose rows all went has no row here.
    """
    return _write(nodes, "html", lambda n, parent: open_html(n, parent, dangerous), close_html, "", [])


def to_json(nodes: DataFrame, positions: bool = True) -> DataFrame:
    """(source_id, json), in the same way; without positions if asked, or where the table has none."""
    place = _PLACE if positions and set(_PLACE) <= set(nodes.columns) else []
    return _write(nodes, "json", lambda n, _: open_json(n), lambda n, _: close_json(n), ",", place)


def with_property(nodes: DataFrame, name: str, value: Column, where: Column) -> DataFrame:
    """nodes with a text property set to ``value`` where a condition holds: in its old place if the node has it, else at the end."""
    kind = nodes.schema["props"].dataType.elementType
    new = F.struct(*[(F.lit(name) if f.name == "name" else F.lit("string") if f.name == "kind" else value.cast("string") if f.name == "s" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]).cast(kind)
    has = F.exists("props", lambda p: p["name"] == name)
    replaced = F.transform("props", lambda p: F.when(p["name"] == name, new).otherwise(p))
    return nodes.withColumn("props", F.when(where, F.when(has, replaced).otherwise(F.concat("props", F.array(new)))).otherwise(F.col("props")))


# --- intervals ------------------------------------------------------------------


def intervals(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(source_id, node_id, depth, last, below, and the columns to keep): the last id below each node (its own, if there is none) and how many rows are below it.

    One pass over the sorted rows: a node ends where the next row is no deeper. Works on tables with rows left out: ids and depths are enough.
    Ancestors of a row x are then the rows with node_id < x <= last, descendants those with node_id in (n, last]: ranges, without recursion, at any depth.
    """
    keep = [c for c in keep or [] if c not in ("depth", "last", "below")]
    fields = [T.StructField("node_id", nodes.schema["node_id"].dataType), nodes.schema["depth"], T.StructField("last", nodes.schema["node_id"].dataType), T.StructField("below", T.LongType()), *(nodes.schema[c] for c in keep)]

    def begin():
        return [[], 0, None]  # open rows with their numbers, rows so far, the last id

    def shut(state, depth):
        open_, n, last = state
        while open_ and open_[-1][1][1] >= depth:
            number, (node_id, d, *rest) = open_.pop()
            yield (node_id, d, last, n - number - 1, *rest)

    def step(state, row):
        done = list(shut(state, row[1]))
        state[0].append((state[1], row))
        state[1] += 1
        state[2] = row[0]
        return done

    def end(state):
        return list(shut(state, -1))

    return _over_sources(_sorted(nodes, ["depth", *keep]), T.StructType(fields), begin, step, end)


def under(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that lie in the subtree of a row of ``tops`` (source_id, node_id, last), once each, by sweeping over ids instead of pairing rows."""
    ends = tops.select("source_id", F.col("node_id").alias("_at"), F.col("last").alias("_end"))
    x = nodes.select(F.struct("*").alias("_row"), "source_id", F.col("node_id").alias("_at"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("_end"))
    both = x.unionByName(ends.withColumn("_row", F.lit(None).cast(x.schema["_row"].dataType)))
    reach = F.max("_end").over(Window.partitionBy("source_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_reach", reach).where(F.col("_row").isNotNull() & (F.col("_at") <= F.col("_reach"))).select("_row.*")


def graft(nodes: DataFrame, at: DataFrame, trees: DataFrame) -> DataFrame:
    """nodes with copies of other trees put below some of them, as last children in the order of ``place``.

    at: (source_id, node_id, tree, place), where a tree goes; ``place`` orders several below one node. trees: a node table whose source_id is the
    tree's name; its root row is replaced by its children if it is a root, else it is grafted itself. Ids are given anew, so that the result is in
    pre-order again: rows after a graft move up by its size, counted by a window over (source_id, node_id). Trees must not be below themselves; places
    (line and column) go with the rows. A target that isn't in nodes, or holds no children (a text), or a
    tree without rows, changes nothing. Rows with a null source_id are left out. Both tables are read several times: persist what is dear to make.
    """
    names = ["node_id", "parent_id", "ordinal", "depth", "document", "type", "tag", "value", "props", *_PLACE]
    wide = lambda df: df.withColumn("node_id", F.col("node_id").cast("long")).withColumn("parent_id", F.col("parent_id").cast("long"))
    base = wide(nodes).select("source_id", *names)
    tops = wide(trees).select(F.col("source_id").alias("_tree"), *names)
    # trees without their root row: numbers from 0, depths and parents relative to the place of the graft
    rooted = tops.where("parent_id IS NULL").select(F.col("_tree").alias("_r"), F.col("node_id").alias("_top"), F.col("depth").alias("_depth"), (F.col("type") == "root").alias("_bare"))
    parts = tops.join(rooted, tops["_tree"] == rooted["_r"]).where(~F.col("_bare") | F.col("parent_id").isNotNull())
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_tree").orderBy("node_id")) - 1).drop("_r")
    first = parts.select(F.col("_tree").alias("_t"), F.col("node_id").alias("_p"), F.col("_n").alias("_pn"))
    parts = parts.join(first, (parts["_tree"] == first["_t"]) & (parts["parent_id"] == first["_p"]), "left").drop("_t", "_p")
    sizes = parts.groupBy("_tree").agg(F.count(F.lit(1)).alias("_size"))
    # where each graft goes: after the last id below its target; several at one place by the target's depth (deeper first), then place
    known = intervals(nodes, ["type"]).where("type IN ('root', 'element')").select("source_id", F.col("node_id").cast("long").alias("node_id"), "depth", F.col("last").cast("long").alias("last"))
    cuts = at.select("source_id", F.col("node_id").cast("long").alias("node_id"), F.col("tree").alias("_tree"), "place").join(known, ["source_id", "node_id"]).join(sizes, "_tree")
    events = base.select("source_id", F.col("node_id").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_deep"), F.lit(None).cast("string").alias("_place"), F.lit(0).cast("long").alias("_size"), "node_id", F.lit(None).cast(cuts.schema["_tree"].dataType).alias("_tree"))
    events = events.unionByName(cuts.select("source_id", F.col("last").alias("_at"), F.lit(1).alias("_kind"), (-F.col("depth")).alias("_deep"), F.format_string("%020d", F.col("place").cast("long")).alias("_place"), "_size", "node_id", "_tree"))
    before = Window.partitionBy("source_id").orderBy("_at", "_kind", "_deep", "_place").rowsBetween(Window.unboundedPreceding, -1)
    moved = events.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    shift = moved.where("_kind = 0").select("source_id", "node_id", (F.col("node_id") + F.col("_shift")).alias("_new"))
    kept = base.join(shift, ["source_id", "node_id"])
    parent = shift.select("source_id", F.col("node_id").alias("parent_id"), F.col("_new").alias("_new_parent"))
    kept = kept.join(parent, ["source_id", "parent_id"], "left").withColumn("node_id", F.col("_new")).withColumn("parent_id", F.col("_new_parent")).select("source_id", *names)
    places = moved.where("_kind = 1").select(F.col("source_id").alias("_s"), F.col("_tree").alias("_g"), F.col("node_id").alias("_target"), (F.col("_at") + F.col("_shift") + 1).alias("_first"))
    target = base.join(shift, ["source_id", "node_id"]).select(F.col("source_id").alias("_ts"), F.col("node_id").alias("_tn"), F.col("_new").alias("_target_new"), F.col("depth").alias("_target_depth"), F.col("document").alias("_target_document"))
    children = base.groupBy(F.col("source_id").alias("_cs"), F.col("parent_id").alias("_cn")).agg((F.max("ordinal") + 1).alias("_next"))
    places = places.join(target, (F.col("_s") == F.col("_ts")) & (F.col("_target") == F.col("_tn"))).join(children, (F.col("_s") == F.col("_cs")) & (F.col("_target") == F.col("_cn")), "left")
    g = places.join(parts, places["_g"] == parts["_tree"])
    top_of = Window.partitionBy("_s", "_target").orderBy("_first", "_n")
    is_top = F.col("_pn").isNull()
    g = g.withColumn("_k", F.sum(is_top.cast("int")).over(top_of) - 1)
    put = g.select(
        F.col("_s").alias("source_id"),
        (F.col("_first") + F.col("_n")).alias("node_id"),
        F.when(is_top, F.col("_target_new")).otherwise(F.col("_first") + F.col("_pn")).alias("parent_id"),
        F.when(is_top, F.coalesce("_next", F.lit(0)) + F.col("_k")).otherwise(F.col("ordinal")).cast("int").alias("ordinal"),
        (F.col("depth") - F.col("_depth") + F.col("_target_depth") + F.when(F.col("_bare"), 0).otherwise(1)).cast("int").alias("depth"),
        F.col("_target_document").alias("document"),
        *[F.col(c) for c in names[5:]],
    )
    return kept.unionByName(put)


# --- as-of joins ------------------------------------------------------------------


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False, width: int | None = None) -> DataFrame:
    """left with ``values`` of the last row of ``right`` at or before it (strict: before it), of those with equal ``by``; nulls where there is none.

    A sweep: both sides in one table, sorted, the last value carried on, so that n + m rows are sorted and no pairs made. Of rows of right at one
    place, one that is greatest in its values is taken. width: cuts the places of a key into ranges of that many, swept by themselves, with the last value of each range
    handed on to the next ones, so that a key with a third of all rows is no single task. Null keys match null keys; a null place on the left finds nothing, on the right isn't found.
    """
    on = [F.col(c) for c in by]
    val = F.struct(*values)
    names = [f"_by{i}" for i in range(len(by))]
    key = [c.alias(n) for c, n in zip(on, names)]
    x = left.select(F.struct("*").alias("_row"), *key, F.col(left_at).alias("_at"))
    y = right.where(F.col(right_at).isNotNull()).select(*key, F.col(right_at).alias("_at"), val.alias("_val"))
    x = x.withColumn("_val", F.lit(None).cast(y.schema["_val"].dataType)).withColumn("_side", F.lit(0 if strict else 1))
    y = y.withColumn("_row", F.lit(None).cast(x.schema["_row"].dataType)).withColumn("_side", F.lit(1 if strict else 0))
    both = x.unionByName(y).withColumn("_range", F.floor(F.col("_at") / F.lit(width)).cast("long") if width else F.lit(0).cast("long"))
    order = Window.partitionBy(*names, "_range").orderBy("_at", "_side", F.struct(F.col("_val")))
    both = both.withColumn("_got", F.last("_val", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = both.where("_row IS NOT NULL")
    if width:
        ranges = both.where("_at IS NOT NULL").groupBy(*names, "_range").agg(F.max(F.when(F.col("_val").isNotNull(), F.struct("_at", "_val"))).alias("_last"))
        upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*[F.col(n).alias(f"_c{n}") for n in names], F.col("_range").alias("_crange"), F.last("_last", ignorenulls=True).over(upto)["_val"].alias("_carried"))
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_c{n}")) for n in names], F.col("_range") == F.col("_crange"))
        rows = rows.join(ranges, same, "left").withColumn("_got", F.coalesce("_got", "_carried"))
    found = F.when(F.col("_at").isNotNull(), F.col("_got"))
    return rows.select("_row.*", *[found[v].alias(v) for v in values])
