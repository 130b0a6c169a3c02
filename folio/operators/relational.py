"""Relational work on what documents hold: joins, ranks, histograms and graphs, left to Catalyst."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import vocab
from .trees import as_of, intervals


def reference_counts(references: DataFrame) -> DataFrame:
    """(kind, name, sources): how many sources refer to each name."""
    return references.groupBy("kind", "name").agg(F.countDistinct("source_id").alias("sources"))


def link_edges(references: DataFrame, pages: DataFrame, page_col: str = "slug") -> DataFrame:
    """(source_id, name, known): page links, and whether a page of that name exists."""
    links = references.where("kind = 'link'").select("source_id", "name").distinct()
    known = pages.select(F.col(page_col).alias("name")).distinct().withColumn("known", F.lit(True))
    return links.join(known, "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def broken_links(references: DataFrame, pages: DataFrame, page_col: str = "slug") -> DataFrame:
    links = references.where("kind = 'link'").select("source_id", "name")
    return links.join(pages.select(F.col(page_col).alias("name")), "name", "left_anti")


def in_degree(references: DataFrame) -> DataFrame:
    return references.where("kind = 'link'").groupBy("name").agg(F.countDistinct("source_id").alias("in_degree"))


def node_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type", "tag").agg(F.count(F.lit(1)).alias("n"))


def node_rollup(nodes: DataFrame) -> DataFrame:
    """Counts by document and tag, with subtotals; level says which: 0 for the finest."""
    return nodes.where("type = 'element'").rollup("document", "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def heading_suffixes(headings: DataFrame) -> DataFrame:
    """How often each title's slug came before in its source, as a window instead of the parser's counter."""
    w = Window.partitionBy("source_id", "slug").orderBy("ord")
    return headings.withColumn("before", F.row_number().over(w) - 1)


def outline(headings: DataFrame) -> DataFrame:
    """Each heading with the nearest heading of a lower level before it."""
    w = Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    best = lambda k: F.max(F.when(F.col("level") == k, F.struct("ord", "title"))).over(w)
    above = [F.when(F.col("level") > k, best(k)) for k in range(1, 6)]
    return headings.withColumn("parent", F.greatest(*above)["title"])


def footnote_order(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Numbers by first reference: references (source_id, id, pos) that have a definition (source_id, id)."""
    used = references.join(definitions.select("source_id", "id"), ["source_id", "id"], "left_semi")
    first = used.groupBy("source_id", "id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("refs"))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("source_id").orderBy("pos"))).drop("pos")


def last_definitions(definitions: DataFrame) -> DataFrame:
    """Of definitions (source_id, id, line, content), the last one of each id."""
    w = Window.partitionBy("source_id", "id").orderBy(F.desc("line"))
    return definitions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def vocabulary(spark, which: str) -> DataFrame:
    """A closed vocabulary as a table: tags, stripped, void, attributes or protocols. Under 100 rows each."""
    rows = {
        "tags": [(t,) for t in sorted(vocab.ALLOWED_TAGS)],
        "stripped": [(t,) for t in sorted(vocab.STRIPPED_TAGS)],
        "void": [(t,) for t in sorted(vocab.VOID)],
        "attributes": [(t, a) for t, names in vocab.ALLOWED_ATTRIBUTES.items() for a in sorted(names)],
        "protocols": [(a, p) for a, names in vocab.PROTOCOLS.items() for p in sorted(names)],
    }[which]
    return spark.createDataFrame(rows, {"attributes": "tag string, attr string", "protocols": "attr string, scheme string"}.get(which, "tag string"))


def judge_elements(elements: DataFrame, spark) -> DataFrame:
    """elements (…, tag): what the sanitiser makes of each tag, as joins with the vocabularies."""
    allowed = F.broadcast(vocabulary(spark, "tags").withColumn("ok", F.lit(True)))
    stripped = F.broadcast(vocabulary(spark, "stripped"))
    return elements.join(stripped, "tag", "left_anti").join(allowed, "tag", "left").withColumn("built", F.when(F.col("ok"), F.col("tag")).otherwise("div")).drop("ok")


def names_or_pages(references: DataFrame, pages: DataFrame, page_col: str = "slug") -> DataFrame:
    """(name, tagged, page): names that are referred to and pages that exist, in one table."""
    left = references.select("name").distinct().withColumn("tagged", F.lit(True))
    right = pages.select(F.col(page_col).alias("name")).distinct().withColumn("page", F.lit(True))
    return left.join(right, "name", "full").select("name", F.coalesce("tagged", F.lit(False)).alias("tagged"), F.coalesce("page", F.lit(False)).alias("page"))


def inside(marks: DataFrame, links: DataFrame, width: int | None = 100_000) -> DataFrame:
    """Marks (source_id, at) that lie inside a link (start, end) of their source, with the link's url. Links of a text don't overlap, so the last one that
    starts before a mark is the only one that may hold it: a sweep, not pairs."""
    got = as_of(marks.select("source_id", "at"), links.select("source_id", "start", "end", "url"), ["source_id"], "at", "start", ["end", "url"], width=width)
    return got.where("at < end").select("source_id", "at", "url")


def heading_above(rows: DataFrame, headings: DataFrame, width: int | None = 100_000) -> DataFrame:
    """rows (source_id, line, ...) with the title of the nearest heading above: an as-of join by line. ``title`` is null where there is none."""
    return as_of(rows, headings.select("source_id", F.col("line").alias("_line"), "title"), ["source_id"], "line", "_line", ["title"], strict=True, width=width)


def setext_headings(lines: DataFrame) -> DataFrame:
    """(source_id, title, number): lines that the next line underlines, with === or four dashes or more."""
    under = F.lead("text").over(Window.partitionBy("source_id").orderBy("number"))
    return lines.withColumn("under", under).where(F.col("under").rlike(r"^(=+|-{4,})[ \t]*$") & (F.col("text") != "")).select("source_id", F.col("text").alias("title"), "number")


def descendants(nodes: DataFrame) -> DataFrame:
    """(source_id, node_id, below): how many rows are below each node, at any depth, from its interval of ids."""
    return intervals(nodes).select("source_id", "node_id", "below")


def words(texts: DataFrame, col: str) -> DataFrame:
    """(source_id, word, place): the words of a text between single blanks, in upper case, joined laterally by built-in functions."""
    return texts.select("source_id", F.posexplode(F.split(F.coalesce(col, F.lit("")), " ", -1)).alias("place", "word")).select("source_id", F.upper("word").alias("word"), "place")


# --- aggregates that merge ------------------------------------------------------------


def name_sketches(references: DataFrame, *by: Column, within: float = 0.03) -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of the names of each group, to be kept and merged later.

    within: the relative error that an estimate may have. The sketch is the smallest of which that is six standard errors (1.04 / sqrt(cells)), so that no estimate is
    expected beyond it: at two standard errors one of twenty would be. For 0.03 that is 65,536 cells of a byte; few names take less.
    """
    log_size = math.ceil(2 * math.log2(6 * 1.04 / within))
    if not 4 <= log_size <= 21:
        raise ValueError(f"no sketch is within {within}")
    return references.groupBy(*by).agg(F.hll_sketch_agg("name", F.lit(log_size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, names): about how many distinct names there are in the groups of sketches together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("names"))


def ordered_distinct(rows: DataFrame, by: str, name: str, place: str) -> DataFrame:
    """(by, names): distinct names of each group in the order of first appearance. First places are taken before the shuffle, so that a name is one row a task, however often it occurs."""
    first = rows.groupBy(by, name).agg(F.min(place).alias("_place"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", name))), lambda x: x[name]).alias("names"))


def common_prefix(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, prefix): what the names of each group begin with. Null names don't count.

    An aggregate of Python's own in two phases: each Arrow batch gives one prefix a group, and a grouped aggregate over these few rows the prefix of prefixes.
    """

    def shared(names: list[str]) -> str:
        return os.path.commonprefix([min(names), max(names)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by("by").aggregate([("name", "min"), ("name", "max")])
            yield from t.append_column("name", pa.array([shared(x) for x in zip(t["name_min"].to_pylist(), t["name_max"].to_pylist())], pa.string())).select(["by", "name"]).to_batches()

    @F.pandas_udf("string")
    def whole(names: pd.Series) -> str:
        return shared(names.tolist())

    x = rows.where(F.col(name).isNotNull()).select(F.col(by).alias("by"), F.col(name).cast("string").alias("name"))
    return x.mapInArrow(partial, x.schema).groupBy("by").agg(whole("name").alias("prefix")).withColumnRenamed("by", by)
