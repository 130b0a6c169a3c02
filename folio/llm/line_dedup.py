"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a text are hashed (128 bits). Of the places where a window occurs, the first in
the order (doc_id, text hash, line) stays; the lines of all later ones are removed, overlapping
windows merging into one covered set of lines. Windows of blank lines only don't count.

Shuffles: windows by hash (pre-aggregated to the first place, so that a window with a third of all rows is
one row per task), windows against the repeated ones (broadcast below a counted bound, else salted), and
covered lines against texts by document. No shuffle carries a text but the last. Work on one text is linear in its lines.

Defined cases: null texts stay null, empty texts and texts of fewer than three lines stay as they are; rows equal
in id and text are one document and get the same result; rows that share an id but not the text are
documents of their own; null ids sort first; all lines removed leaves an empty text; a text of any length is split once, and its line numbers and lines are
in memory together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, staged

#: Fixed value: the window's length in lines.
LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, h1, h2) of each window of rows (doc_id, text_hash, text)."""
    ls = F.col("_ls")
    at = lambda i, k: F.element_at(ls, i + k)
    parts = lambda i: [at(i, k) for k in range(LINES)]
    one = lambda i: F.struct(
        (i - 1).alias("line"), F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit("second"), *parts(i)).alias("h2"), F.concat(*parts(i)).rlike(r"[^\x20\x09-\x0D]").alias("full")
    )
    w = rows.select("doc_id", "text_hash", _lines(F.col("text")).alias("_ls")).where(F.size("_ls") >= LINES)
    w = w.select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(1), F.size("_ls") - (LINES - 1)), one)).alias("w"))
    return w.select("doc_id", "text_hash", "w.*").where("full").drop("full")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, lines): for each document with any, the ordered 0-based lines to remove."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    w = staged(windows(rows))
    place = F.struct("doc_id", "text_hash", "line")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = lookup(w, first, ["h1", "h2"], place).where(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    lines = later.select("doc_id", "text_hash", F.explode(F.sequence(F.col("line"), F.col("line") + (LINES - 1))).alias("line"))
    return lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = ("_n_lines", "_n_removed"), length_col: str | None = None) -> DataFrame:
    """docs with shortened texts, and two more columns, the lines before and those removed, named by counts (None: none).

    length_col: a column of docs that takes the new text's length where lines were removed. A name in counts that docs has raises an error.
    """
    if clash := set(counts or ()) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}: give other names, or counts=None")
    bad = repeated_lines(docs, id_col, text_col).select(F.col("doc_id").alias("_b_id"), F.col("text_hash").alias("_b_hash"), F.col("lines").alias("_b_lines"))
    # the row travels as one struct, so that its columns' names can't clash with those used here
    x = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    x = x.join(bad, F.col("id").eqNullSafe(F.col("_b_id")) & (F.col("h") == F.col("_b_hash")) & F.col("t").isNotNull(), "left")
    # split once; the numbers of the lines that stay by a set difference, so that work is linear in lines
    x = x.select("row", "t", "_b_lines", _lines(F.col("t")).alias("_ls"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_b_lines"))
    kept = F.transform(numbers, lambda i: F.get(F.col("_ls"), i))
    n = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size("_ls"))
    new = F.when(F.col("_b_lines").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    length = F.when(F.col("_b_lines").isNotNull(), F.length(new).cast("long"))
    own = lambda c: F.col("row").getField(c)
    cols = [new.alias(c) if c == text_col else F.coalesce(length, own(c)).alias(c) if c == length_col else own(c).alias(c) for c in docs.columns]
    more = [n.cast("long").alias(counts[0]), F.coalesce(F.size("_b_lines"), F.lit(0)).cast("long").alias(counts[1])] if counts else []
    return x.select(*cols, *more)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


#: For rows with unique ids, where the text hash never decides. {docs}: the table or CTE of documents.
DEDUP_SQL = """ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs} WHERE text IS NOT NULL),
wi AS (SELECT doc_id, i, l[i:i+2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM ls) WHERE regexp_matches(array_to_string(l[i:i+2], ''), '[^\\x20\\x09-\\x0D]')),
late AS (SELECT doc_id, i FROM wi QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM late)),
bad AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
shorter AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(len(bad.ps), 0)::BIGINT AS n_removed,
 CASE WHEN bad.ps IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(bad.ps, i)), lambda i: string_split(d.text, chr(10))[i]), chr(10)), '') END AS text
 FROM {docs} d LEFT JOIN bad USING (doc_id))"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE = {"op6_line_dedup": f"WITH {DEDUP_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_removed, text FROM shorter"}
