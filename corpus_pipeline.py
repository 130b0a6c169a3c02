"""A corpus pipeline over documents: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents; the last adds
``copy``, since a document may be taken up to three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import staged
from folio.llm.decontaminate import contaminated
from folio.llm.line_dedup import dedup_lines
from folio.llm.mixing import mixed
from folio.llm.near_dup import drop_near_duplicates
from folio.llm.repetition import drop_repetitive


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the repetition rule rejects: null, empty and short texts among them. Rows are judged each."""
    return drop_repetitive(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the later occurrences of repeated three-line windows removed; n_chars follows the text. No row goes: a text may become empty.

    Null texts stay null; rows equal in id and text get the same text; null ids come first.
    """
    return dedup_lines(docs, counts=None, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: shingles of five words, similarity of 0.8 or more.

    Texts without words, and rows with null ids, stay. Rows that share an id but not the text are documents of their own; of rows equal in both one stays.
    """
    return drop_near_duplicates(docs, shingle=5, threshold=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark. Null ids and null texts stay; of rows that share an id all go."""
    bad = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, numbered by a column ``copy`` (``copy_`` where docs has one already).

    Null sources are a source; texts without words are taken once, as rows of size 0, which no target counts.
    """
    return mixed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixture", mixture)]

#: The last stage solves a convex problem by iteration, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
