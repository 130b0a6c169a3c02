"""Ids beyond 2 ** 53 beside a null id in one batch: every operator gives each row its own id back."""

from pyspark.sql import functions as F

from folio.llm.line_dedup import dedup_lines
from folio.llm.lm_score import score_documents
from folio.llm.mixing import mix
from folio.llm.near_dup import drop_near_duplicates, near_duplicates
from folio.llm.repetition import judge_repetition
from folio.llm.secrets import find_secrets
from folio.llm.toxicity import fit, score

A, B = 2**60 + 1, 2**60 + 3
ROWS = [(A, "one two three four five six seven eight token=abcdefghijklmn"), (None, "without an id"), (B, "nine ten eleven twelve"), (7, "one two three four five six seven eight token=abcdefghijklmn")]


def test_ids_keep_their_digits(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).withColumn("source", F.lit("a"))
    labels = spark.createDataFrame([(A, 1), (B, 0)], "doc_id long, label int")
    want = sorted(map(str, (A, None, B, 7)))
    for got in (judge_repetition(docs), score(docs, fit(docs, labels)), near_duplicates(docs), dedup_lines(docs), mix(docs), score_documents(docs), find_secrets(docs)):
        assert sorted(str(r.doc_id) for r in got.collect()) == want
    groups = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert groups == {A: 7, 7: 7, B: B, None: None}
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs).collect()) == sorted(map(str, (7, None, B)))


def test_rows_that_share_an_id_but_not_the_text_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (2, "h i j k l m n"), (3, "a b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in drop_near_duplicates(docs).collect()) == [(1, "a b c d e f g"), (1, "h i j k l m n")]
