import os

import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm.common import in_small_batches, lookup, lower_ascii, split_words, staged, unstage, words_of


def test_lookup_both_ways(spark):
    left = spark.range(900).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id))) AS k", "id AS n")
    right = spark.createDataFrame([("hot", 1), (None, 2), ("k1", 3), ("none", 4)], "k string, v int")
    want = None
    for most in (10_000, 0):  # broadcast, and dealt out by key and salt
        got = lookup(left, right, ["k"], F.col("id"), broadcast_bytes=most)
        assert got.columns == ["id", "k", "n", "v"]
        rows = sorted(tuple(r) for r in got.collect())
        assert len(rows) == 900 and want in (None, rows)
        want = rows
    assert [r[3] for r in want[:3]] == [1, 3, None] and want[7][3] == 2


def test_staged_tables(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    seen = staged(spark.range(1600).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"]) for b in bs), "id long"))
    assert sorted(r.id for r in seen.collect()) == [100, 500, 500, 500] and spark.conf.get(rows) == before
    df = staged(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 10 and os.path.isdir(path)
    unstage(df)
    assert not os.path.isdir(path)


def test_small_batches_hold_all_rows():
    texts = ["a" * k for k in (5, 0, 30, 7, 3, 9, 9, 1)] + [None, "b" * 100, None]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = list(in_small_batches(iter([b, b.slice(0, 0), b.slice(2)]), most=20))
    assert [t for x in got for t in x.column("text").to_pylist()] == texts + texts[2:]
    assert all(x.num_rows == 1 or sum(len(t or "") for t in x.column("text").to_pylist()) <= 20 for x in got)


def test_words_of_arrow_batches_are_those_of_python():
    texts = [" \t Ab\x0bc\x1cd\x85e\xa0É  ", None, "", "\n", "x  Y\fz"]
    words, counts = split_words(pa.array(texts))
    want = [[lower_ascii(w) for w in words_of(t)] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]
