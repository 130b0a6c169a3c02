import random

import pytest
from pyspark.sql import functions as F

from folio.llm import hard_negatives as H


def brute(rows, anchor, k=5, low=80, high=100):
    """rows: (id, label, whole components)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (a, la, va) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(dot(va, vb), b, lb) for j, (b, lb, vb) in enumerate(rows) if j != i]
        best = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1]))[:5]
        for ps, p, _ in best([x for x in scored if x[2] == la]):
            for r, (ns, n, _) in enumerate(best([x for x in scored if x[2] != la and low * ps <= 100 * x[0] <= high * ps])):
                out.append((a, p, r + 1, n, ps, ns))
    return sorted(out)


def table(spark, rows, scale=256.0):
    return spark.createDataFrame([(i, label, [x / scale for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    dim = rng.choice((2, 5, 9))
    rows = [(k, rng.randrange(3), [rng.randint(-9, 9) * (1 + k % 7) for _ in range(dim)]) for k in range(300)]  # lengths differ, many ties
    rng.shuffle(rows)
    if seed % 2:  # small blocks, no broadcast
        for name, value in (("BUCKET", 16), ("ANCHORS", 4), ("BROADCAST_BYTES", 0)):
            monkeypatch.setattr(H, name, value)
        monkeypatch.setattr(H, "norm_buckets", lambda v, f=H.norm_buckets: f(v, 16))
    got = H.hard_negatives(table(spark, rows).repartition(3), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(k, k % 2, [rng.randint(2**28, 2**29) for _ in range(4)]) for k in range(60)]
    got = H.hard_negatives(table(spark, rows), F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 20 == 0)


def test_edges(spark):
    base = [(k, k % 2, [1.0 + k, 2.0]) for k in range(1, 8)]
    odd = [(None, 1, [9.0, 9.0]), (20, None, [9.0, 9.0]), (21, 1, None), (22, 0, [1.0, None]), (23, 0, [float("nan"), 1.0]), (24, 0, [float("inf"), 1.0]), (25, 0, [1e30, 1.0])]
    short = [(30, 1, [3.0]), (31, 0, []), (6, 1, [7.0, 2.0]), (6, 1, [7.0, 2.0])]
    df = spark.createDataFrame(base + odd + short, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit(1)).withColumn("score", F.lit(2)).withColumn("n", F.lit("x"))
    got = sorted(tuple(r) for r in H.hard_negatives(df, F.col("id") > 0).collect())
    whole = [(i, label, [int(256 * x) for x in v]) for i, label, v in base + short]
    assert sorted(set(got)) == sorted(set(brute(whole, lambda i: True)))
    assert len(got) == len(brute(whole, lambda i: True))
    assert H.hard_negatives(df.limit(0), F.col("id") > 0).count() == 0
    assert H.hard_negatives(df, F.col("id") < 0).count() == 0


def test_a_hot_vector_and_scores_below_zero(spark):
    rows = [(k, k % 3, [10, 20] if k % 2 else [-k, 1]) for k in range(200)]
    got = H.hard_negatives(table(spark, rows), F.col("id") % 25 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 25 == 0)
