import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folio.llm.common import words_of
from folio.llm.runs import collapse, find_runs, op11_runs, periodic_tail, strongest, word_runs


def brute(words, exponent=4, least=6):
    """Every period by itself; a stretch that a smaller period's run contains has that smaller period."""
    n, runs = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(s <= i and i + length <= s + k for s, k, _ in runs):
                runs.append((i, length, q))
            i = max(j, i + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return [w for i, w in enumerate(words) if i not in gone]


def sample(rng):
    letters, words = "abcd"[: rng.choice((1, 2, 2, 3, 4))], []
    while len(words) < rng.randint(0, 70):
        root = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        words += (root * 7)[: rng.randint(1, 40)]
        if rng.random() < 0.3:
            words *= rng.randint(1, 5)
    return words


@pytest.mark.parametrize("seed", range(8))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(600):
        words = sample(rng)
        for exponent, least in ((4, 6), (3, 3), (5, 11)):
            runs = word_runs(words, exponent, least)
            assert runs == brute(words, exponent, least)
            assert collapse(words, runs) == kept(words, runs)


class Counted(str):
    looked = 0

    def __eq__(self, other):
        Counted.looked += 1
        return str.__eq__(self, other)

    def __gt__(self, other):
        Counted.looked += 1
        return str.__gt__(self, other)

    __hash__ = str.__hash__


def hard_texts(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    nested = "a"
    for c in "bcdefghij":
        nested = nested * 4 + c
    rng = random.Random(1)
    return ["a" * n, "ab" * (n // 2), b[:n], nested[:n], ("a" * 100 + "b") * (n // 101), "".join("ab"[bin(i).count("1") & 1] for i in range(n)), "".join(rng.choice("ab") for _ in range(n))]


def test_words_are_looked_at_a_constant_number_of_times():
    for text in hard_texts(20_000):
        words = [Counted(c) for c in text]
        Counted.looked = 0
        word_runs(words)
        assert Counted.looked < 9 * len(words)


def test_edges(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.n_words): r for r in find_runs(edge_docs).collect()}
    assert sorted(got, key=str) == sorted({(1, 0), (2, 0), (3, 0), (None, 4), (4, 3), (5, 30_000), (6, 1), (7, 7)}, key=str)
    assert [tuple(x) for x in got[5, 30_000].runs] == [(0, 30_000, 1)] and got[5, 30_000].collapsed == "word"
    assert got[1, 0].collapsed == got[3, 0].collapsed == "" and not got[1, 0].runs
    assert find_runs(edge_docs).count() == 9 and find_runs(no_docs).count() == 0
    long = spark.createDataFrame([(1, "x " * 400_000 + "y " + "a b " * 200_000)], "doc_id long, text string")
    assert [tuple(x) for x in find_runs(long).first().runs] == [(0, 400_000, 1), (400_001, 400_000, 2)]


def test_strongest_run_and_ties(spark):
    runs = [[(3, 12, 3), (20, 8, 2), (40, 9, 2)], [(0, 8, 2), (9, 12, 3)], []]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "k long, runs array<struct<start:long,length:long,period:long>>")
    assert [r.b and tuple(r.b) for r in df.select("k", strongest(F.col("runs")).alias("b")).orderBy("k").collect()] == [(40, 9, 2), (0, 8, 2), None]


def test_limits():
    with pytest.raises(ValueError):
        word_runs(["a"] * 9, min_exponent=2)
    assert word_runs(["a"] * 5) == [] and word_runs(["a"] * 6) == [(0, 6, 1)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, None if k % 41 == 0 else " \n".join(sample(rng) + rng.choices("abcdefgh", k=rng.randint(0, 30)))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op11_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 400
    for k, text in rows:
        words = periodic_tail(k, words_of(text))
        runs, r = brute(words), got[k]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest()
