import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from folio.llm.line_dedup import dedup_lines


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "c d"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r._n_removed) for r in got} == brute(rows)


def test_edges(edge_docs, no_docs):
    with pytest.raises(ValueError, match="_n_removed"):
        dedup_lines(edge_docs)
    plain = dedup_lines(edge_docs, counts=None, length_col="n_chars")
    assert plain.columns == edge_docs.columns and {r.doc_id: r.n_chars for r in plain.collect()}[7] == 7
    edge_docs, no_docs = edge_docs.drop("_n_removed"), no_docs.drop("_n_removed")
    got = dedup_lines(edge_docs).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[1]._n_lines == 0 and by[2].text == "" and by[7].text == "A\nB\nC\nx"
    assert [r.text for r in got if r.doc_id == 4] == ["same text twice"] * 2
    assert dedup_lines(no_docs).count() == 0


def test_same_id_other_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (None, "a\nb\nc"), (2, "a\nb\nc"), (3, "\n\n\n"), (4, "\n\n\n")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in dedup_lines(df).collect()]
    assert (None, "a\nb\nc") in got and (2, "") in got and (3, "\n\n\n") in got and (4, "\n\n\n") in got
    assert sorted(t for i, t in got if i == 1) == ["", "d"]


def test_many_lines_take_linear_time(spark):
    def took(n):
        half = [f"line {i}" for i in range(n // 2)]
        docs = spark.createDataFrame([(1, "\n".join(half + half))], "doc_id long, text string")
        began = time.time()
        assert dedup_lines(docs).select("_n_lines", "_n_removed").first() == (n // 2 * 2, n // 2)
        assert dedup_lines(docs).select(F.md5("text")).first()[0] == hashlib.md5("\n".join(half).encode()).hexdigest()
        return time.time() - began

    took(1_000)
    assert took(400_000) < 40
