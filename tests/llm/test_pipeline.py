"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from folio.llm.common import staged

from .test_line_dedup import brute as dedup_brute
from .test_mixing import wanted
from .test_near_dup import brute as near_brute
from .test_repetition import brute as repetition_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "w%d" % min(int(rng.expovariate(0.004)), 3000)
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    items = [" ".join("q%d" % rng.randrange(10**6) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = text(rng.randint(5, 12))
        if i % 10 == 1:
            t = t.replace("w", "z", 1)
        if i % 15 == 2:
            t += " " + items[i % 4]
        if i % 12 == 3:
            t = "spam and ham again " * 60
        rows.append((i, t, "en", rng.choice("abc"), len(t)))
    for i in range(120, 140):
        rows.append((i, rows[i - 100][1] + " tail%d" % i, "en", "a", 0))
    rows += [(200, None, None, None, None), (201, "", "en", "b", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages(spark, corpus):
    d, items = corpus
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = staged(stage(spark, docs, d))
        seen[name] = (before, [r.asDict() for r in docs.collect()])
        if name != "mixture":
            assert docs.columns == COLUMNS
    before, after = seen["quality"]

    def good(t):
        ws = (t or "").split()
        three, cov, longest = repetition_brute(ws, 10) if len(ws) >= 50 else (0, 0, 0)
        return len(ws) >= 50 and 2 * three <= len(ws) and cov <= 0.4 * len(ws) and longest <= 150

    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if good(r["text"])}
    before, after = seen["lines"]
    want = dedup_brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, (t, _) in want.items()}
    before, after = seen["near_duplicates"]
    want = near_brute([(r["doc_id"], r["text"]) for r in before], 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if i == c}
    before, after = seen["decontaminated"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not any(i in r["text"] for i in items)}
    before, after = seen["mixture"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(r["text"].split())
    for r in after:
        taken[r["source"]] += len(r["text"].split())
    for s, t in wanted(sizes).items():
        assert abs(taken[s] - t) <= 0.08 * t
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3


def test_run(spark, corpus):
    assert cp.ORACLE_SQL is None
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "mixture"]
    got = cp.run(spark, corpus[0])
    assert got.columns == [*COLUMNS, "copy"] and got.count() > 50


def test_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (edge_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == [*df.columns, *(["copy_"] if name == "mixture" else [])]
            rows = out.collect()
            if df is no_docs:
                assert rows == []
                continue
            ids = Counter(r["doc_id"] for r in rows)
            every = {1: 1, 2: 1, 3: 1, None: 1, 4: 2, 5: 1, 6: 1, 7: 1}
            if name == "quality":
                assert not ids  # all are short or one word again and again
            elif name in ("lines", "decontaminated"):
                assert ids == every
            elif name == "near_duplicates":
                assert ids == every | {4: 1}
            else:
                assert ids.keys() <= every.keys() and max(ids.values()) <= 6
    assert os.path.isdir(f"{tmp_path}/benchmark.parquet")
