import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from folio.llm import toxicity
from folio.llm.common import crc_bucket, staged
from folio.llm.toxicity import fit, noisy_or, score, sentences


def corpus(n=400):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ss = [" ".join(rng.choices(vocab, k=8)) for _ in range(rng.randint(1, 12))]
        if bad:
            k = rng.randrange(len(ss))
            ss[k] = "you vile fool " + ss[k]
        docs.append((i, ". ".join(ss) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_places(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = dict(labels)
    # wrong labels on held-out rows must not matter: they are never read
    shown = [(i, y if crc_bucket(i, 5) else 1 - y) for i, y in labels]
    model = fit(d, spark.createDataFrame(shown, "doc_id long, label int"))
    got = score(d, model).collect()
    held = [r for r in got if r.held_out]
    assert held and all(crc_bucket(r.doc_id, 5) == 0 for r in held)
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)
    texts = dict(docs)
    for r in got:
        if known[r.doc_id] and r.predicted:
            assert any("vile" in texts[r.doc_id][s.start : s.end] for s in r.spans)


def test_noisy_or():
    z = np.array([0.0, 0.0, -50.0])
    assert np.allclose(noisy_or(z, np.array([0, 0, 1]), 2), [0.75, 0.0])
    assert sentences("a. b!\nc") == [(0, 2), (2, 5), (5, 6), (6, 7)]


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (4, None)], "doc_id long, label int")
    docs = edge_docs.select("doc_id", "text")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    none = fit(docs, labels.limit(0))
    assert {r.predicted for r in score(docs, none).collect()} == {0}
    assert score(no_docs.select("doc_id", "text"), none).count() == 0


def test_rows_that_share_an_id_are_one_text_of_the_sample(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 4 AS doc_id", "concat('text ', id, '. more') AS text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, label int")
    bags, y, _, _ = toxicity._sample_features(docs, labels, 2)
    assert len(y) == bags.n_bags <= 4
    long = spark.createDataFrame([(k, "word " * 400) for k in range(40)], "doc_id long, text string")
    many = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5_000)
    assert len(toxicity._sample_features(long, many, 40)[1]) == 4  # two of 2,000 bytes for each label
    monkeypatch.setattr(toxicity, "LONGEST_TEXT", 1_000)
    assert len(toxicity._sample_features(long, many, 40)[1]) == 0


def test_scores_against_a_plain_loop(spark):
    docs = spark.createDataFrame([(1, "You are vile. Fine day!\nvile vile"), (2, None), (3, "nothing here"), (4, "a. b? c! vile")], "doc_id long, text string")
    rng = np.random.default_rng(3)
    w, b = rng.normal(0, 2, 1 << toxicity.BITS).astype(np.float32), -1.0
    for r in score(docs, (w, b)).collect():
        text = {1: "You are vile. Fine day!\nvile vile", 2: "", 3: "nothing here", 4: "a. b? c! vile"}[r.doc_id]
        left, spans = 1.0, []
        for s, e in toxicity.sentences(text):
            z = b
            for word in set(toxicity.tokens(text[s:e])):
                for f in toxicity.features([word]):
                    z += float(w[f])
            p = 1 / (1 + np.exp(-z))
            left *= 1 - p
            if p >= 0.5:
                spans.append((s, e, round(p, 5)))
        assert abs(r.score - (1 - left)) < 1e-5 and [(x.start, x.end, round(x.p, 5)) for x in r.spans] == spans


def test_training_takes_little_more_than_the_sample(spark, monkeypatch):
    """The driver holds hashed words in 32 bits and works on parts of them; parts make no difference to the weights."""
    text = F.expr("concat(array_join(transform(sequence(1, 2500), i -> concat('word', (id * 131 + i * 7) % 1500, if(i % 9 = 0, '.', ''))), ' '), if(id % 3 = 0, ' vile', ''))")
    docs = staged(spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text")))
    labels = spark.range(600).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS label")
    tracemalloc.start()
    w, b = fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(w) and most < 150e6, most
    monkeypatch.setattr(toxicity, "PART", 60_000)
    again, c = fit(docs, labels)
    assert b == c and (w == again).all()
