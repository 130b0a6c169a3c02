import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import gru, lm_score
from folio.llm.lm_score import frequent_words, op9_lm_score, score_documents


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(0)
    return {k: (rng.standard_normal(s) * 0.3) for k, s in gru.SHAPES.items()}


def test_gradients_match_differences(weights):
    rng = np.random.default_rng(1)
    xs, ys = rng.integers(0, 20, 11), rng.integers(0, 200, 11)
    new = np.zeros(11, bool)
    new[:3], new[9] = True, True
    args = (xs, ys, new, [3, 3, 2, 2, 1], rng.standard_normal((3, gru.HIDDEN)))
    _, g, _ = gru.gradients(weights, *args)
    for k in gru.SHAPES:
        i = int(np.argmax(np.abs(g[k])))
        loss = []
        for e in (1e-4, -1e-4):
            w = {n: v.copy() for n, v in weights.items()}
            w[k].ravel()[i] += e
            loss.append(gru.gradients(w, *args)[0])
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k].ravel()[i]) < 1e-3


def test_score_is_of_the_whole_text(weights):
    """However texts are laid out in slots and windows, the state is carried and the score is the same."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, gru.WORDS + 1, n).astype(np.int32) for n in (1, 7, 300, 40, 2)]
    ways = [gru.score(weights, texts, 5, slots, window) for slots, window in ((1, 3), (2, 50), (5, 1000))]
    assert np.allclose(ways[0], ways[1]) and np.allclose(ways[0], ways[2])
    h, total = np.zeros((1, gru.HIDDEN)), 0.0
    for before, y in zip([5, *texts[2][:-1]], texts[2]):
        h = gru.Run(1, float).forward(weights, np.array([before]), np.array([False]), [1], h)
        total += gru.log_probs(weights, h, np.array([y]))[0]
    assert math.isclose(total / math.log(10), ways[0][2], rel_tol=1e-6)


def test_probabilities_sum_to_one(weights):
    h = np.random.default_rng(3).standard_normal((1, gru.HIDDEN))
    every = np.arange(gru.WORDS + 1)
    assert math.isclose(np.exp(gru.log_probs(weights, np.repeat(h, len(every), 0), every)).sum(), 1, rel_tol=1e-6)


def test_base_and_held_out_gain(spark):
    rng = random.Random(6)
    langs = [["%s%d" % (c, i) for i in range(60)] for c in "ab"]
    rows = [(i, " ".join(rng.choices(langs[i % 2], k=60))) for i in range(600)] + [(900, None), (901, ""), (None, "A0 B0"), (902, "never seen"), (5, "a1")]
    df = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, text string, score long, words string")
    got = score_documents(df).collect()
    assert len(got) == len(rows)
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)


def test_edges(spark, edge_docs, no_docs):
    assert score_documents(edge_docs).count() == 9
    assert score_documents(no_docs).count() == 0
    none = spark.createDataFrame([(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in score_documents(none).collect())


def test_query_trains_on_every_training_text(spark, tmp_path):
    """No id here is of the one in 16 that were once trained on: a model of a sample is the untrained one."""
    rng = random.Random(8)
    langs = [["%s%d" % (c, i) for i in range(60)] for c in "ab"]
    df = spark.createDataFrame([(i, " ".join(rng.choices(langs[i % 2], k=60))) for i in range(600)], "doc_id long, text string")
    df.where("pmod(xxhash64('train', doc_id), 16) <> 0").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_lm_score(spark, str(tmp_path)).where("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


def test_scores_are_those_of_a_plain_loop(spark, monkeypatch):
    """Vocabulary, frequent words, rare words joined by shuffle, and words that were never seen: one token after the other."""
    monkeypatch.setattr(lm_score, "train_model", lambda docs, words, start, n: start)
    monkeypatch.setattr(lm_score, "frequent_words", lambda counts: frequent_words(counts, 2300))
    rng = random.Random(12)
    words = ["Wörd%d" % i for i in range(3500)]
    rows = [(i, "  ".join(rng.choices(words, [(k + 1) ** -0.5 for k in range(3500)], k=600)) + " new%d " % i) for i in range(150)]
    rows += [(None, None), (2**60 + 1, " \n"), (2**60 + 3, "x\x85y\xa0z")]
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    c = Counter(w for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in tok(t))
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    top = frequent_words(spark.createDataFrame(list(c.items()), "word string, n long"), 2300)
    vocabulary = {w: i + 1 for i, (w, _) in enumerate(top[: gru.WORDS])}
    assert len(vocabulary) == gru.WORDS < len(top) < len(c) and len(got) == len(rows)
    counts = np.array([0.0, *[c[w] for w in vocabulary]])
    counts[0] = sum(c.values()) - counts.sum()
    p = gru.initial(counts)
    outside = math.log10(counts[0] + len(c) - len(vocabulary) + 1)
    for i, t in [*rows[:12], *rows[-3:]]:
        h, before, total = np.zeros((1, gru.HIDDEN), np.float32), vocabulary["\n"], 0.0
        for w in tok(t):
            h = gru.Run(1).forward(p, np.array([before]), np.array([False]), [1], h)
            before = vocabulary.get(w, 0)
            total += gru.log_probs(p, h, np.array([before]))[0] / math.log(10) + (0 if before else math.log10(c[w] + 1) - outside)
        assert math.isclose(got[i].score, total, rel_tol=1e-5)


def test_frequent_words_are_a_total_order(spark):
    counts = spark.createDataFrame([(f"w{i}", 5) for i in range(400)] + [("top", 1000), ("b", 990), ("c", 985)], "word string, n long")
    assert len(frequent_words(counts, 1000)) == 403
    got = frequent_words(counts, 300)
    assert [w for w, _ in got[:3]] == ["top", "b", "c"] and 290 <= len(got) <= 300 and got == frequent_words(counts.repartition(7), 300)
    assert [w for w, _ in frequent_words(counts, 2)] == ["top", "b"] and frequent_words(counts, 0) == []
