import random

import pytest

from folio.llm import common
from folio.llm.common import components, lower_ascii, words_of
from folio.llm.near_dup import drop_near_duplicates, near_duplicates


def shingles(t, k):
    ws = words_of(lower_ascii(t or ""))
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute(rows, k=2):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = "m%d" % rng.randrange(10**6)
    return ws


@pytest.mark.parametrize("seed,block,heavy", ((0, 200, 100_000), (1, 7, 50)))
def test_against_brute_force(spark, seed, block, heavy, monkeypatch):
    """Also with lists that are split by second values and blocks, and joins of more keys than are broadcast."""
    monkeypatch.setattr("folio.llm.near_dup.BLOCK", block)
    monkeypatch.setattr("folio.llm.common.HEAVY", heavy)
    rng = random.Random(seed)
    texts = []
    for size in (3, 6, 12, 40, 90, 200):
        for _ in range(4):
            base = ["w%d" % rng.randrange(300) for _ in range(size)]
            for _ in range(8):
                texts.append(" ".join(mutated(rng, base, rng.choice((0, 0, 1, 1, 2, size // 12, size // 8)))))
    base = ["g%d" % i for i in range(100)]
    for i in range(60):  # a chain: each is near the next, the ends are far apart
        base = mutated(rng, base, 2)
        texts.append(" ".join(base))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark, edge_docs, no_docs):
    got = near_duplicates(edge_docs).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[None].component_id is None and by[None].kept
    assert by[6].n_shingles == 1 and by[5].n_shingles == 1
    assert near_duplicates(no_docs).count() == 0
    kept = drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 2, 3, None, 4, 5, 6, 7)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (50, 51), (51, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[51] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_map_type_and_hot_keys(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 3, "one two three four five six seven", {"k": k % 2}) for k in range(60)] + [(9, "alpha beta gamma delta epsilon zeta", {})], "doc_id long, text string, m map<string,int>")
    want = [(0, "one two three four five six seven"), (9, "alpha beta gamma delta epsilon zeta")]
    assert sorted(tuple(r) for r in drop_near_duplicates(docs).select("doc_id", "text").collect()) == want
    monkeypatch.setattr(common, "HEAVY", 1)  # all keys but the heavy one are shuffled
    assert sorted(tuple(r) for r in drop_near_duplicates(docs).select("doc_id", "text").collect()) == want
    got = near_duplicates(docs.select("doc_id", "text"))
    assert got.count() == 61 and {(r.doc_id, r.component_id) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (9, 9)}
