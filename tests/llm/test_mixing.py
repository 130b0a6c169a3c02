import random
from collections import defaultdict
from math import log

from folio.llm.mixing import mix, mixed


def wanted(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


def test_targets_and_rates(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice((1, 5, 20, 80))), rng.choice(["a"] * 8 + ["b", "c", "d", None, "Z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = wanted(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 5
    again = {(r.doc_id, r.taken) for r in mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    # of one source, rates are an exponential tilt by size: larger texts move further from 1
    for s in sizes:
        tilt = {r.size: r.rate for r in got if r.source == s}
        rates = [tilt[k] for k in sorted(tilt)]
        assert rates in (sorted(rates), sorted(rates, reverse=True)) and len(tilt) == 4
        free = {k: v for k, v in tilt.items() if v < 3}
        slopes = [log(v) / k for k, v in free.items()]  # one multiplier per source
        assert all(abs(x - slopes[0]) < 1e-9 for x in slopes)
        assert free or want[s] == 3 * sizes[s]


def test_edges(spark, edge_docs, no_docs):
    got = mix(edge_docs).collect()
    assert len(got) == 9 and all(r.taken == 0 for r in got if r.size == 0)
    assert mix(no_docs).count() == mixed(no_docs).count() == 0
    out = mixed(edge_docs)
    assert out.columns == [*edge_docs.columns, "copy_"]
    by = defaultdict(int)
    for r in got:
        by[r.doc_id, r.source, r.k1] += r.copies
    rows = out.collect()
    assert len(rows) == sum(by.values())
    only_empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {r.target for r in mix(only_empty).collect()} == {0.0}
