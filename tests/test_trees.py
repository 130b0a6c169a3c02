"""Node tables: writers, intervals, grafts, sweeps."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folio.kernels import blocks, tree
from folio.kernels.inline import RUN_LINKS
from folio.kernels.urls import find_links
from folio.operators import relational as R
from folio.operators import trees
from folio.operators.documents import DocFrame

TEXTS = {
    1: "= Head\n\ntext **b** :) <i>\n<div class=\"a b\">\n  in it\n\n<img src=\"http://x.example/a\">\n- a\n- b\n  - c",
    2: "",
    3: None,
    4: "| a | b |\n|---|:-:|\n| 1 | 2 |\n\n```x\n<code> & \n```",
    5: "<script>\nif (a < b)\n</script>\n<br> <br>x</br>\n[ ] task\n- [x] done\n[[^n]]\n\n[[^n]]: note",
    6: "1. x\n2. y\n\n---\nsecond document #t @u [[Page]]",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "source_id long, text string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"sanitize": False}, {"documents": True}])
def test_writers_give_what_the_parser_writes(docs, options):
    d = DocFrame(docs, **options)
    n = d.nodes()
    for got, want in ((trees.to_html(n), d.html()), (trees.to_html(n, False), d.html(False)), (trees.to_json(n), d.json()), (trees.to_json(n, False), d.json(False))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_removed_row_takes_what_is_below(docs):
    n = DocFrame(docs).nodes()
    html = {r.source_id: r.html for r in trees.to_html(n.where("tag IS NULL OR tag <> 'ul'")).collect()}
    assert "<ul>" not in html[1] and "<h1" in html[1] and "<li>" not in html[1]
    assert trees.to_html(n.where("node_id > 0")).where("html <> ''").count() == 0  # without the root nothing is left
    assert trees.to_html(n.limit(0)).count() == 0 and trees.intervals(n.limit(0)).count() == 0


def test_properties(docs):
    n = trees.with_property(DocFrame(docs).nodes(), "id", F.lit("new\"one"), F.col("tag").isin("h1", "img"))
    html = {r.source_id: r.html for r in trees.to_html(n).collect()}
    assert '<h1 id="new&#x22;one">' in html[1] and 'src="http://x.example/a" id="new&#x22;one"' in html[1]


def brute_intervals(rows):
    out = set()
    for k, (i, depth) in enumerate(rows):
        below = []
        for j, d in rows[k + 1 :]:
            if d <= depth:
                break
            below.append(j)
        out.add((i, depth, below[-1] if below else i, len(below)))
    return out


def test_intervals(spark, docs):
    n = DocFrame(docs).nodes()
    for table in (n, n.where("type = 'element' OR type = 'root'"), n.where("node_id % 3 <> 1")):
        by = {}
        for r in sorted(table.collect(), key=lambda r: r.node_id):
            by.setdefault(r.source_id, []).append((r.node_id, r.depth))
        got = {}
        for r in trees.intervals(table, ["tag", "depth"]).collect():
            got.setdefault(r.source_id, set()).add((r.node_id, r.depth, r["last"], r.below))
        assert got == {k: brute_intervals(v) for k, v in by.items()}


def test_many_small_sources_and_a_deep_one(spark):
    deep = DocFrame(spark.createDataFrame([(0, "\n".join("  " * i + "- x" for i in range(1200)))], "source_id long, text string")).nodes()
    below = R.descendants(deep.where("tag = 'ul'")).agg(F.max("below"), F.count(F.lit(1))).first()
    assert tuple(below) == (1199, 1200)
    flat = spark.range(300_000).selectExpr("id DIV 5 AS source_id", "CAST(id % 5 AS int) AS node_id", "CAST(id % 5 AS int) AS depth")
    assert R.descendants(flat).agg(F.sum("below")).first()[0] == 60_000 * 10


def test_under(docs):
    n = DocFrame(docs).nodes()
    spans = trees.intervals(n, ["tag"])
    got = {(r.source_id, r.node_id) for r in trees.under(n, spans.where("tag IN ('li', 'ul', 'table')")).collect()}
    tops = [(r.source_id, r.node_id, r["last"]) for r in spans.where("tag IN ('li', 'ul', 'table')").collect()]
    want = {(r.source_id, r.node_id) for r in n.collect() if any(s == r.source_id and a <= r.node_id <= b for s, a, b in tops)}
    assert got == want and got


def test_grafts_against_trees_built_in_python(spark, docs):
    n = DocFrame(docs).nodes()
    sub = {"x": "one **two**\n- l", "y": "= t", "z": ""}
    parts = DocFrame(spark.createDataFrame(list(sub.items()), "source_id string, text string")).nodes()
    at = [(1, 0, "x", 1), (1, 0, "y", 0), (1, 1, "y", 0), (1, 2, "y", 0), (1, 3, "x", 0), (5, 0, "z", 0), (4, 3, "x", 0), (4, 99, "x", 0), (4, 1, "none", 0), (2, 0, "y", 5), (2, 0, "y", 6)]
    last = trees.intervals(n).where("source_id = 1").agg(F.max("node_id")).first()[0]
    at += [(1, last, "y", 0)]
    got = {r.source_id: r.html for r in trees.to_html(trees.graft(n, spark.createDataFrame(at, "source_id long, node_id int, tree string, place int"), parts)).collect()}
    for k, text in TEXTS.items():
        root = blocks.parse(text, blocks.Options()).root
        by_id = [x for x, _ in root.walk()]
        for source, node, name, _ in sorted((a for a in at if a[0] == k), key=lambda a: (a[1], a[3])):
            if name in sub and node < len(by_id):
                by_id[node].children += blocks.parse(sub[name], blocks.Options()).root.children
        assert got[k] == tree.to_html(root)


def test_grafted_tables_are_node_tables(spark, docs):
    n = DocFrame(docs).nodes()
    at = spark.createDataFrame([(1, 0, 6, 0), (1, 3, 4, 0)], "source_id long, node_id int, tree long, place int")
    g = trees.graft(n, at, n)
    assert g.groupBy("source_id", "node_id").count().where("count > 1").count() == 0
    spans = {(r.source_id, r.node_id): (r.depth, r["last"]) for r in trees.intervals(g).collect()}
    for r in g.where("parent_id IS NOT NULL").collect():
        depth, last = spans[r.source_id, r.parent_id]
        assert depth + 1 == r.depth and r.parent_id < r.node_id <= last
    assert g.count() == n.count() + sum(n.where(f"source_id = {k} AND parent_id IS NOT NULL").count() for k in (6, 4))


@pytest.mark.parametrize("seed", range(3))
def test_as_of(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2])
    left = [(i, key(), rng.choice([None, *range(-20, 60)])) for i in range(200)]
    right = [(key(), rng.choice([None, *range(-20, 60)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    lf, rf = spark.createDataFrame(left, "i int, k int, at int"), spark.createDataFrame(right, "k int, t int, v int")
    for strict in (False, True):
        for width in (None, 7):
            got = {r.i: r.v for r in trees.as_of(lf, rf, ["k"], "at", "t", ["v"], strict, width).collect()}
            for i, k, at in left:
                below = [(t, v is not None, v or 0) for kk, t, v in right if kk == k and t is not None and at is not None and (t < at if strict else t <= at)]
                best = max(below, default=None)
                assert got[i] == (best[2] if best and best[1] else None)
    assert trees.as_of(lf.limit(0), rf, ["k"], "at", "t", ["v"]).count() == 0
    assert trees.as_of(lf, rf.limit(0), ["k"], "at", "t", ["v"], width=5).where("v IS NOT NULL").count() == 0


def test_one_source_with_many_marks_and_links(spark):
    links = spark.range(100_000).selectExpr("7L AS source_id", "CAST(id * 10 AS int) AS start", "CAST(id * 10 + 4 AS int) AS end", "concat('u', id) AS url")
    marks = spark.range(200_000).selectExpr("7L AS source_id", "CAST(id * 5 + 1 AS int) AS at")
    began = time.time()
    got = R.inside(marks, links).agg(F.count(F.lit(1)), F.countDistinct("url"), F.min(F.col("at") % 10), F.max(F.col("at") % 10)).first()
    assert tuple(got) == (100_000, 100_000, 1, 1) and time.time() - began < 30


def test_links_without_a_maximum():
    text = "http://x.example/a " * 1500
    assert len(find_links(text)) == 1500 and len(find_links(text, RUN_LINKS)) == RUN_LINKS


def test_unclosed_wiki_links_take_linear_time():
    def took(n):
        began = time.process_time()
        blocks.parse("[[ a " * n, blocks.Options())
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 12 * max(took(8_000), 0.02)
    html = tree.to_html(blocks.parse("[[ a [[ b ]] c [[ [[e]] [[", blocks.Options()).root)
    assert html == '<p><a href="a--b">a [[ b</a> c <a href="e">[[e</a> [[</p>'


def test_grafted_tables_are_parsed_once(spark, tmp_path, capsys):
    """A graft reads both node tables several times; the query keeps them."""
    from folio.plans.catalog import QUERIES

    spark.range(30).selectExpr("id c_custkey", "cast(id % 2 as int) c_nationkey", "'x' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    QUERIES["grafted_html"](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert "InMemoryTableScan" in plan and "Scan parquet" in plan
