"""Plain prose: what the predicate takes, columns write as the kernel does; and values, aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions import values as V
from folio.kernels import blocks, tree, vocab
from folio.operators import relational as R
from folio.operators.documents import DocFrame, _node_rows

BITS = ["word", "A", "é", "日本", "xD", "X", "D", "P", "B", "8", "12", "0", "1", " ", " ", " ", " ", ", ", ". ", ".", ",", "-", "\n", "\n", "\n\n", "a-b", "x.y", "st,", "\n\n\n", "  ", "#", ":", ")", "T-T", "\t", "--", "²", "٣", "ª", " ", "́", "=", "one two three"]


def texts():
    rng = random.Random(11)
    out = ["".join(rng.choices(BITS, weights=[6] * 25 + [1] * (len(BITS) - 25), k=rng.randint(0, 14))) for _ in range(25_000)]
    faces = [f"say {f} now" for f in vocab.EMOTICONS] + [f for f in vocab.EMOTICONS] + [f"a\n{f}" for f in vocab.EMOTICONS]
    return [*out, *faces, "", "\n", "a\n", "a\n\n\n", "1. a", "a\n1. b", "a\n- b", "www.x.com", "a " * 30_000 + "b", "a\n\nb\nc\n\n\n\nd"]


def test_what_is_plain_is_written_by_columns(spark):
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "source_id long, text string").repartition(4)
    t = F.col("text")
    rows = df.select("source_id", X.is_plain(t).alias("plain"), X.plain_html(t).alias("html"), X.plain_nodes(t).alias("nodes")).collect()
    taken = [r for r in rows if r.plain]
    assert len(rows) == len(all_texts) and len(taken) > 1_500
    for r in taken:
        parsed = blocks.parse(all_texts[r.source_id], blocks.Options())
        assert r.html == tree.to_html(parsed.root), repr(all_texts[r.source_id][:200])
        assert r.nodes == sum(1 for _ in parsed.root.walk())
        assert not parsed.references and not parsed.messages and not parsed.footnotes and not any(n.tag[:1] == "h" for n, _ in parsed.root.walk())


@pytest.mark.parametrize("options", [{}, {"documents": True}, {"frontmatter_fence": "word"}])
def test_outputs_are_the_same_either_way(spark, options):
    some = [*texts()[:400], *texts()[-9:-3], texts()[-1], None]
    df = spark.createDataFrame(list(enumerate(some)), "source_id long, text string")
    d, o = DocFrame(df, **options), blocks.Options(**options)
    parsed = {i: blocks.parse(t, o) for i, t in enumerate(some)}
    assert {r.source_id: r.html for r in d.html().collect()} == {i: tree.to_html(p.root) for i, p in parsed.items()}
    assert {r.source_id: (r.bytes, r.nodes) for r in d.stats().collect()} == {i: (len((some[i] or "").encode()), sum(1 for _ in p.root.walk())) for i, p in parsed.items()}
    for wanted in ({}, {"content": True}, {"tags": ["p", "li"]}, {"types": ["text"]}, {"types": ["root", "element"], "content": True}, {"tags": ["h1"]}, {"depth": 0}, {"depth": 1}, {"depth": 2, "types": ["text"]}):
        got = d.nodes(**wanted)
        want = [(i, *r) for i, p in parsed.items() for r in _node_rows(p.root, o.documents, *(frozenset(wanted[k]) if k in wanted else None for k in ("tags", "types")), wanted.get("content", False), wanted.get("depth"))]
        plain = lambda r: tuple([tuple(p) for p in v] if isinstance(v, list) else v for v in r)
        assert sorted(map(plain, got.collect()), key=lambda r: r[:2]) == sorted(map(plain, want), key=lambda r: r[:2]), wanted
    assert d.messages().count() == sum(len(p.messages) for p in parsed.values())
    assert d.references().count() == sum(len(p.references) for p in parsed.values())


def test_values(spark):
    rows = [(1, '{"a":[1,[true,{"b":"x.y"}]],"c":null,"d":{},"e":1.5}'), (2, "[]"), (3, None), (4, '"s"'), (5, "no json"), (6, '{"a":{"b":{"c":1}}}')]
    df = spark.createDataFrame(rows, "source_id long, json string")
    got = {(r.source_id, r.path): (r.type, r.value) for r in V.flatten(df, "json").collect()}
    want = {(1, "$.a[0]"): ("BIGINT", "1"), (1, "$.a[1][0]"): ("BOOLEAN", "true"), (1, "$.a[1][1].b"): ("STRING", "x.y"), (1, "$.c"): ("VOID", None), (1, "$.d"): ("OBJECT", "{}"), (1, "$.e"): ("DECIMAL", "1.5"), (2, "$"): ("ARRAY", "[]"), (4, "$"): ("STRING", "s"), (6, "$.a.b.c"): ("BIGINT", "1")}
    assert got == want
    assert {(r.path, r.value) for r in V.flatten(df.where("source_id = 6"), "json", 2).collect()} == {("$.a.b", '{"c":1}')}
    j = F.col("json")
    got = df.select("source_id", V.count(j).alias("n"), V.key(j, 1).alias("k"), V.get(j, "e").alias("e"), V.at(j, 0).alias("first")).orderBy("source_id").collect()
    assert [tuple(r)[1:] for r in got] == [(4, "c", "1.5", None), (0, None, None, None), (None,) * 4, (0, None, None, None), (0, None, None, None), (1, None, None, None)]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "user12", 3), (1, "user1", 1), (1, "user12", 0), (2, None, 0), (2, "x", 1), (3, "a", 0), (3, "b", 0)], "k int, name string, at int").repartition(5)
    assert {r.k: r.prefix for r in R.common_prefix(df, "k", "name").collect()} == {1: "user1", 2: "x", 3: ""}
    assert {r.k: r.names for r in R.ordered_distinct(df.where("name IS NOT NULL"), "k", "name", "at").collect()} == {1: ["user12", "user1"], 2: ["x"], 3: ["a", "b"]}
    names = spark.range(200_000).selectExpr("id % 7 AS day", "concat('n', id % 50000) AS name")
    whole = R.merged_sketches(R.name_sketches(names, F.col("day")).withColumn("all", F.lit(1)), "all").first().names
    assert abs(whole - 50_000) < 0.05 * 50_000
    assert R.common_prefix(df.limit(0), "k", "name").count() == 0


def test_sketches_are_within_the_error_asked_for(spark):
    names = spark.range(300_000).select((F.col("id") % 60).alias("day"), F.concat(F.lit("user"), F.col("id")).alias("name"))
    off = F.abs(F.col("names") / 5_000 - 1)
    assert R.merged_sketches(R.name_sketches(names, F.col("day")), "day").where(off > 0.03).count() == 0
    assert R.merged_sketches(R.name_sketches(names, F.col("day"), within=0.1), "day").where(off > 0.1).count() == 0


def test_names_that_stand_under_several_keys(spark, tmp_path):
    """Names are counted, not keys: a table repeated with shifted keys has no more of them. Any name counts."""
    from folio.plans import features  # noqa: F401  adds its queries to the catalog
    from folio.plans.catalog import QUERIES

    name = "CASE id % 500 WHEN 0 THEN '' WHEN 1 THEN '#a b' WHEN 2 THEN '#a' WHEN 3 THEN NULL ELSE concat('Customer#', id % 500) END"
    customer = spark.range(3_000).selectExpr("id + 10000 * (id DIV 500) c_custkey", f"{name} c_name", "cast(id % 2 as int) c_nationkey", "'x' c_mktsegment")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (0, 'A', 7), (1, 'B', 7) t(n_nationkey, n_name, n_regionkey)").write.parquet(f"{tmp_path}/nation.parquet")
    assert [tuple(r) for r in QUERIES["tag_sketches"](spark, str(tmp_path)).collect()] == [(7, 499, True)]
