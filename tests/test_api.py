"""Sources, streams, the entry point, and edge cases of DocFrame."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from folio.operators.documents import DocFrame
from folio.sources.files import read_sources, read_texts, write_outputs
from folio.streaming.stream import stream_references, windowed_tags

ROOT = Path(__file__).resolve().parent.parent


def test_files(spark, tmp_path):
    (tmp_path / "a.note").write_text("= A\n#x", encoding="utf8")
    (tmp_path / "b.note").write_text("b ** c", encoding="utf8")
    for read in (lambda: read_sources(spark, str(tmp_path), "*.note"), lambda: read_texts(spark, str(tmp_path))):
        html = {Path(r.source_id).name: r.html for r in DocFrame(read()).html().collect()}
        assert html == {"a.note": '<h1 id="a">A</h1><p><a href="/tags/x">#x</a></p>', "b.note": "<p>b <strong> c</strong></p>"}
    write_outputs(DocFrame(read_texts(spark, str(tmp_path))).html(), str(tmp_path / "out"), "html")
    assert spark.read.option("lineSep", "\x00").text(str(tmp_path / "out")).count() == 2


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "#t"), (4, "x " * 50_000), (4, "x")], "source_id long, text string")
    d = DocFrame(df)
    assert d.html().count() == d.json().count() == d.yaml().count() == d.script().count() == d.stats().count() == 5
    assert d.references().collect()[0].source_id is None
    assert d.nodes().where("source_id = 1").count() == 1
    assert d.nodes().where("type = 'root'").count() == 5
    empty = DocFrame(df.limit(0))
    assert empty.nodes().count() == empty.messages().count() == 0
    assert set(d.nodes().columns) >= {"node_id", "parent_id", "ordinal", "depth", "props", "end_column"}


def test_node_rows_are_dense(spark):
    df = spark.createDataFrame([("k", "- a\n  - b **c**\n\n= h")], "source_id string, text string")
    rows = DocFrame(df).nodes().orderBy("node_id").collect()
    assert [r.node_id for r in rows] == list(range(len(rows)))
    assert all(r.parent_id < r.node_id for r in rows[1:])


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    df = spark.createDataFrame([(1, "#a @b", "2024-01-01 00:00:00"), (2, "#a", "2024-01-01 00:03:00")], "id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.mode("overwrite").parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = stream_references(stream, "text", "id").writeStream.format("memory").queryName("refs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert spark.table("refs").count() == 3
    q = windowed_tags(stream, "text", "ts").writeStream.format("memory").outputMode("complete").queryName("tags").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert [(r.tag, r.n) for r in spark.table("tags").collect()] == [("a", 2)]


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'refs_by_tag' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=60)


def test_command_line(tmp_path, capsys):
    import pytest

    from folio.__main__ import main

    f = tmp_path / "a.txt"
    f.write_text("+++\nt: 1\n+++\n= A\n#x <b\n% y", encoding="utf8")
    assert main(["--html", str(f)]) == 0
    assert capsys.readouterr().out == '<h1 id="a">A</h1><p><a href="/tags/x">#x</a> &#x3C;b % y</p>\n'
    main(["--messages", str(f)])
    assert capsys.readouterr().out.split("\n")[:2] == ["front matter 1-3: t: 1", "reference 0:tag:x"]
    main(["--script", str(f)])
    assert capsys.readouterr().out.startswith("const __out = []\n")
    with pytest.raises(SystemExit) as e:
        main(["--nothing"])
    assert e.value.code == 2


def test_long_address_is_whole(spark, tmp_path):
    from folio.plans.catalog import QUERIES

    address = "a" * 1500 + "@example.com"
    spark.createDataFrame([(1, f"write to {address} today")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.address for r in QUERIES["emails"](spark, str(tmp_path)).collect()] == [address]


def test_addresses_in_any_text(spark, tmp_path):
    """Addresses beside signs, in comments, elements and code, by hundreds, and in long runs without any: as the SQL finds them."""
    import random

    import duckdb

    from folio.plans.catalog import ORACLE, QUERIES

    rng = random.Random(4)
    bits = ["ab.c", "X9", "@", "@", ".", ".com", ".de$", "mail.ex", "|", "<", ">", "# ", "**", "``", "_", "-", " ", "\n", "\n    ", "é", "[[", "$", ":", "+++\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(2, 24))) for _ in range(3_000)]
    texts += ["# a@b.com", "<x a@b.com", "``a@b.com``", "a@b.com|", "a@b.comX.y@c.de", "- a@b.com\n" * 700, "a@b.com " * 700, None, "", "x" * 1_000_000 + " a@b.com", "a@b" + ".c" * 200_000, "a." * 500_000 + "@"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["emails"](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(ORACLE["emails"]).fetchall())


def test_ids_and_narrow_outputs(spark):
    """Ids beyond 2 ** 53 beside null keep their digits; narrow outputs agree with filters on the whole."""
    rows = [(2**60 + 1, "= Bed\n\n- hoe **now**\n- http://a.example/x"), (None, "see mail@b.example"), (2**60 + 3, None), (5, "")]
    docs = DocFrame(spark.createDataFrame(rows, "source_id long, text string").coalesce(1))
    assert sorted(str(r.source_id) for r in docs.html().collect()) == sorted(str(i) for i, _ in rows)
    assert {(r.source_id, r.url, r.start, r.end, r.mailto) for r in docs.links().collect()} == {(2**60 + 1, "http://a.example/x", 23, 41, False), (None, "mail@b.example", 4, 18, True)}
    every = [r.asDict() for r in docs.nodes().collect()]
    assert sorted(map(str, every)) == sorted(map(str, [r for t in ("root", "element", "text") for r in (x.asDict() for x in docs.nodes(types=[t]).collect())]))
    items = docs.nodes(tags=["li", "strong"], content=True).collect()
    assert [(r.tag, r.content) for r in items] == [("li", "hoe now"), ("strong", "now"), ("li", "http://a.example/x")]
    assert [r.n for r in docs.apply(lambda root: [(sum(1 for _ in root.walk()),)], "n long").collect()] == [sum(1 for r in every if r["source_id"] == i) for i, _ in rows]


def test_shortcodes_reach_the_workers(spark):
    docs = DocFrame(spark.createDataFrame([(1, ":spade: :dog:")], "source_id long, text string"), shortcodes={"spade": "S"})
    assert docs.nodes(types=["text"]).first().value == "S 🐶"


def test_deep_and_long_sources_end_no_job(spark):
    texts = [" " * 3000 + "x", "\n".join(" " * (2 * i) + "- x" for i in range(500)), "9" * 5000 + ". x", "a: " + "9" * 5000]
    docs = DocFrame(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string"))
    assert docs.html().count() == docs.json().count() == docs.stats().count() == docs.yaml().count() == 4
    assert docs.references().count() == 0 and docs.nodes().where("tag = 'ul'").count() == 500


def test_element_counts(spark):
    """As many as node rows, without a row for each; deep steps cost no more than shallow ones."""
    texts = ["= Bed\n\n- hoe **now**\n    - a\n      x", " " * 40 + "x\n" + " " * 47 + "y", "\t<td>\n\t\t    z", "", None, "Plain words.\n\nMore words, two\nlines.", "<script>\n  x"]
    docs = DocFrame(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string"))
    want = {(r.source_id, r.tag): r["count"] for r in docs.nodes(types=["element"]).groupBy("source_id", "tag").count().collect()}
    assert {(r.source_id, r.tag): r.n for r in docs.element_counts().collect()} == want
    assert {(r.source_id, r.tag): r.n for r in docs.element_counts(["div", "p"]).collect()} == {k: n for k, n in want.items() if k[1] in ("div", "p")}
    deep = DocFrame(spark.createDataFrame([(1, " " * 2_000_000 + "x")], "source_id long, text string"))
    assert [tuple(r) for r in deep.element_counts(["div"]).collect()] == [(1, "div", 1_000_000)]


def test_link_counts(spark, tmp_path):
    """As many as rows of links, without a row for each, and no shuffle to count them."""
    from folio.plans.catalog import QUERIES

    texts = ["http://a.example/ b@c.example //d.example/x " * k for k in range(4)] + [None, "plain", "http:// a"]
    docs = DocFrame(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string"))
    want = {r.source_id: r["count"] for r in docs.links().groupBy("source_id").count().collect()}
    assert {r.source_id: r.n for r in docs.link_counts().collect()} == want == {1: 3, 2: 6, 3: 9}
    spark.range(3).selectExpr("id s_suppkey", "cast(id AS int) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["many_links"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(0, 900), (1, 901), (2, 902)]
    assert "HashAggregate" not in got._jdf.queryExecution().toString()


def test_sources_of_a_small_file_are_dealt_out(spark, tmp_path):
    """A file of few bytes holds many rows; its scan is one task, its texts are written and parsed in many."""
    from folio.plans import features  # noqa: F401  adds its queries to the catalog
    from folio.plans.catalog import QUERIES

    part = spark.range(400).selectExpr("id p_partkey", "'a b' p_name", "'B' p_brand", "cast(id % 50 + 1 as int) p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("deep_indentation", "markdown_lists", "yaml_folding", "markdown_breaks_and_html"):
        used = QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
        assert used >= 2 * spark.sparkContext.defaultParallelism, name


def test_texts_of_customers_and_suppliers_are_dealt_out(spark, tmp_path):
    """As those of parts: one task of the scan, many tasks of the kernel, and the whole result."""
    from folio.plans.catalog import QUERIES

    spark.range(400).selectExpr("id c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id s_suppkey", "cast(id % 9 AS int) s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("markdown_quotes", "many_links"):
        got = QUERIES[name](spark, str(tmp_path))
        assert got.count() == 400
        assert got.select(F.spark_partition_id()).distinct().count() >= 2 * spark.sparkContext.defaultParallelism, name
