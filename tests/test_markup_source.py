"""The markup data source: a folder read, filtered, written, and nothing left of failed jobs."""

import pytest
from pyspark.sql import functions as F

from folio.operators.documents import DocFrame
from folio.sources.markup import _Reader, register


@pytest.fixture
def source(spark):
    register(spark)
    return spark


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "in"
    for name, text in {"a.txt": "= A\n#x", "sub/b.txt": "one\n---\ntwo\n---\n", "sub/c.txt": "", "d.md": "# d", "_hidden/e.txt": "no", "bad.txt": None}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x\xffy" if text is None else text.encode())
    return str(base)


def read(spark, folder, **options):
    r = spark.read.format("markup").option("path", folder)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_read(source, folder):
    got = {(r.source_id, r.document): r.text for r in read(source, folder, glob="*.txt", documents="true").collect()}
    assert got == {("a.txt", 0): "= A\n#x", ("sub/b.txt", 0): "one\n", ("sub/b.txt", 1): "two\n", ("sub/c.txt", 0): "", ("bad.txt", 0): "x\ufffdy"}
    assert read(source, folder).count() == 5
    assert read(source, folder, split="1").rdd.getNumPartitions() == 5 and read(source, folder).rdd.getNumPartitions() == 1
    assert read(source, folder, glob="none").count() == 0


def test_filters_choose_files(source, folder):
    df = read(source, folder, documents="true", split="1")
    for where, n in (("source_id = 'sub/b.txt'", 2), ("source_id = 'sub/b.txt' AND document = 1", 1), ("source_id IN ('a.txt', 'd.md', 'z')", 2), ("source_id LIKE 'sub/%'", 3), ("document = 1", 1), ("source_id LIKE '%.md'", 1), ("text = 'one\n'", 1)):
        assert df.where(where).count() == n, where
    assert df.where("source_id IN ('a.txt', 'd.md')").rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        _Reader({})


def test_a_folder_comes_back(source, folder, tmp_path):
    out = str(tmp_path / "out")
    html = DocFrame(read(source, folder, glob="*.txt")).html()
    html.repartition(3).write.format("markup").option("path", out).option("suffix", ".html").mode("append").save()
    back = {r.source_id: r.text for r in read(source, out).collect()}
    assert back == {r.source_id + ".html": r.html for r in html.collect()} and (tmp_path / "out" / "sub" / "b.txt.html").exists()
    with pytest.raises(Exception, match="there already"):
        html.write.format("markup").option("path", out).option("suffix", ".html").mode("append").save()
    html.withColumn("html", F.lit("new")).write.format("markup").option("path", out).option("suffix", ".html").mode("overwrite").save()
    assert {r.text for r in read(source, out).collect()} == {"new"}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []


@pytest.mark.parametrize("rows", [[("ok", "x"), ("../up", "y")], [("ok", "x"), (None, "y")], [("same", "x"), ("same", "y")]])
def test_failed_jobs_leave_nothing(source, tmp_path, rows):
    df = source.createDataFrame(rows, "source_id string, text string").repartition(2)
    with pytest.raises(Exception):
        df.write.format("markup").option("path", str(tmp_path / "out")).mode("append").save()
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_empty_texts_and_tables(source, tmp_path):
    out = str(tmp_path / "out")
    df = source.createDataFrame([("a", None), ("b/c", "")], "source_id string, text string")
    df.write.format("markup").option("path", out).mode("append").save()
    assert {(r.source_id, r.text) for r in read(source, out).collect()} == {("a", ""), ("b/c", "")}
    df.limit(0).write.format("markup").option("path", out).mode("append").save()
    with pytest.raises(Exception, match="columns"):
        df.select("text").write.format("markup").option("path", out).mode("append").save()
