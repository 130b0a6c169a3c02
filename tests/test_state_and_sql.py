"""Streaming state, sessions, and table functions in SQL text."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import sql
from folio.operators.documents import DocFrame
from folio.streaming.state import CHANGES, edit_sessions, reference_changes, use_state_store

T0 = datetime.datetime(2024, 1, 1)
at = lambda m: T0 + datetime.timedelta(minutes=m)


def replay(spark, tmp_path, batches, keep_ms=None):
    """The changes of a stream that gets one batch of versions after the other."""
    use_state_store(spark)
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "id string, at timestamp, text string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        changes = reference_changes(spark.readStream.schema(schema).parquet(str(src)), "text", "id", "at", keep_ms)
        w = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
        if keep_ms is None:
            w.trigger(availableNow=True).start().awaitTermination(120)
        else:  # runs on, since states may end without new rows
            q = w.start()
            for _ in range(120):
                if any(p["numInputRows"] for p in q.recentProgress):
                    break
                time.sleep(0.5)
            q.stop()
    order = ["version", "source_id", F.desc("added"), "kind", "name"]
    return [tuple(r) for r in spark.read.schema(CHANGES).parquet(out).orderBy(*order).collect()]


def test_what_versions_add_and_withdraw(spark, tmp_path):
    batches = [
        [("a", at(0), "#x #y"), ("b", at(0), "@u"), ("a", at(1), "#x #z [[Page]]")],
        [("a", at(3), "none"), ("b", at(0), "@u @v"), ("c", at(5), None)],
        [("a", at(2), "#late"), ("a", at(4), "#x"), ("b", at(9), "@v #x")],
    ]
    changes = replay(spark, tmp_path, batches)
    assert [c[2:] for c in changes if c[0] == "a" and c[1] == at(1)] == [("link", "page", True), ("tag", "z", True), ("tag", "y", False)]
    assert not any(c[3] == "late" for c in changes) and not any(c[0] == "c" for c in changes)
    left = {}
    for s, _, kind, name, added in changes:
        left[s, kind, name] = left.get((s, kind, name), 0) + (1 if added else -1)
    assert set(left.values()) <= {0, 1}
    assert {k for k, n in left.items() if n} == {("a", "tag", "x"), ("b", "mention", "v"), ("b", "tag", "x")}


def test_a_time_to_live(spark, tmp_path):
    changes = replay(spark, tmp_path, [[("a", at(0), "#x")], [("a", at(1), "#x")]], keep_ms=1)
    assert [c[3:] for c in changes] == [("x", True), ("x", True)]  # forgotten meanwhile


def test_sessions(spark):
    rows = [("a", at(m)) for m in (0, 10, 45, 100)] + [("b", at(5))]
    got = {(r.source_id, r.start): (r.end, r.versions) for r in edit_sessions(spark.createDataFrame(rows, "id string, at timestamp"), "id", "at").collect()}
    assert got == {("a", at(0)): (at(40), 2), ("a", at(45)): (at(75), 1), ("a", at(100)): (at(130), 1), ("b", at(5)): (at(35), 1)}


def test_sessions_of_equal_times(spark):
    """Versions of one time are in one session, and a pause as long as the gap doesn't end it."""
    rows = [("a", at(m)) for m in (0, 0, 40, 40, 40, 70, 70)]
    got = {r.start: (r.end, r.versions) for r in edit_sessions(spark.createDataFrame(rows, "id string, at timestamp").repartition(3), "id", "at").collect()}
    assert got == {at(0): (at(30), 2), at(40): (at(100), 5)}


@pytest.fixture(scope="module")
def notes(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "= Head\n#a @b http://x.example/y"), (2, None), (3, "k: [1, 2]"), (3, "#a\n== Sub")], "id long, body string").createOrReplaceTempView("notes")
    return spark


def test_table_functions(notes):
    rows = lambda q: sorted(map(tuple, notes.sql(q).collect()), key=str)
    assert rows("SELECT source_id, kind, name FROM markup_references(TABLE(notes))") == [("1", "mention", "b"), ("1", "tag", "a"), ("3", "tag", "a")]
    assert rows("SELECT source_id, level, title FROM markup_headings(TABLE(SELECT id, body FROM notes WHERE id < 3))") == [("1", 1, "Head")]
    assert rows("WITH r AS (SELECT * FROM markup_references(TABLE(notes) PARTITION BY id)) SELECT name, count(DISTINCT source_id) FROM r GROUP BY name") == [("a", 2), ("b", 1)]
    assert rows("SELECT url FROM markup_links(TABLE(notes))") == [("http://x.example/y",)]
    assert rows("SELECT json FROM yaml_values(TABLE(SELECT id, body FROM notes WHERE body LIKE 'k:%'))") == [('{"k":[1,2]}',)]
    want = DocFrame(notes.table("notes"), "body", "id")
    assert rows("SELECT source_id, html FROM markup_html(TABLE(notes))") == sorted(((str(r.source_id), r.html) for r in want.html().collect()), key=str)
    assert rows("SELECT source_id, node_id, depth, tag FROM markup_nodes(TABLE(notes))") == sorted(((str(r.source_id), r.node_id, r.depth, r.tag) for r in want.nodes().collect()), key=str)
    assert notes.sql("SELECT * FROM markup_html(TABLE(SELECT * FROM notes WHERE false))").count() == 0
