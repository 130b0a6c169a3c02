"""More queries over generated markup: SQL text, files written and read, streams with state, sketches, values, and rules of single elements and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..kernels import vocab
from ..operators import relational as R
from ..operators import sql
from ..operators.documents import DocFrame
from ..sources import markup
from ..sources.files import scratch_folder
from ..streaming.state import CHANGES, edit_sessions, reference_changes, use_state_store
from .catalog import _NATION_SQL, ORACLE, _by_nation, _customer_lists, _nation_key, _one, _parts, _s, _table, _written, query

# --- SQL text ---------------------------------------------------------------------------


@query(ORACLE["refs_by_tag"])
def sql_references(spark, d):
    """A table function over a query, inside a CTE."""
    sql.register(spark)
    return spark.sql(
        """WITH r AS (SELECT source_id, kind, name FROM markup_references(TABLE(SELECT source_id, text FROM {t})))
        SELECT kind, name, count(DISTINCT source_id) AS sources FROM r WHERE kind = 'tag' GROUP BY kind, name""",
        t=_by_nation(spark, d),
    )


@query(f"SELECT {_NATION_SQL}::BIGINT AS source_id, 'C' || min(c_custkey) AS title, count(*)::BIGINT AS links FROM customer GROUP BY 1")
def sql_headings_and_links(spark, d):
    """Two table functions joined, one of them over a table partitioned by a key."""
    sql.register(spark)
    lines = _written(_table(spark, d, "customer"), _nation_key(), "c_custkey", _s("http://x", "@c_custkey", ".example"))
    first = _table(spark, d, "customer").groupBy(_nation_key().alias("source_id")).agg(F.min("c_custkey").alias("first"))
    texts = lines.join(first, "source_id").select("source_id", F.concat(_s("= C", "@first", "\n\n"), "text").alias("text"))
    return spark.sql(
        """SELECT CAST(h.source_id AS BIGINT) AS source_id, h.title, count(*) AS links
        FROM markup_headings(TABLE({t}) PARTITION BY source_id) h JOIN markup_links(TABLE({t})) l ON h.source_id = l.source_id GROUP BY h.source_id, h.title""",
        t=texts,
    )


@query("SELECT p_partkey AS source_id, '{\"name\":\"' || p_name || '\",\"sizes\":[' || p_size || ',0]}' AS json FROM part WHERE p_size % 2 = 0")
def sql_yaml(spark, d):
    """YAML read by a table function, filtered by what SQL makes of its JSON."""
    sql.register(spark)
    x = _one(_parts(spark, d), "p_partkey", _s("name: ", "@p_name", "\nsizes: [", "@p_size", ", 0]"))
    return spark.sql("SELECT CAST(source_id AS BIGINT) AS source_id, json FROM yaml_values(TABLE({t})) WHERE CAST(get_json_object(json, '$.sizes[0]') AS INT) % 2 = 0", t=x)


# --- files and streams --------------------------------------------------------------------


@query(ORACLE["nodes_to_html"])
def folder_round_trip(spark, d):
    """HTML written as one file per source, and the folder read again."""
    markup.register(spark)
    out = scratch_folder(spark)
    html = DocFrame(_customer_lists(spark, d)).html()
    html.select(F.col("source_id").cast("string").alias("source_id"), "html").write.format("markup").option("path", out).option("suffix", ".html").mode("append").save()
    back = spark.read.format("markup").option("path", out).load()
    return back.select(F.regexp_extract("source_id", r"^(\d+)\.html$", 1).cast("long").alias("source_id"), F.col("text").alias("html"))


@query("SELECT s_suppkey::VARCHAR AS source_id, v::INT AS version, 't' || (s_suppkey + v - g) % 3 AS name, g = 0 AS added FROM supplier, range(0, 3) a(v), range(0, 2) b(g) WHERE v >= g UNION ALL SELECT s_suppkey::VARCHAR, 0, 's', true FROM supplier")
def reference_changes_of_versions(spark, d):
    """A stream with state: three versions of each source, and what each adds and withdraws."""
    use_state_store(spark)
    s = _table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    versions = s.select(F.col("s_suppkey").alias("id"), (start + F.make_interval(hours=F.col("v"))).alias("at"), F.concat(F.lit("#s #t"), (F.col("s_suppkey") + F.col("v")) % 3).alias("text"))
    folder = scratch_folder(spark)
    versions.write.parquet(f"{folder}/in")
    changes = reference_changes(spark.readStream.schema(versions.schema).parquet(f"{folder}/in"), "text", "id", "at")
    run = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(CHANGES).parquet(f"{folder}/out")
    return got.select("source_id", F.hour("version").alias("version"), "name", "added")


@query(
    """WITH x AS (SELECT o_custkey, o_orderdate::TIMESTAMP AS t FROM orders), y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t) <= INTERVAL 30 DAY THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM y)
SELECT o_custkey AS source_id, strftime(min(t), '%Y-%m-%d') AS first_day, count(*)::BIGINT AS versions FROM z GROUP BY o_custkey, s"""
)
def sessions_of_edits(spark, d):
    """Session windows: a customer's orders as edits of one source, 30 days apart at most."""
    o = _table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return edit_sessions(o, "o_custkey", "at", "30 days", "1 day").select("source_id", F.date_format("start", "yyyy-MM-dd").alias("first_day"), "versions")


# --- aggregates ------------------------------------------------------------------------------


@query("SELECT n_regionkey, count(DISTINCT c_name)::BIGINT AS exact, true AS near FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def tag_sketches(spark, d):
    """Distinct names from sketches: one per nation, kept, then merged by region; within 3 per cent of the exact number.

    A name is written as its bytes' digits, since equal names may stand under several keys and hold what ends a mention.
    """
    c = _table(spark, d, "customer").join(F.broadcast(_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.struct(F.col("c_nationkey").alias("nation"), F.expr("c_custkey DIV 1000").alias("block"))
    names = DocFrame(_written(c, key, "c_custkey", F.concat(F.lit("- @n"), F.hex("c_name")))).references().where("kind = 'mention'")
    daily = R.name_sketches(names, F.col("source_id")["nation"].alias("n_nationkey"), within=0.03)
    merged = R.merged_sketches(daily.join(F.broadcast(_table(spark, d, "nation")), "n_nationkey"), "n_regionkey")
    exact = c.groupBy("n_regionkey").agg(F.countDistinct("c_name").alias("exact"))
    off = F.abs(F.coalesce("names", F.lit(0)) - F.col("exact"))
    return exact.join(merged, "n_regionkey", "left").select("n_regionkey", "exact", (off <= 0.03 * F.col("exact")).alias("near"))


@query(
    f"""WITH f AS (SELECT {_NATION_SQL}::BIGINT AS source_id, c_mktsegment AS name, min(c_custkey) AS k FROM customer GROUP BY 1, 2)
SELECT source_id, string_agg(name, ' ' ORDER BY k) AS names FROM f GROUP BY source_id"""
)
def names_in_order(spark, d):
    """Distinct names of a source in the order of first appearance, as an aggregate in two phases."""
    refs = DocFrame(_by_nation(spark, d)).references().where("kind = 'tag'")
    return R.ordered_distinct(refs, "source_id", "name", "ord").select("source_id", F.array_join("names", " ").alias("names"))


@query(
    f"""WITH x AS (SELECT {_NATION_SQL}::BIGINT AS source_id, min('user' || c_custkey) AS lo, max('user' || c_custkey) AS hi FROM customer GROUP BY 1)
SELECT source_id, left(lo, (SELECT max(i) FROM range(0, 20) t(i) WHERE left(lo, i::INT) = left(hi, i::INT))::INT) AS prefix FROM x"""
)
def common_prefixes(spark, d):
    """An aggregate of the user's own over Arrow batches, pre-aggregated where the names are found."""
    refs = DocFrame(_by_nation(spark, d)).references().where("kind = 'mention'")
    return R.common_prefix(refs, "source_id", "name").select("source_id", "prefix")


# --- values ----------------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS source_id, u.path, u.type, u.value FROM part, LATERAL (VALUES ('$.name', 'STRING', p_name), ('$.sizes[0]', 'BIGINT', p_size::VARCHAR), ('$.sizes[1][0]', 'BOOLEAN', 'true'),
 ('$.sizes[1][1].brand', 'STRING', p_brand), ('$.none', 'VOID', NULL), ('$.empty', 'ARRAY', '[]')) u(path, type, value)"""
)
def yaml_flattened(spark, d):
    """Nested sequences and mappings as rows of path, type and value."""
    x = _one(_parts(spark, d), "p_partkey", _s("name: ", "@p_name", "\nsizes:\n- ", "@p_size", "\n- - true\n  - {brand: '", "@p_brand", "'}\nnone:\nempty: []"))
    return V.flatten(DocFrame(x).yaml(), "json")


@query("SELECT p_partkey AS source_id, 3::BIGINT AS members, 'sizes' AS second_key, p_name AS name, (p_size % 4 + 1)::BIGINT AS sizes, '0' AS first_size, CASE WHEN p_size % 4 >= 2 THEN '2' END AS third_size FROM part")
def yaml_accessors(spark, d):
    """Count, at, key and get."""
    sizes = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int")), lambda i: i.cast("string")), ", ")
    x = DocFrame(_one(_parts(spark, d), "p_partkey", F.concat(_s("name: ", "@p_name", "\nsizes: ["), sizes, F.lit("]\nz: 1")))).yaml()
    j, s = F.col("json"), V.get(F.col("json"), "sizes")
    return x.select("source_id", V.count(j).alias("members"), V.key(j, 1).alias("second_key"), V.get(j, "name").alias("name"), V.count(s).alias("sizes"), V.at(s, 0).alias("first_size"), V.at(s, 2).alias("third_size"))


@query("SELECT p_partkey AS source_id, '{\"a\":\"' || p_name || ' two three\",\"b\":' || p_size || ',\"c\":\"it''s\",\"d\":\"x\\n ' || p_brand || '\\n\"}' AS json FROM part")
def yaml_folding(spark, d):
    """Plain scalars over lines, comments, doubled quotes, block scalars, and a leading separator."""
    x = _one(_parts(spark, d), "p_partkey", _s("---\na: ", "@p_name", "\n  two\n  three\n# note\nb: ", "@p_size", " # size\nc: 'it''s'\nd: |\n  x\n   ", "@p_brand"))
    return DocFrame(x).yaml().select("source_id", "json")


@query("SELECT p_partkey AS source_id, error FROM part, LATERAL (SELECT CASE p_partkey % 2 WHEN 0 THEN 'line 2: more than one document in a stream is not supported' END AS error)")
def yaml_streams_refused(spark, d):
    """A second document in a stream is refused; an end without one isn't written here."""
    x = _one(_parts(spark, d), "p_partkey", F.concat(_s("a: ", "@p_size"), F.when(F.col("p_partkey") % 2 == 0, F.lit("\n...\nx")).otherwise(F.lit(""))))
    return DocFrame(x).yaml().select("source_id", "error")


# --- elements, links, lines: single rules ------------------------------------------------------


def _html(spark, d, *parts, **options):
    return DocFrame(_one(_parts(spark, d), "p_partkey", _s(*parts)), **options).html()


@query("SELECT p_partkey AS source_id, '<div class=\"a ' || p_container || '\">' || chr(10) || '<p>' || p_name || '</p>' || chr(10) || '</div><p>out</p>' AS html FROM (SELECT p_partkey, p_name, 'b' || p_size AS p_container FROM part)")
def element_children(spark, d):
    """A class list with several blanks and tabs; children by indentation, up to the first line that isn't."""
    return _html(spark, d, '<div class="a  \tb', "@p_size", '">\n  ', "@p_name", "\nout")


@query("SELECT p_partkey AS source_id, '<div hidden title=\"' || p_name || '\" lang=\"en\">tail ' || p_brand || '</div>' AS html FROM part")
def element_tails(spark, d):
    """Content on the opener's line; attributes without a value, quoted and bare."""
    return _html(spark, d, '<div hidden title="', "@p_name", '" lang=en> tail ', "@p_brand")


@query("SELECT p_partkey AS source_id, '<td headers=\"a b\" colspan=\"' || p_size || '\">x</td>' AS html FROM part")
def attribute_lists(spark, d):
    """Lists and numbers as attributes."""
    return _html(spark, d, '<td headers="a b" colspan=', "@p_size", ">x")


@query("SELECT p_partkey AS source_id, i::INT AS ord, CASE i WHEN 0 THEN 'http://a' || p_partkey || '.example' WHEN 1 THEN '//b.example/p' WHEN 2 THEN 'http://xn--e1afmkfd.xn--p1ai/' || p_size ELSE 'mailto:a@b.com' END AS url FROM part, range(0, 4) t(i)")
def link_ends(spark, d):
    """Links end before closing marks; hosts in Punycode; links without a scheme; addresses."""
    x = _one(_parts(spark, d), "p_partkey", _s("see http://a", "@p_partkey", ".example. (//b.example/p) http://xn--e1afmkfd.xn--p1ai/", "@p_size", ", mailto:a@b.com! x_http://no.example"))
    return DocFrame(x).links().select("source_id", "ord", "url")


@query("SELECT p_partkey AS source_id, x.id, x.number, x.content FROM part, LATERAL (VALUES ('x', 1, 'see [[^y]]'), ('y', 2, p_name)) x(id, number, content)")
def notes_in_notes(spark, d):
    """A note that only another note refers to is numbered after it."""
    x = _one(_parts(spark, d), "p_partkey", _s("a[[^x]] b\n\n[[^y]]: ", "@p_name", "\n[[^x]]: see [[^y]]"))
    return DocFrame(x).footnotes().select("source_id", "id", "number", "content")


@query("SELECT p_partkey AS source_id, '<p>' || p_name || '<br>b<br>c</p>' || chr(10) || '<div>' || chr(10) || p_brand || chr(10) || '</div>' || chr(10) AS html FROM part")
def markdown_breaks_and_html(spark, d):
    """Hard breaks by blanks and by a backslash; raw HTML blocks as they are."""
    return DocFrame(_one(_parts(spark, d), "p_partkey", _s("@p_name", "  \nb\\\nc\n\n<div>\n", "@p_brand", "\n</div>"))).markdown_html()


# --- vocabularies: entries dealt over the rows of a table ---------------------------------------------


def _names(rows: list[tuple[str, str]]) -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in r)) for i, r in enumerate(rows))
    return f"(VALUES {quoted}) t(i, name, want)"


_FACES = sorted(vocab.EMOTICONS.items())
_ATTRIBUTES = sorted((a, p) for p, a in vocab.ATTRIBUTES.items())


def _dealt(spark, d, rows):
    """Each part with one entry."""
    names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "i long, name string")
    return _table(spark, d, "part").join(F.broadcast(names), F.col("p_partkey") % len(rows) == F.col("i"))


@query(f"SELECT p_partkey AS source_id, p_name || ' ' || want || ' now' AS text FROM part JOIN {_names(_FACES)} ON p_partkey % {len(_FACES)} = i")
def emoticons(spark, d):
    """Every emoticon between words of a part's name."""
    return DocFrame(_one(_dealt(spark, d, _FACES), "p_partkey", _s("@p_name", " ", "@name", " now"))).nodes(tags=["p"], content=True).select("source_id", F.col("content").alias("text"))


@query(f"SELECT p_partkey AS source_id, want AS property, '<x ' || name AS opener FROM part JOIN {_names(_ATTRIBUTES)} ON p_partkey % {len(_ATTRIBUTES)} = i")
def attribute_properties(spark, d):
    """Every attribute to its property and back to HTML, in one pass over each text."""

    def both(root):
        n = root.children[0]
        yield next(iter(n.props)), f"<x {vocab.attribute_of(next(iter(n.props)))}"

    x = _one(_dealt(spark, d, _ATTRIBUTES), "p_partkey", F.concat(F.lit("<x "), F.upper("name"), _s('="', "@p_name", '">')))
    return DocFrame(x, sanitize=False).apply(both, "property string, opener string")
