"""Benchmark decontamination by template canonicalisation. Only built-in functions touch the data.

Texts are lower-cased, stripped of punctuation and cut into tokens; numbers, names (capitalised words inside a sentence)
and units (after a number) become typed placeholders. Windows that hold names are also taken with the names as
plain words, so that a copy in other letter case matches. Windows of ``WIDTH`` tokens are hash-joined
with those of the benchmark's items. Matches are gathered by diagonal (place in the text less place in the item), the
values under matching placeholders are paired, and windows with changed values count only if these form a consistent
replacement (one new value for each value of the item), so a question asked with other numbers or names is caught, and
a text that merely has the same shape is not. A text is contaminated by an item if consistent diagonals hold ``SHARE``
of the item's windows, or any diagonal a stretch of ``RUN`` (where the replacement isn't consistent: of unchanged windows).

The benchmark side is measured: up to ``BROADCAST`` bytes it is broadcast; beyond, both sides are dealt out by hash and a
salt, so that a window that many texts share is no task of its own. Windows with fewer than two plain tokens match by their values only.

Defined cases: null and empty texts match nothing; items of fewer than WIDTH tokens are found in texts that are the item and
nothing else (within other texts they can't be told from chance); repeated rows of an id are one
document; null ids never appear; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table_bytes

WIDTH = 5
SHARE, RUN = 0.5, 9  # 9 windows: 13 tokens
BROADCAST, SALTS = 64_000_000, 16
#: Units that follow a number.
UNITS = "mm cm m km g kg mg l ml s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year percent kb mb gb tb miles mile feet foot inches inch yards pounds pound lbs lb dollars dollar euros euro cents cent eur usd"
NUM, NAME, UNIT = "\x02", "\x01", "\x03"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; numbers, names and units start with a control character.

    Patterns begin with the rarest character they need, and look behind from there.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.translate(t, NUM + NAME + UNIT, "   ")
    digits = F.regexp_replace(t, r"[.,:](?<=[0-9][.,:])(?=[0-9])", "·")
    digits = F.regexp_replace(digits, r"([0-9])(?<![\p{L}\p{N}·][0-9])([0-9·]*)", NUM + "$1$2")
    digits = F.regexp_replace(digits, rf"(?i)({NUM}[0-9·]+\s*)({'|'.join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.when(t.rlike("[0-9]"), digits).otherwise(t)
    t = F.regexp_replace(t, r" (?=\p{Lu})(?<=[\p{Ll}\p{N},;] )", " " + NAME)
    words = F.split(F.lower(t), rf"[^a-z0-9\p{{L}}\p{{N}}·{NUM}{NAME}{UNIT}]+")
    return F.filter(words, lambda w: w != "")


def _typed(w: Column) -> Column:
    return F.when(w < "\x04", F.substring(w, 1, 1)).otherwise(w)


def _cased(w: Column) -> Column:
    """As _typed, but names are words, so that a text matches in any case."""
    return F.when(w >= "\x04", w).when(w.startswith(NAME), F.substring(w, 2, 1_000_000)).otherwise(F.substring(w, 1, 1))


def _bare(w: Column) -> Column:
    """As a value: names are words, numbers and units keep theirs."""
    return F.when(w.startswith(NAME), F.translate(w, NAME, "")).otherwise(w)


def template_windows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, h, kind, w): the hash of each window's template; w: the text's tokens, null if none of them is a slot (see window_slots).

    kind 0: every window; 1: those that hold names, which are words and no slots; 2: those with fewer than two plain
    tokens beside numbers and units, and texts of fewer than WIDTH tokens, hashed by their values.
    """
    # no filter here: it would be moved below, and take the tokens a second time
    x = rows.select(F.col(key), tokens(F.col(text)).alias("w"))
    enough = F.size("w") >= WIDTH
    none = F.expr("CAST(array() AS array<int>)")
    slots = F.filter(F.transform("w", lambda w, i: F.when(w < "\x04", i)), lambda i: i.isNotNull())
    x = x.select(key, "w", F.transform("w", lambda w: F.xxhash64(_typed(w))).alias("t"), slots.alias("slots"))
    last = F.size("t") - WIDTH  # the place of the last window
    token = lambda i: F.element_at("w", i + 1)
    names, bare = F.filter("slots", lambda i: token(i).startswith(NAME)), F.filter("slots", lambda i: ~token(i).startswith(NAME))
    x = x.select(key, "w", "t", F.size("slots").alias("slots"), names.alias("names"), bare.alias("bare"))
    around = F.array_distinct(F.flatten(F.transform("names", lambda i: F.sequence(F.greatest(F.lit(0), i - (WIDTH - 1)), F.least(i, last)))))
    at = lambda j: F.element_at("bare", j)
    most = WIDTH - 1  # so many numbers and units, or more
    full = F.transform(F.sequence(F.lit(1), F.size("bare") - (most - 1)), lambda j: F.when(at(j + most - 1) - at(j) < WIDTH, F.sequence(F.greatest(F.lit(0), at(j + most - 1) - (WIDTH - 1)), F.least(at(j), last))).otherwise(none))
    x = x.select(key, "w", "t", "slots", F.when(enough & (F.size("names") > 0), around).otherwise(none).alias("around"), F.when(enough & (F.size("bare") >= most), F.array_distinct(F.flatten(full))).otherwise(none).alias("full"))
    window = F.transform(F.sequence(F.lit(1), F.size("t") - (WIDTH - 1)), lambda i: F.xxhash64(*[F.element_at("t", i + k) for k in range(WIDTH)]))
    again = lambda c, f: F.transform(c, lambda i: F.xxhash64(*[F.xxhash64(f(token(i + k))) for k in range(WIDTH)]))
    whole = F.array(F.xxhash64(F.lit("whole"), F.translate(F.array_join("w", " "), NAME, "")))
    every = F.when(F.size("w") == 0, F.expr("CAST(array() AS array<bigint>)")).when(~enough, whole).when((F.size("around") == 0) & (F.size("full") == 0), window).otherwise(F.concat(window, again("around", _cased), again("full", _bare)))
    x = x.select(key, F.when(F.col("slots") > 0, F.col("w")).alias("tokens"), F.concat("around", "full").alias("places"), F.greatest(F.lit(0), last + 1).alias("m"), F.size("around").alias("m1"), F.posexplode(every).alias("p", "h"))
    kind = F.when(F.col("m") == 0, 2).when(F.col("p") < F.col("m"), 0).when(F.col("p") < F.col("m") + F.col("m1"), 1).otherwise(2)
    pos = F.when((F.col("m") > 0) & (F.col("p") >= F.col("m")), F.element_at("places", F.col("p") - F.col("m") + 1)).otherwise(F.col("p"))
    return x.select(key, F.col("tokens").alias("w"), pos.alias("pos"), "h", kind.alias("kind"))


def window_slots() -> Column:
    """array<struct<at,value>> of the slots inside a window (w, pos, kind), places from its start; null if the text has none."""
    inside = F.transform(F.slice("w", F.col("pos") + 1, WIDTH), lambda w, i: F.struct(i.alias("at"), w.alias("value")))
    return F.when(F.col("w").isNotNull(), F.filter(inside, lambda s: F.when(F.col("kind") == 0, s["value"] < "\x04").otherwise(F.substring(s["value"], 1, 1).isin(NUM, UNIT))))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, pos, h, slots (of the window), typed, n, n_typed: the item's windows; those of fewer than two plain tokens by their values only.

    typed: whether the window has two plain tokens with names as slots; n: how many places there are; n_typed: of these, typed.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("item_id").isNotNull())
    w = template_windows(rows, "item_id", "text").select("item_id", "pos", "h", "kind", window_slots().alias("slots"))
    w = w.where(F.col("slots").isNull() | (F.size("slots") <= WIDTH - 2) | (F.col("kind") == 2))
    w = w.withColumn("typed", F.max(F.col("kind") == 0).over(Window.partitionBy("item_id", "pos"))).drop("kind")
    return w.join(w.groupBy("item_id").agg(F.countDistinct("pos").alias("n"), F.countDistinct(F.when(F.col("typed"), F.col("pos"))).alias("n_typed")), "item_id")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, longest, n_slots, n_changed) of each contaminated pair."""
    bench = staged(benchmark_windows(items, item_id, item_text).select("item_id", F.col("pos").alias("i_pos"), F.col("h").alias("i_h"), F.col("slots").alias("i_slots"), "typed", F.col("n").alias("n_windows"), "n_typed"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    windows = template_windows(rows, "doc_id", "text")
    if table_bytes(bench) <= BROADCAST:
        hits = windows.join(F.broadcast(bench), F.col("h") == F.col("i_h")).withColumn("slots", window_slots())
    else:
        windows = windows.select("doc_id", "pos", "h", window_slots().alias("slots"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int").alias("salt"))
        salted = bench.withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = windows.join(salted, (F.col("h") == F.col("i_h")) & (F.col("salt") == F.col("i_salt")))
    both = F.zip_with("i_slots", "slots", lambda i, d: F.struct((i["at"] + F.col("i_pos")).alias("at"), i["value"].alias("item"), d["value"].alias("doc")))
    hits = hits.select("doc_id", "item_id", "n_windows", "n_typed", "typed", "i_pos", (F.col("pos") - F.col("i_pos")).alias("diagonal"), F.coalesce(both, F.expr("CAST(array() AS array<struct<at:int,item:string,doc:string>>)")).alias("pairs"))
    hits = hits.withColumn("same", ~F.exists("pairs", lambda p: p["item"] != p["doc"]))
    same, moved = (lambda c: F.when(F.col("same"), c)), (lambda c: F.when(~F.col("same"), c))
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    diagonals = hits.groupBy("doc_id", "item_id", "n_windows", "n_typed", "diagonal").agg(
        F.collect_set("i_pos").alias("at"),
        F.collect_set(F.when(F.col("typed"), F.col("i_pos"))).alias("at_typed"),
        F.collect_set(same(F.col("i_pos"))).alias("at_same"),
        distinct(F.col("pairs")).alias("pairs"),
        distinct(same(F.col("pairs"))).alias("pairs_same"),
        distinct(moved(F.col("pairs"))).alias("moved"),
    )
    # windows with changed values count if each value of the item has one new value; the others hold the item's own words
    fits = F.size(F.array_distinct(F.transform("moved", lambda p: F.struct(p["item"], p["doc"])))) == F.size(F.array_distinct(F.transform("moved", lambda p: p["item"])))
    none = F.expr("CAST(array() AS array<int>)")
    shared = lambda k: F.when(fits, F.col(k)).otherwise(none)
    diagonals = diagonals.select("doc_id", "item_id", "n_windows", "n_typed", shared("at").alias("at_fit"), shared("at_typed").alias("at_typed"), F.when(fits, F.col("at")).otherwise(F.col("at_same")).alias("at"), F.when(fits, F.col("pairs")).otherwise(F.col("pairs_same")).alias("pairs")).where(F.size("at") > 0)
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    # longest stretch of adjacent windows: sorted places less their rank are equal within a stretch
    ranked = F.transform(F.array_sort("at"), lambda p, i: p - i)
    stretch = F.array_max(F.transform(F.array_distinct(ranked), lambda r: F.size(F.filter(ranked, lambda q: q == r))))
    diagonals = diagonals.select("doc_id", "item_id", "n_windows", "n_typed", "at", "at_fit", "at_typed", stretch.alias("stretch"), F.size("pairs").alias("n_slots"), changed.alias("n_changed"))
    places = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(k))))
    whole = diagonals.groupBy("doc_id", "item_id", "n_windows", "n_typed").agg(places("at").alias("n_matched"), places("at_fit").alias("n_matched_fit"), places("at_typed").alias("n_matched_typed"), F.max("stretch").alias("longest"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))
    most = (F.col("n_matched_fit") >= share * F.col("n_windows")) | ((F.col("n_typed") > 0) & (F.col("n_matched_typed") >= share * F.col("n_typed")))
    return whole.where(most | (F.col("longest") >= run)).select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("n_windows", "n_matched", "longest", "n_slots", "n_changed")])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
