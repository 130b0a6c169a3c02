"""Mixing sources to target weights by entropy balancing.

Targets: sources share all words by weight; a target stops at ``cap`` times its source and the excess goes to
the others by weight (water filling, one window over the table of sources). Rates: of all document
rates within [0, cap], those closest to 1 in relative entropy whose words sum to the targets. The convex dual
has one variable per source and the rates are ``min(cap, exp(lambda * size / scale))``; its gradient and Hessian
are sums over a histogram (source, size, documents), so each Newton step is one aggregation and one
join, kept within a bracket that halves where a step leaves it. Rates become whole copies by
systematic rounding along running sums of documents ordered by size.

Sums are taken over rounded decimals and orders are total, so reruns agree to the last row.

Defined cases: null sources are a source of their own, last; empty and null texts have size 0 and take 0
words; sources without words have target 0; rows that repeat an id are documents of their own (rows
equal in all columns are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lookup, staged

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET = 2_000  # documents rounded along one running sum
SHIFTS = 32


def text_size(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, ...) with a column target. One row per source; the windows see that table only, in one task that sorts two numbers and a name for each source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    x = ranked.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("rank", F.row_number().over(fill))
    x = x.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # in order of limit / weight, the first sources stop at their limits; the level of the first that doesn't holds for the rest
    x = x.withColumn("open", F.col("weight") * F.col("level") <= F.col("limit"))
    return x.withColumn("final", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(every)["level"]).withColumn("target", F.least(F.col("limit"), F.col("weight") * F.coalesce("final", F.lit(0.0)))).drop("limit", "rank", "level", "open", "final", "weight")


def _rate(lam: Column, size: Column, scale: Column, cap: float) -> Column:
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), lam * size / scale))))


def balance(hist: DataFrame, goal: DataFrame, cap: float = CAP, tol: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(source, lam, scale) by Newton steps on the dual. hist: source, size, n; goal: source, source_size, n_docs, target."""
    scale = F.greatest(F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)), F.lit(1.0))
    state = staged(goal.select("source", "target", "source_size", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done")))
    exact = lambda c: F.sum(F.round(c * 1e4, 0).cast("decimal(38,0)")).cast("double") / 1e4
    for _ in range(rounds):
        s = state.where(~F.col("done")).withColumnRenamed("source", "_source")
        at = hist.join(s, hist.source.eqNullSafe(s["_source"])).where("size > 0")
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        words = F.col("n") * F.col("size") * rate
        sums = at.groupBy("source").agg(exact(words).alias("got"), exact(F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "_source")
        j = state.join(sums, state.source.eqNullSafe(sums["_source"]), "left").drop("_source")
        gap = F.col("got") - F.col("target")
        done = F.col("done") | F.col("got").isNull() | (F.abs(gap) <= tol * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("target") >= cap * F.col("source_size"))
        j = j.withColumn("lo", F.when(~done & (gap < 0), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(~done & (gap > 0), F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - gap / F.col("slope")
        middle = F.when(F.col("lo") < -1e5, F.col("hi") * 2 - 1).when(F.col("hi") > 1e5, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        lam = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(1e6)).when(done, F.col("lam")).when(inside, step).otherwise(middle)
        state = staged(j.select("source", "target", "source_size", "scale", lam.alias("lam"), "lo", "hi", done.alias("done")))
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds")
    return state.select("source", "lam", "scale")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, source, k1, k2 (hashes of id, source and text), size, source_size, target, rate, copies, taken."""
    cols = [F.col(id_col), F.col(source_col), F.col(text_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), *_key(cols))
    rows = staged(rows)
    hist = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = staged(targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")), weights, cap))
    lam = balance(hist, goal, cap)
    plan = goal.join(lam.withColumnRenamed("source", "_s"), goal.source.eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "n_docs", "lam", "scale")
    spread = F.col("k1")
    x = lookup(rows, plan, ["source"], spread)
    x = x.withColumn("rate", _rate(F.col("lam"), F.col("size"), F.col("scale"), cap))
    x = x.withColumn("_bucket", F.pmod(F.xxhash64("k1"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET))))
    run = Window.partitionBy("source", "_bucket").orderBy("size", "doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("rate").over(run)
    x = staged(x.withColumn("_total", total).withColumn("_before", total - F.col("rate")))
    # the running sums may start anywhere on a grid of SHIFTS; each source takes the start that comes nearest to its target
    grid = lambda c, k: F.floor(F.round(c + (F.lit(k) if isinstance(k, int) else k) / SHIFTS, 9))  # noqa: E731  sums of whole rates stay whole
    copies_at = lambda k: F.least(F.lit(cap), F.greatest(F.lit(0), grid(F.col("_total"), k) - grid(F.col("_before"), k))).cast("long")
    tried = x.groupBy("source").agg(F.first("target").alias("t"), *[F.sum(copies_at(k) * F.col("size")).alias(f"k{k}") for k in range(SHIFTS)])
    best = tried.select("source", F.array_min(F.array(*[F.struct(F.abs(F.col(f"k{k}") - F.col("t")).alias("gap"), F.lit(k).alias("k")) for k in range(SHIFTS)]))["k"].alias("_k"))
    x = lookup(x, best, ["source"], spread)
    copies = copies_at(F.col("_k"))
    return x.withColumn("copies", copies).select("doc_id", "source", "k1", "k2", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _key(cols: list[Column]) -> list[Column]:
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **plan) -> DataFrame:
    """docs with each row as often as the mix takes it, and a column copy (1, 2, ...; with underscores after it where docs has one). Rows not taken are left out.

    Rows equal in id, source and text share their copies out among themselves. One shuffle carries the texts.
    """
    name = "copy"
    while name in docs.columns:
        name += "_"
    per_key = mix(docs, source_col, text_col, id_col, **plan).groupBy("k1", "k2").agg(F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    k1, k2 = _key([F.col(id_col), F.col(source_col), F.col(text_col)])
    # the row travels as one struct, so that its columns' names can't clash with those used here
    keyed = docs.select(F.struct("*").alias("row"), k1, k2)
    taken = per_key.where("_total > 0").withColumnsRenamed({"k1": "p1", "k2": "p2"})
    x = keyed.join(taken, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("_total")))
    x = x.withColumn("times", F.floor(F.col("_total") / F.col("_rows")) + (F.col("place") <= F.col("_total") % F.col("_rows")).cast("int"))
    return x.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*", F.col("copy").alias(name))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "copies", "taken")


QUERIES = {"op7_mixing": op7_mixing}
ORACLE: dict[str, str] = {}
