"""Shared pieces of the corpus operators: words, shared storage, skew-proof joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: Characters that ``str.split()`` takes for blanks although WORD doesn't.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words of one text; none for null."""
    if not text:
        return []
    if _OTHER_BLANKS.search(text):
        return _WORD.findall(text)
    return text.split()


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def in_small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with texts of about ``most`` bytes, or of one longer text: what is made of a batch stays small beside it."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right")))
            yield b.slice(at, to - at)
            at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z) words of a batch of texts, one after the other, and how many each text has. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, cuts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(words, "")  # blanks at either end leave an empty piece
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return words.filter(full), np.diff(before[cuts - cuts[0]])


def crc_bucket(doc_id, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def crc_mod(col: Column, n: int) -> Column:
    """The same, as a column."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared storage ---------------------------------------------------------

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below the session's checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` or ``setCheckpointDir``; only where neither is set and everything runs in one
    process (tests, notebooks) a temporary one is made. It is removed when the driver ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
            base = "file://" + tempfile.mkdtemp(prefix="folio-")
            sc.setCheckpointDir(base)
        root = _roots[sc.applicationId] = f"{base.rstrip('/')}/folio-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, root)
    return _roots[sc.applicationId]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; the folder then stays for the operator of the cluster
        return


ARROW_ROWS = 500  # whole texts to an Arrow batch: its buffers lie beside the heap, for each task
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame) -> DataFrame:
    """df written once to shared storage and read back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in dfs:
        for file in df.inputFiles()[:1]:
            _drop(df.sparkSession, file.rpartition("/")[0])


def drop_staged(spark: SparkSession) -> None:
    """Remove all that this application staged so far."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        _drop(spark, root)


# --- joins ------------------------------------------------------------------


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of both sides."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def row_bytes(df: DataFrame) -> Column:
    """A bound of what a row of df takes: 16 bytes for a value of fixed size, 16 and its length as text for any other."""
    loose = [c for c, t in df.dtypes if any(k in t for k in ("string", "binary", "array", "map", "struct"))]
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in loose), F.lit(16 * (len(df.columns) + len(loose))))
    return width.cast("long")


def table_bytes(df: DataFrame) -> int:
    """A bound of what all rows of df take."""
    return int(df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, broadcast_bytes: int = 24_000_000, salts: int = 64) -> DataFrame:
    """Left join with a table that has at most one row per key; null keys match null keys.

    ``right`` is staged and measured. Up to ``broadcast_bytes`` (texts as long as they are, 16 bytes for any other value) it is
    broadcast; beyond, both sides are dealt out by key and a salt, so that a key with a third of ``left`` is
    spread over ``salts`` tasks. ``spread`` is any deterministic column of ``left`` to salt by.
    """
    right = staged(right)
    names = [f"_r_{k}" for k in keys]
    right = right.select(*[right[k].alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    small = table_bytes(right) <= broadcast_bytes
    if small:
        on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)])
        return left.join(F.broadcast(right), on, "left").drop(*names)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)], F.col("_salt") == F.col("_r_salt"))
    return left.join(right, on, "left").drop("_salt", "_r_salt", *names)


HEAVY = 100_000  # keys that join_counted broadcasts at most, each with at least this share of all rows
HEAVY_BYTES = 24_000_000  # and what they take


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], size: str = "size") -> DataFrame:
    """Inner join with a staged table that has one row per key, and in ``size`` how many rows of ``left`` have that key.

    A table of up to HEAVY rows and HEAVY_BYTES measured bytes is broadcast. Else the keys that hold more than 1 / HEAVY of all rows, HEAVY
    of them at most, and fewer if these take more than HEAVY_BYTES, are broadcast, and only the others, none of which is a large part of the rows, are shuffled.
    """
    key = [key] if isinstance(key, str) else key
    wide = F.coalesce(F.sum(row_bytes(right)), F.lit(0))
    got = right.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), wide.alias("bytes"), F.coalesce(F.max(row_bytes(right)), F.lit(1)).alias("widest")).first()
    if got["n"] <= HEAVY and got["bytes"] <= HEAVY_BYTES:
        return left.join(F.broadcast(right), key)
    least = max(1_000, got["total"] // min(HEAVY, max(1, HEAVY_BYTES // got["widest"])))
    heavy, light = right.where(F.col(size) > least), right.where(F.col(size) <= least)
    rest = left.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key)
    return left.join(F.broadcast(heavy), key).unionByName(rest)


# --- connected components ---------------------------------------------------


def _stars(edges: DataFrame) -> bool:
    """Whether no node is both a smaller and a larger end, nor the larger end of two edges."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Alternates large-star and small-star steps, each one aggregation and one join on a node. Minima are
    pre-aggregated before the shuffle, and nodes with a large part of all edges are joined by broadcast (``join_counted``), so
    that no task holds the neighbours of a hub. Every round is staged: a lost executor repeats one round at most.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of x to the smallest of x and its neighbours
        low = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).select("a", F.least("a", "m").alias("m"), "size"))
        large = staged(join_counted(both, low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # small star: every smaller neighbour of x, and x, to the smallest one
        least = staged(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("size")))
        small = join_counted(large, least, "b").select(F.col("m").alias("lo"), F.explode(F.array("a", "b")).alias("hi")).where("lo <> hi")
        new = staged(small.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct())
        unstage(edges, low, large, least)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hubs = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(hubs).groupBy("node").agg(F.min("component").alias("component"))
