"""Hard negatives by norm-bucketed search.

For each anchor and each of its positives (the anchor's best rows of its own label) the best rows of other labels are wanted whose score,
the integer inner product with the anchor, lies between a share of the positive's score and that score. Candidates are sorted by the length of their
vectors and cut into buckets of consecutive lengths; a bucket is a block of vectors with its greatest length. By
Cauchy and Schwarz no row of a bucket scores more than the anchor's length times that: a bucket is left out for all anchors
of a block when that bound is below the lower limit of their windows (in the join's condition), and for single anchors when it is below their
lowest window or, in the task, below the running k-th score. Both searches, for positives and for negatives, use the same buckets.

The anchors are a stated query set, in blocks, against all rows, in blocks: one nested loop of blocks, the anchors broadcast while they are small
(measured bytes), else joined by Spark block against block without a broadcast. A task sends on k rows for each anchor (and positive) it met, and a ranking window takes the best.

Arithmetic is exact: components are whole numbers, products are taken in doubles where the lengths show that no sum can leave 2^53, else in 64-bit integers.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part, and neither do rows whose vector is
longer than 2^31 after rounding (their scores may not fit a long); a vector with fewer components counts as filled up with zeros; an empty
vector is a zero vector; rows that share an id are rows of their own, ranked among each other by their place in the table; an anchor without rows of its
own label has no positives, and a positive with a score below zero, or with no row in its window, no negatives. Only id, vector and label are read, so other columns
never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table_bytes

#: Production parameters: positives, negatives each, the window in hundredths of the positive's score, rows to a bucket, anchors to a block.
POSITIVES, NEGATIVES, LOW, HIGH, BUCKET, ANCHORS = 5, 5, 80, 100, 2_048, 512
BROADCAST_BYTES = 24_000_000
LONGEST = 2.0**31
_NEVER = -np.iinfo(np.int64).max  # its negative is a number too
_LAST = np.iinfo(np.int64).max
PACKED = "n int, dim int, longest double, row binary, id binary, label binary, vec binary"


def _packed(rows: list[tuple[int, int, int, list[int]]]) -> dict:
    dim = max(len(r[3]) for r in rows)
    m = np.zeros((len(rows), dim), "<i4")
    for k, r in enumerate(rows):
        m[k, : len(r[3])] = r[3]
    norms = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    as_bytes = lambda j, t: np.array([r[j] for r in rows], t).tobytes()
    return {"n": len(rows), "dim": dim, "longest": float(norms.max()), "row": as_bytes(0, "<i8"), "id": as_bytes(1, "<i8"), "label": as_bytes(2, "<i8"), "vec": m.tobytes()}


def _pack(rows: DataFrame, most: int, extra: str = "") -> DataFrame:
    """Rows (row, id, label, q and those of extra) of each partition, in order, as blocks of up to ``most`` rows; extra: a long column packed too."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            held += b.to_pylist()
            while len(held) >= most:
                yield block(held[:most])
                held = held[most:]
        if held:
            yield block(held)

    def block(held: list[dict]) -> pa.RecordBatch:
        one = _packed([(r["row"], r["id"], r["label"], r["q"]) for r in held])
        if extra:
            sizes = [len(r[extra]) for r in held]
            one |= {extra: np.array([x for r in held for x in r[extra]], "<i8").tobytes(), "sizes": np.array(sizes, "<i4").tobytes(), "least": float(min((x for r in held for x in r[extra] if x >= 0), default=LONGEST**2))}
        return pa.RecordBatch.from_pylist([one], _ARROW_EXTRA if extra else _ARROW)

    base = [("n", pa.int32()), ("dim", pa.int32()), ("longest", pa.float64()), *[(c, pa.binary()) for c in ("row", "id", "label", "vec")]]
    _ARROW = pa.schema(base)
    _ARROW_EXTRA = pa.schema([*base, (extra or "x", pa.binary()), ("sizes", pa.binary()), ("least", pa.float64())])
    return rows.mapInArrow(kernel, PACKED + (f", {extra} binary, sizes binary, least double" if extra else ""))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(row, id, label, q, norm): the rows that take part, components as floor(scale * x)."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(F.col(vector_col), lambda v: v.cast("double") * scale).alias("v"))
    x = x.withColumn("row", F.monotonically_increasing_id())
    good = F.forall("v", lambda v: v.isNotNull() & (F.abs(v) < LONGEST))  # not for NaN, which is greater than any number here
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    x = x.withColumn("v", F.transform("v", lambda v: F.floor(v).cast("double")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    x = x.withColumn("norm", norm).where(F.col("norm") < LONGEST)
    return x.select("row", "id", "label", F.transform("v", lambda v: v.cast("int")).alias("q"), "norm")


def norm_buckets(vectors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Blocks of up to ``bucket`` rows, the longest vectors first. Rows of one length are dealt by their place in the table."""
    n = vectors.count()
    parts = max(1, min(1 + n // bucket, 4 * vectors.sparkSession.sparkContext.defaultParallelism + n // (64 * bucket)))
    return staged(_pack(vectors.repartitionByRange(parts, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row"), bucket))


def _unpack(r: dict, mark: str) -> dict:
    get = lambda c, t: np.frombuffer(r[mark + c], t)
    return {"row": get("row", "<i8"), "id": get("id", "<i8"), "label": get("label", "<i8"), "vec": get("vec", "<i4").reshape(r[mark + "n"], r[mark + "dim"]), "longest": r[mark + "longest"]}


def _scores(a: np.ndarray, b: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])  # a missing component is a zero
    kind = np.float64 if exact_in_doubles else np.int64
    return (a[:, :d].astype(kind) @ b[:, :d].astype(kind).T).astype(np.int64)


class _Best:
    """The k best (score, id, row) of each of n queries so far: higher scores, then smaller ids, then rows."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.row = np.full((n, k), _NEVER), np.full((n, k), _LAST), np.full((n, k), _LAST)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores and ok: (queries at, candidates)."""
        k = self.score.shape[1]
        ok = ok & (scores >= self.worst()[at][:, None])
        some = np.flatnonzero(ok.any(1))
        for q in some.tolist():
            j = np.flatnonzero(ok[q])
            if len(j) > 4 * k:  # only those that reach the k-th score of this block
                s = scores[q, j]
                j = j[s >= np.partition(s, len(s) - k)[len(s) - k]]
            g = at[q]
            s, i, r = (np.concatenate(x) for x in ((self.score[g], scores[q, j]), (self.id[g], ids[j]), (self.row[g], rows[j])))
            best = np.lexsort((r, i, -s))[:k]
            self.score[g], self.id[g], self.row[g] = s[best], i[best], r[best]


_FOUND = "anchor_row long, anchor_id long, slot int, score long, id long, row long"


def _search(anchors: DataFrame, buckets: DataFrame, k: int, same_label: bool, high: int, low: int) -> DataFrame:
    """The k best rows that each task found for each anchor (slot 0), or for each of its positives (slot: the positive's place)."""
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    if table_bytes(a) <= BROADCAST_BYTES:
        a = F.broadcast(a)
    # no bucket below the lowest limit of all windows of the block; a product of two roundings is told apart by a margin
    reach = F.lit(True) if same_label else F.col("a_longest") * F.col("longest") * (100 * (1 + 1e-9)) >= F.col("a_least") * low
    pairs = buckets.join(a, reach)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, dict] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                key = r["a_row"][:8]
                if key not in states:
                    if len(states) >= 64:
                        yield from out(states.pop(next(iter(states))))
                    states[key] = begin(r)
                take(states[key], _unpack(r, ""))
        for s in states.values():
            yield from out(s)

    def begin(r: dict) -> dict:
        s = _unpack(r, "a_")
        n = len(s["row"])
        s["norm"] = np.sqrt((s["vec"].astype(np.float64) ** 2).sum(1))
        if same_label:
            s["of"], s["slot"], s["limit"] = np.arange(n), np.zeros(n, np.int32), None
        else:
            counts = np.frombuffer(r["a_sizes"], "<i4")
            s["of"] = np.repeat(np.arange(n), counts)
            s["slot"] = (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            s["limit"] = np.frombuffer(r["a_limits"], "<i8")
        s["best"] = _Best(len(s["of"]), k)
        return s

    def take(s: dict, c: dict) -> None:
        of, best, norm = s["of"], s["best"], s["norm"]
        bound = norm[of] * c["longest"] * (1 + 1e-9)
        alive = bound >= best.worst()
        if not same_label:
            alive &= (s["limit"] >= 0) & (100 * bound >= low * s["limit"].astype(np.float64) * (1 - 1e-9))
        q = np.flatnonzero(alive)
        if not len(q):
            return
        who = np.unique(of[q])
        got = _scores(s["vec"][who], c["vec"], float(norm[who].max()) * c["longest"] < 2**52)
        like = s["label"][who][:, None] == c["label"][None, :]
        if same_label:
            best.add(q, got, like & (s["row"][who][:, None] != c["row"][None, :]), c["id"], c["row"])
            return
        place = np.searchsorted(who, of[q])
        for slot in np.unique(s["slot"][q]).tolist():  # one positive of each anchor at a time
            own = s["slot"][q] == slot
            w, limit = place[own], s["limit"][q[own]][:, None]
            x = got[w]
            whole, part = limit // 100, limit % 100  # apart, since 100 times a score may not fit
            least, most = whole * low - (-low * part // 100), whole * high + high * part // 100
            best.add(q[own], x, ~like[w] & (x >= least) & (x <= most), c["id"], c["row"])

    def out(s: dict) -> Iterator[pa.RecordBatch]:
        best = s["best"]
        q, j = np.nonzero(best.row != _LAST)
        if len(q):
            cols = (s["row"][s["of"][q]], s["id"][s["of"][q]], s["slot"][q], best.score[q, j], best.id[q, j], best.row[q, j])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [c.split()[0] for c in _FOUND.split(", ")])

    return pairs.mapInArrow(kernel, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: a condition on the column ``id`` that says which rows are anchors; label: of the rows' columns, ``label`` by default.
    low, high: the window of the negatives' scores in hundredths of the positive's.
    """
    vectors = staged(whole_vectors(rows, id_col, vector_col, F.col("label") if label is None else label))
    buckets = norm_buckets(vectors)
    chosen = vectors.where(anchor)
    near = staged(_ranked(_search(_pack(chosen.select("row", "id", "label", "q"), ANCHORS), buckets, positives, True, high, low), positives))
    # one row per anchor again, with the scores of its positives in their order
    limits = near.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("limits")).withColumnRenamed("anchor_row", "row")
    windows = staged(_pack(chosen.join(limits, "row").select("row", "id", "label", "q", "limits"), ANCHORS, "limits"))
    far = _ranked(_search(windows, buckets, negatives, False, high, low), negatives)
    pos = near.select(F.col("anchor_row").alias("p_row"), (F.col("rank") - 1).alias("p_slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    got = far.join(pos, (F.col("anchor_row") == F.col("p_row")) & (F.col("slot") == F.col("p_slot")))
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=moved)


SQL = f"""WITH v AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label, embedding AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT id, label, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS q FROM v),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score FROM q a, q b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
 FROM p JOIN s ON s.a = p.a AND NOT s.alike AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= {NEGATIVES}"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": SQL}
