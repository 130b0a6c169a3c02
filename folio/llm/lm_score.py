"""Language-model scoring of whole documents.

Corpus counts cover every training text. Tokens outside the recurrent model's vocabulary are one symbol of
the model, and are told apart by their smoothed counts, so that the score is the log-probability of the text as it is.

The recurrent model is trained once on every training text: texts are dealt over two rounds and, in a round, over
shards of about ``SHARD_TOKENS`` tokens; each shard makes one pass of truncated backpropagation from the common
weights, and the results are averaged by tokens. Every text, trained on or not, is scored whole.

Words of up to ``FREQUENT`` ranks are looked up in a table of bounded size that each task holds; the counts of
rarer ones, none of which can be a hot key, are joined by shuffle.

Defined cases: null and empty texts are the end token alone; null ids count as the empty text for crc32; rows that
repeat are scored each (and counted each); without training texts every count is 0 and the model is the
untrained one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, in_small_batches, split_words, staged

END = "\n"  # no word holds a line end
HELD_OUT_OF, HELD_OUT = 7, 2
FREQUENT, BUCKETS = 100_000, 65_536
SHARD_TOKENS = 2_000_000
RATES = (0.02, 0.01)  # of the rounds
_FLUSH, _POOL_TOKENS = 1_000_000, 4_000_000


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> list[np.ndarray]:
    """The ids of each text, the end token last."""
    out = np.full(len(ids) + len(counts), end, np.int16)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return np.split(out, np.cumsum(counts + 1)[:-1])


def vocabulary_ids(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """1 + place in the vocabulary, 0 for words outside."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64) + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of docs (text); each row has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in in_small_batches(batches):
            words, counts = split_words(b.column(0))
            got = words.value_counts()
            held += [pa.table({"word": got.field(0), "n": got.field(1)}), pa.table({"word": [END], "n": pa.array([len(counts)], pa.int64())})]
            rows += len(got)
            if rows > _FLUSH:
                held, rows = [merged()], 0
                if held[0].num_rows > _FLUSH // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[str, int]]:
    """The ``most`` words of the highest counts, most frequent first; of equally frequent ones at the end those of the lowest hashes.

    Whole steps of counts while they fit; then, in the first step that doesn't, whole counts, and of the first count that doesn't, whole buckets
    of words by hash. Only histograms and the words themselves reach the driver.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    hist = sorted((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect())  # a few thousand steps at most

    def fitting(hist: list[tuple[int, int]], room: int) -> tuple[list[int], int | None, int]:
        """The highest values whose rows fit, the first that doesn't, and the room left."""
        taken = []
        for value, k in sorted(hist, reverse=True):
            if k > room:
                return taken, value, room
            taken.append(value)
            room -= k
        return taken, None, room

    taken, split, room = fitting(hist, most)
    want = step >= min(taken) if taken else F.lit(False)
    if split is not None and room:
        inside = counts.where(step == split)
        taken, cut, room = fitting([(r["n"], r["k"]) for r in inside.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()], room)  # counts within a hundredth of each other
        want = want | ((step == split) & (F.col("n") > cut if cut is not None else F.lit(True)))
        if cut is not None and room:
            bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
            by_hash = inside.where(F.col("n") == cut).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
            taken, _, _ = fitting([(-r["b"], r["k"]) for r in by_hash], room)
            if taken:
                want = want | ((F.col("n") == cut) & (bucket <= -min(taken)))
    rows = counts.where(want).select("word", "n").toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda x: (-x[1], x[0]))


def train_model(docs: DataFrame, lm_words: list[str], start: dict, n_tokens: int, rates=RATES) -> dict:
    """Weights after a round for each rate; a text is in one round. docs: (doc_id, text), training rows only."""
    sc = docs.sparkSession.sparkContext
    shards = max(1, -(-n_tokens // len(rates) // SHARD_TOKENS))
    parts = max(1, int(np.ceil(np.sqrt(shards))))
    vocabulary, end = sc.broadcast(lm_words), lm_words.index(END) + 1
    schema = "block int, part int, n double, w array<float>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for b in in_small_batches(batches):
            words, counts = split_words(b.column("text"))
            texts = [t.tobytes() for t in with_ends(vocabulary_ids(words, known), counts, end)]
            # by the id too, so that copies are dealt over shards
            keys = [zlib.crc32(t, zlib.crc32(str(i).encode())) for i, t in zip(b.column("doc_id").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], ["key", "ids"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy()
        w = sum(np.asarray(x, np.float64) * k for x, k in zip(rows["w"], n)) / n.sum()
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": 0, "n": n.sum(), "w": [w.astype(np.float32)]})

    def one_pass(now, rate: float):
        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            """One shard: about SHARD_TOKENS tokens, whatever the number of partitions."""
            texts = [np.frombuffer(i, np.int16) for _, i in sorted(zip(rows["key"], rows["ids"]))]
            new = gru.flat(gru.train(gru.unflat(now.value), texts, end, rate))
            w = np.array_split(new, range(gru.BLOCK, len(new), gru.BLOCK))
            return pd.DataFrame({"block": np.arange(len(w)), "part": int(rows["shard"].iloc[0]) % parts, "n": float(sum(map(len, texts))), "w": w})

        return fit

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "key long, ids binary").withColumn("row", F.monotonically_increasing_id())
    # by the row too, so that rows equal in id and text are dealt over rounds and shards
    deal = lambda what, n: F.pmod(F.xxhash64(F.lit(what), F.col("key"), F.length("ids"), F.col("row")), F.lit(n)).cast("int")
    encoded = encoded.select("key", "ids", deal("round", len(rates)).alias("round"), deal("shard", shards).alias("shard"))
    weights = gru.flat(start)
    for i, rate in enumerate(rates):
        now = sc.broadcast(weights)
        got = encoded.where(F.col("round") == i).groupBy("shard").applyInPandas(one_pass(now, rate), schema)
        # means of the shards of a part, then of the parts: no task holds the weights of all shards
        got = got.groupBy("block", "part").applyInPandas(mean, schema).groupBy("block").applyInPandas(mean, schema)
        rows = staged(got.select("block", "w")).collect()  # as many values as the model has weights
        weights = weights.copy()
        for r in rows:
            weights[r["block"] * gru.BLOCK :][: len(r["w"])] = r["w"]
    return gru.unflat(weights)


PARTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


class Scorer:
    """Scores batches of (doc_id, text). Words that are not among the frequent ones are handed on with their numbers."""

    def __init__(self, p: dict, lm_words: list[str], frequent: list[tuple[str, int]], base_d: float, rest_d: float):
        self.p, self.base_d, self.rest_d = p, base_d, rest_d
        self.lm, self.end = pa.array(lm_words, pa.string()), lm_words.index(END) + 1
        self.frequent = pa.array([w for w, _ in frequent], pa.string())
        self.logs = np.log10(np.array([0.0, *[c for _, c in frequent]]) + 1)
        self.end_log = dict(frequent).get(END)
        self.pending, self.texts, self.size = [], [], 0

    def add(self, b: pa.RecordBatch) -> None:
        words, counts = split_words(b.column("text"))
        coded = words.dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), len(counts)
        doc = np.repeat(np.arange(n), counts)
        lm, place = vocabulary_ids(coded.dictionary, self.lm), vocabulary_ids(coded.dictionary, self.frequent)
        per_doc = lambda x: np.bincount(doc, x, n).astype(float)
        known = (place > 0)[code]
        base, n_known = per_doc(np.where(place > 0, self.logs[place] - self.base_d, 0.0)[code]), per_doc(known)
        extra = per_doc(np.where((place > 0) & (lm == 0), self.logs[place] - self.rest_d, 0.0)[code])
        if self.end_log is not None:
            base += log10(self.end_log + 1) - self.base_d
            n_known += 1
        else:  # no training text at all
            base -= self.base_d
        pairs, times = np.unique(doc[~known] * max(1, len(place)) + code[~known], return_counts=True)
        of, rare = np.divmod(pairs, max(1, len(place)))
        cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(rare))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))]
        self.pending.append((b.column("doc_id"), counts + 1, n_known.astype(np.int64), base, extra, lists))
        self.texts += with_ends(lm[code], counts, self.end)
        self.size += len(words) + n

    def flush(self) -> Iterator[pa.RecordBatch]:
        scores, at = gru.score(self.p, self.texts, self.end), 0
        for ids, n_tokens, n_known, base, extra, lists in self.pending:
            got = scores[at : at + len(ids)] + extra
            at += len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_tokens, pa.int64()), pa.array(n_known), pa.array(base), pa.array(got), *lists], schema=PARTS)
        self.pending, self.texts, self.size = [], [], 0


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(crc_mod(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT)
    counts = staged(count_words(training))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    top = frequent_words(counts)
    lm_words = [w for w, _ in top[: gru.WORDS]]
    if END not in lm_words:
        lm_words = [*lm_words[: gru.WORDS - 1], END]
    by_word = dict(top)
    if n_all and END not in by_word:  # fewer ends than any frequent word has
        by_word[END] = counts.where(F.col("word") == END).first()["n"]
        top.append((END, by_word[END]))
    lm_counts = np.zeros(gru.WORDS + 1)
    lm_counts[1 : len(lm_words) + 1] = [by_word.get(w, 0) for w in lm_words]
    known = sum(1 for w in lm_words if by_word.get(w))
    rest_n, rest_v = n_all - int(lm_counts.sum()), v_all - known
    lm_counts[0] = max(rest_n, 1)
    model = train_model(training, lm_words, gru.initial(lm_counts), n_all)
    base_d, rest_d = log10(n_all + v_all + 1), log10(rest_n + rest_v + 1)
    held = sc.broadcast((model, lm_words, top, base_d, rest_d))  # bounded: WORDS, FREQUENT and the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for b in in_small_batches(batches):
            scorer.add(b)
            if scorer.size > _POOL_TOKENS:
                yield from scorer.flush()
        yield from scorer.flush()

    parts = staged(rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>").withColumn("uid", F.monotonically_increasing_id()))
    rare = parts.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 1)).alias("logs"), F.sum("times").alias("times"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    x = parts.select("uid", "doc_id", "n_tokens", "n_known", "base", "score").join(sums, "uid", "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0))
    return x.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - zero("times") * base_d).alias("base_score"),
        (F.col("score") + zero("logs") - zero("times") * rest_d).alias("score"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLE: dict[str, str] = {}
