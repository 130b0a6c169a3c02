"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence gets a probability from a logistic model over hashed words, the bag's
is their noisy-or, 1 - prod(1 - p), and the model is trained on labels of whole texts only. The same
sentence probabilities then locate the offending sentences.

Training reads a bounded sample: up to ``PER_LABEL`` labelled ids for each label, chosen by a hash of the id, one text of each (that of the
smallest hash), none above ``LONGEST_TEXT`` bytes and ``SAMPLE_BYTES`` in all,
weighted back to the label's share of all labelled rows. Every text is scored, whole. Labels of rows whose
crc32(doc_id as text) mod 5 is 0 are never read for training.

Defined cases: null and empty texts have one empty sentence and get its probability; null labels are ignored; null ids
are no held-out case unless crc32 of the empty text says so (it is 0, so they are); rows that repeat are scored each;
without labels of both kinds every score is the share of label 1, or 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, crc_mod, staged

PER_LABEL = 3_000
LONGEST_TEXT, SAMPLE_BYTES = 1_000_000, 16_000_000  # of a text, and of all texts of a label, in the sample
BITS = 20  # hashed words
PREFIXES = (4, 5, 6)
PART = 500_000  # features and sentences that the driver works on at once
MIN_TEXTS = 4  # texts of the sample that a word must be in
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+")
_TOKEN = re.compile(r"[^\W_]+")
_CACHE = 500_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: up to and with closing marks, or a line's end. One empty span if there are none."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


def features(words: list[str]) -> list[int]:
    """Hashed words, and their beginnings of PREFIXES characters: inflected forms share those."""
    names = [n for w in words for n in (w, *("^" + w[:k] for k in PREFIXES if len(w) > k))]
    return [xxhash.xxh3_64_intdigest(n) >> (64 - BITS) for n in names]


def tokens(sentence: str) -> list[str]:
    return _TOKEN.findall(sentence.lower())


class Bags:
    """Texts as flat arrays: the features of all sentences, ascending and once in each, how many each sentence has, how many features
    and sentences each bag has. Numbers of 32 bits, and worked on in parts of whole bags: the driver's memory holds little more than the arrays."""

    def __init__(self, feats: np.ndarray, per_sentence: np.ndarray, bag_feats: np.ndarray, bag_sents: np.ndarray):
        self.feats, self.per_sentence, self.bag_feats, self.bag_sents = feats, per_sentence, bag_feats, bag_sents
        self.n_sents, self.n_bags = len(per_sentence), len(bag_sents)

    def parts(self) -> list[tuple[slice, slice, slice]]:
        """Bags, sentences and features of stretches of about PART features and sentences, or of one larger bag."""
        size = np.cumsum(self.bag_feats + self.bag_sents)
        f, s = (np.concatenate(([0], np.cumsum(x))) for x in (self.bag_feats, self.bag_sents))
        out, at = [], 0
        while at < self.n_bags:
            to = max(at + 1, int(np.searchsorted(size, PART + (size[at - 1] if at else 0), "right")))
            out.append((slice(at, to), slice(s[at], s[to]), slice(f[at], f[to])))
            at = to
        return out

    def logits(self, sents: slice, feats: slice, w: np.ndarray, b: float) -> np.ndarray:
        per = self.per_sentence[sents]
        return np.bincount(np.repeat(np.arange(len(per)), per), w[self.feats[feats]], len(per)) + b

    def keep(self, wanted: np.ndarray) -> None:
        """Only these features (ascending), by their place among them."""
        place = np.full(1 << BITS, -1, np.int32)
        place[wanted] = np.arange(len(wanted), dtype=np.int32)
        end = 0
        for bags, sents, feats in self.parts():  # in place: what is written is behind what is read
            new, per, n = place[self.feats[feats]], self.per_sentence[sents], self.bag_sents[bags]
            of = np.repeat(np.arange(len(per)), per)[new >= 0]
            new, per = new[new >= 0], np.bincount(of, minlength=len(per))
            self.feats[end : end + len(new)] = new
            self.per_sentence[sents] = per
            self.bag_feats[bags] = np.bincount(np.repeat(np.arange(len(n)), n), per, len(n)).astype(np.int64)
            end += len(new)
        self.feats = self.feats[:end]


def noisy_or(logits: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(x)) for each bag."""
    return -np.expm1(-np.bincount(bag, np.logaddexp(0, logits), n))


def train(x: Bags, labels: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the weighted cross-entropy of noisy-or. Words of few texts keep weight 0."""
    often, ones = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for bags, _, feats in x.parts():
        n = x.bag_feats[bags]
        pairs = np.unique(np.repeat(np.arange(len(n)), n) << BITS | x.feats[feats])
        names = pairs & ((1 << BITS) - 1)
        often += np.bincount(names, minlength=1 << BITS)
        ones += np.bincount(names, labels[bags][pairs >> BITS], 1 << BITS)
    names = np.flatnonzero(often >= MIN_TEXTS)
    # start from half the log odds of a word's texts, where they speak for label 1: words that many texts share lead
    ones = ones[names]
    zeros = often[names] - ones
    odds = np.log((ones + 0.5) / (labels.sum() + 1)) - np.log((zeros + 0.5) / ((1 - labels).sum() + 1))
    x.keep(names)
    w, b = np.maximum(0, odds) / 2, -6.0
    first = w.copy()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    g, parts = np.zeros(x.n_sents), x.parts()
    for t in range(1, steps + 1):
        gw = np.zeros(len(names))
        for bags, sents, feats in parts:
            n = x.bag_sents[bags]
            bag = np.repeat(np.arange(len(n)), n)
            z = x.logits(sents, feats, w, b)
            p = np.clip(noisy_or(z, bag, len(n)), 1e-7, 1 - 1e-7)
            # d loss / d log(prod(1 - p_s)) for each bag, times the sentence's sigmoid
            outer = weight[bags] * (np.where(labels[bags] == 1, -(1 - p) / p, 1.0))
            g[sents] = outer[bag] / (1 + np.exp(-z))
            np.add.at(gw, x.feats[feats], np.repeat(g[sents], x.per_sentence[sents]))  # one by one, so that parts make no difference
        gw = gw / weight.sum() + l2 * (w - first)
        gb = g.sum() / weight.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[names] = w
    return full, float(b)


def _sample_features(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[Bags, np.ndarray, np.ndarray, dict[int, int]]:
    """Sentence features of the sample; its labels; weights; rows by label. Only hashed words of the sample reach the driver."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST_TEXT).join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))
    # one text of each id and label, whatever rows share the id; then as many as fit
    texts = staged(texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "label", "x.text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = texts.select("doc_id", "label", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "label")
    texts = texts.join(F.broadcast(sizes), ["doc_id", "label"])

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fs, ls = [], []
            for t in b["text"]:
                t = t if isinstance(t, str) else ""
                each = [sorted(set(features(tokens(t[i:j])))) for i, j in sentences(t)]
                fs.append([f for s in each for f in s])
                ls.append([len(s) for s in each])
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "feats": fs, "lens": ls})

    rows = texts.mapInPandas(flat, "doc_id long, label int, feats array<int>, lens array<int>").orderBy("doc_id").toArrow()
    flat_of = lambda k: np.concatenate([c.flatten().to_numpy() for c in rows[k].chunks] or [np.zeros(0, np.int32)])
    sizes_of = lambda k: pc.list_value_length(rows[k]).to_numpy().astype(np.int64)
    y = rows["label"].to_numpy().astype(np.int64)
    bags = Bags(flat_of("feats"), flat_of("lens"), sizes_of("feats"), sizes_of("lens"))
    here = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return bags, y, np.array([counts.get(int(k), 0) / here[int(k)] for k in y]), counts


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float]:
    """Model from docs (doc_id, text) and labels (doc_id, label)."""
    bags, y, weight, counts = _sample_features(docs, labels, per_label)
    if not counts.get(0) or not counts.get(1) or len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    return train(bags, y, weight)


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, spans array<struct<start:int,end:int,p:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int32()), ("spans", _SPAN)])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """SCORED for each row of docs (doc_id, text). spans: sentences with p >= 0.5, by code points."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        cache: dict[str, float] = {}
        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = t or ""
                spans = sentences(t)
                z = []
                for s, e in spans:
                    total = b
                    for word in set(tokens(t[s:e])):
                        x = cache.get(word)
                        if x is None:
                            if len(cache) > _CACHE:
                                cache.clear()
                            x = cache[word] = float(w[features([word])].sum())
                        total += x
                    z.append(total)
                z = np.array(z)
                p = 1 / (1 + np.exp(-z))
                doc = float(noisy_or(z, np.zeros(len(z), np.int64), 1)[0])
                out.append((crc_bucket(i, 5) == 0, doc, int(doc >= 0.5), len(spans), [{"start": s, "end": e, "p": float(q)} for (s, e), q in zip(spans, p) if q >= 0.5]))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(_SCORED)[1:])]], schema=_SCORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return staged(score(docs, fit(docs, labels))).select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("spans").alias("n_offending"), "spans")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
