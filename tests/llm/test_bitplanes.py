import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bitplanes as B

PATH = B.public_tokenizer()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_come_back(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (1, 2, 255, 256, 50_257, 2**32 - 1):
            v = rng.integers(0, top, n, dtype=np.uint32)
            assert (B.from_planes(B.to_planes(v, kind), n, kind) == v).all()
        v = rng.integers(-(2**63), 2**63 - 1, n)
        assert (B.from_planes(B.to_planes(v.view("<u8"), kind), n, kind, "<i8") == v).all()
    assert len(B.to_planes(np.array([5, 4], np.uint32), kind)) == (3 if kind == "bit" else 1)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_a_file_comes_back_chunk_by_chunk(kind):
    rng = np.random.default_rng(2)
    docs = [(None, 0), (-5, 3), (7, 1000), (7, 64), (8, 0), (2**60, 129)]
    docs = [(k, rng.integers(0, 50_257, n, dtype=np.uint32)) for k, n in docs]
    sink = io.BytesIO()
    w = B.Writer(sink, kind, chunk=64)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    index = B.read_index(sink)
    assert index["documents"] == 6 and index["tokens"] == sum(len(x) for _, x in docs) and all(c[1] == 64 for c in index["chunks"][:-1])
    flat = np.concatenate([x for _, x in docs])
    assert (B.read_block(sink, index, index["chunks"][3]) == flat[192:256]).all()
    got = list(B.read_documents(sink))
    assert [k for k, _ in got] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    with pytest.raises(ValueError):
        B.read_index(io.BytesIO(sink.getvalue()[:-1]))
    with pytest.raises(ValueError):
        B.Writer(io.BytesIO(), "nibble")


@pytest.mark.parametrize("most", [240_000_000, 20_000])
def test_ids_are_those_of_whole_texts(most):
    texts = ["", None, " ", "a", "a  ", "a \n b", "\n\n", "a\nb", "a\n\nb", " a b\n", "x  y", "don't 's ,. a's", "a\tb c", "\x1c \x1d", "a\x85b c", "İ ẞ 12 3.4", "日本 語　x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>,"]
    rng = random.Random(3)
    bits = ["a", "b", "bc", " ", " ", " ", "\n", "'", "s", "1", ",", ".", ")", " ", "\t", "é", "!", "\x1c", " ", "²", "<|endoftext|>", "٣", "word"]
    texts += ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(6000)]
    enc = B.Encoder(PATH, most)
    want = enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for at in range(0, len(texts), 300):
        flat, cuts = enc.encode(pa.array(texts[at : at + 300]))
        assert [flat[x:y].tolist() for x, y in zip(cuts, cuts[1:])] == [e.ids for e in want[at : at + 300]]
    flat, cuts = enc.encode(pa.array([], pa.string()))
    assert len(flat) == 0 and cuts.tolist() == [0]


def expected(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_plain_encoding(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k * 7 % 503 - 100, None if k % 50 == 3 else " ".join(rng.choices(["alpha", "beta,", "gamma.", "x1", "\n"], k=rng.randint(0, 60)))) for k in range(503)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("h", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in B.op12_token_planes(spark, str(tmp_path)).collect())
    assert got == sorted(expected(rows))


def test_many_small_files_and_repeated_rows(spark):
    rows = [(1, "same text")] * 300 + [(1, "another")] + [(k, f"text {k}") for k in range(2, 300)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = B.write_token_files(docs, PATH, planes="bit", chunk=16, file_tokens=40)
    assert files.count() > 40
    got = sorted((tuple(r) for r in B.read_token_files(files).select("start", "n_tokens", "doc_id", "ids_crc32").collect()))
    assert [s for s, *_ in got] == [sum(n for _, n, *_ in got[:k]) for k in range(len(got))]
    assert [k for *_, k, _ in got] == [None] + [1] * 301 + list(range(2, 300))
    assert sorted(map(str, {(k, n, c) for _, n, k, c in got})) == sorted(map(str, {(k, n, c) for k, _, n, c in expected(rows)}))
    starts = {r.path: r.start for r in B.file_starts(files, group=5).collect()}  # many groups of files
    assert starts == {r.path: r.start for r in B.file_starts(files).collect()}


def test_edges(spark, edge_docs, no_docs):
    got = B.read_token_files(B.write_token_files(edge_docs, PATH)).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 1) for r in got) == sorted((str(k), bool(t)) for k, t, *_ in edge_docs.collect())
    assert B.read_token_files(B.write_token_files(no_docs, PATH)).count() == 0


def test_left_over_files_are_not_read(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    files = B.write_token_files(docs, PATH)
    folder = os.path.dirname(files.first().path.removeprefix("file://"))
    with open(f"{folder}/{'0' * 32}.fbp", "wb") as f:
        f.write(b"FBP1 of a lost executor")
    assert B.read_token_files(files).count() == 20
