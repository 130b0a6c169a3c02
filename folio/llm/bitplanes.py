"""Token ids in files of shuffled bit planes.

Texts are encoded with a public tokenizer and written in ascending order of their ids as files of their own format; readers take them chunk by chunk.

File format, version 1, all numbers little-endian: the magic ``FBP1``; chunks; a table of the documents; the index; the index's place and size (two u64); the magic again.
A chunk holds a block of CHUNK token ids (the last one fewer), transposed: plane k of ``bit`` files is bit k of all its ids, eight ids to
a byte; plane k of ``byte`` files is byte k. Planes above the highest one in use are left out; each plane is compressed by zstandard
on its own, so that the sparse upper planes shrink to almost nothing. The table of documents is stored the same way, as
three columns: ids, whether they are given, numbers of tokens. The index is JSON: kind of planes, tokens, documents, and for each chunk its place, number of ids and its planes' sizes.

Work on a cluster: texts are dealt out by ranges of (id, text hash, row), so that one id with a third of all rows is still cut into many
ranges; each task sorts its range, encodes and writes files of up to FILE_TOKENS tokens (one longer text is a file of its own) below the shared folder. A file's
name is new for each attempt, and only those named in the manifest, which Spark's own committer writes, count: what a lost executor leaves
behind is never read. Where a file's documents start in the whole is a sum over the manifest, in two levels of windows.

Encoding is by pieces: a text is cut where white space follows anything else. There the tokenizer's pattern always starts a new piece and
looks at nothing before it, so the ids are those of the whole text (tests hold them against it); a piece seen before is looked up.

Defined cases: null and empty texts have the end id only; null ids come first; rows that share an id are ordered by a hash of the text, equal rows are
written each; no documents, no files; a special token's name inside a text is that token, as the library has it. Only id and text are
read, so other columns never clash. A text of any length is cut into chunks; its ids are in memory once while it is written.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, shared_root, staged

#: Production parameters: ids to a chunk, tokens to a file, the id that ends a document, bytes of text to a range.
CHUNK, FILE_TOKENS, END_ID, RANGE_BYTES = 65_536, 8_000_000, 2, 32_000_000
MAGIC = b"FBP1"
LEVEL = 3
PIECES_MOST = 240_000_000  # bytes of pieces and ids that a worker remembers, about


# --- planes -----------------------------------------------------------------


def to_planes(values: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The compressed planes of a block of unsigned numbers, lowest first, without empty ones above."""
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    values = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<"), copy=False)
    rows = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    top = int(values.max()) if len(values) else 0
    if kind == "byte":
        return [zip_(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range((top.bit_length() + 7) // 8)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, : top.bit_length()]
    return [zip_(x.tobytes()) for x in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str = "byte", dtype: str = "<u4") -> np.ndarray:
    """The block of n numbers back."""
    size = np.dtype(dtype).itemsize
    rows = np.zeros((n, size), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            rows[:, k] = np.frombuffer(zstandard.decompress(p), np.uint8)
    elif planes:
        bits = np.zeros((8 * size, n), np.uint8)
        for k, p in enumerate(planes):
            bits[k] = np.unpackbits(np.frombuffer(zstandard.decompress(p), np.uint8), bitorder="little")[:n]
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).reshape(-1).view(dtype)


# --- files ------------------------------------------------------------------


class Writer:
    """Writes one file: documents in order, chunks as they fill."""

    def __init__(self, sink, kind: str = "byte", chunk: int = CHUNK):
        if kind not in ("bit", "byte"):
            raise ValueError("planes are 'bit' or 'byte'")
        self.sink, self.kind, self.chunk = sink, kind, chunk
        self.ids, self.given, self.sizes, self.index = [], [], [], []
        self.waiting, self.n_waiting, self.tokens = [], 0, 0
        self.place = self._put(MAGIC)

    def _put(self, data: bytes, before: int = 0) -> int:
        self.sink.write(data)
        return before + len(data)

    def _planes(self, values: np.ndarray) -> list[int]:
        planes = to_planes(values, self.kind)
        entry = [self.place, len(values), [len(p) for p in planes]]
        for p in planes:
            self.place = self._put(p, self.place)
        return entry

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.given.append(doc_id is not None)
        self.sizes.append(len(ids))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        values, at = np.concatenate(self.waiting), 0
        while len(values) - at >= self.chunk or all_of_it and at < len(values):
            self.index.append(self._planes(values[at : at + self.chunk]))
            at += self.chunk
        self.waiting = [values[at:].copy()] if at < len(values) else []
        self.n_waiting = max(0, len(values) - at)

    def close(self) -> None:
        if self.waiting:
            self._flush(True)
        table = [self._planes(np.array(self.ids, "<i8").view("<u8")), self._planes(np.array(self.given, "u1")), self._planes(np.array(self.sizes, "<u8"))]
        index = json.dumps({"planes": self.kind, "tokens": self.tokens, "documents": len(self.ids), "chunks": self.index, "table": table}).encode()
        self._put(index + struct.pack("<QQ", self.place, len(index)) + MAGIC)


def read_index(source) -> dict:
    """The index of an open file."""
    source.seek(0, io.SEEK_END)
    source.seek(source.tell() - 20)
    place, size = struct.unpack("<QQ", source.read(16))
    if source.read(4) != MAGIC:
        raise ValueError("no file of bit planes, or a cut one")
    source.seek(place)
    return json.loads(source.read(size))


def read_block(source, index: dict, entry: list, dtype: str = "<u4") -> np.ndarray:
    """One chunk of an open file, or one column of its table."""
    place, n, sizes = entry
    source.seek(place)
    return from_planes([source.read(k) for k in sizes], n, index["planes"], dtype)


def read_documents(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of each document of an open file, in order; one chunk is in memory at a time, or what a longer document takes."""
    index = read_index(source)
    ids, given, sizes = (read_block(source, index, e, t) for e, t in zip(index["table"], ("<i8", "u1", "<u8")))
    chunks = iter(index["chunks"])
    rest = np.empty(0, "<u4")
    for doc_id, known, size in zip(ids.tolist(), given.tolist(), sizes.tolist()):
        have = [rest]
        n = len(rest)
        while n < size:
            have.append(read_block(source, index, next(chunks)))
            n += len(have[-1])
        rest = np.concatenate(have) if len(have) > 1 else rest
        yield doc_id if known else None, rest[:size]
        rest = rest[size:]


def open_shared(path: str):
    """(file system, path in it) of a path in the shared folder; any that Arrow knows: file, hdfs, s3, gs."""
    from pyarrow import fs

    path = re.sub(r"^s3a://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# --- tokens -----------------------------------------------------------------

_PIECE = re.compile(r"\s*\S+|\s+")
#: Fixed value: marks that the tokenizer's pattern parts from a letter before them. No apostrophe, which may begin a short form.
_MARKS = ".,;:!?)"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids of whole texts, by remembered pieces.

    "a b\\nc" is cut into "a", " b" and "\\nc". The words of a batch are told apart by Arrow; a word is looked up once a batch, and
    what isn't known goes to the tokenizer, plain words many at a time: in the ids that come back a blank in front begins each.
    """

    def __init__(self, path: str, most: int = PIECES_MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[str, bytes] = {}  # a word after a blank, or one with a line's end in front
        self.older: dict[str, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str], ids: list[bytes]) -> None:
        if self.size > self.most // 2:  # what isn't asked for again while as much comes in is forgotten
            self.known, self.older, self.size = {}, self.known, 0
        self.known.update(zip(pieces, ids))
        self.size += sum(map(len, ids)) + 2 * sum(map(len, pieces)) + 180 * len(pieces)

    def _learn(self, words: list[str]) -> None:
        # a mark after a letter is a piece of its own: most words with one are known without it, or are learnt once
        marked = [w for w in words if w[-1] in _MARKS and w[-2:-1].isalpha()]
        if marked:
            self._recall(list({w[:-1] for w in marked}))
            ends = dict(zip(_MARKS, self._ids(list(_MARKS))))
            self._keep(marked, [self._of(w[:-1]) + ends[w[-1]] for w in marked])
            words = [w for w in words if w[-1] not in _MARKS or not w[-2:-1].isalpha()]
        rest = [w for w in words if w[0] == "\n" or len(w.split()) != 1 or w[0].isspace()]
        plain = list(set(words).difference(rest)) if rest else words
        for at in range(0, len(plain), 2_000):
            some = plain[at : at + 2_000]
            flat = np.frombuffer(self._ids([" " + " ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(self.begins[flat])
            if len(cuts) == len(some):
                data, ends = flat.tobytes(), np.append(4 * cuts, 4 * len(flat)).tolist()
                self._keep(some, list(map(data.__getitem__, map(slice, ends, ends[1:]))))
            else:
                self._keep(some, self._ids([" " + w for w in some]))
        self._keep(rest, self._ids([w if w[0] == "\n" else " " + w for w in rest]))

    def _uneven(self, text: str) -> bytes:
        """A text with white space next to white space, or at its end."""
        pieces = _PIECE.findall(text)
        keys = ["" if p[-1].isspace() else p[1:] if p[0] == " " and not p[1].isspace() else p if p[0] == "\n" else "" for p in pieces]
        self._recall(sorted({k for k in keys if k}))
        own = iter(self._ids([p for p, k in zip(pieces, keys) if not k]))
        return b"".join(self._of(k) if k else next(own) for k in keys)

    def _of(self, word: str) -> bytes:
        got = self.known.get(word)
        return self.older[word] if got is None else got

    def _recall(self, words: list[str]) -> list[bytes | None]:
        """The ids of the words, None for those that can't be told by themselves: nothing, or white space at the end."""
        got = list(map(self.known.get, words))
        if None not in got:
            return got
        lost = [w for w, g in zip(words, got) if g is None]
        if self.older:
            back = list(filter(self.older.__contains__, lost))
            self._keep(back, list(map(self.older.__getitem__, back)))
            lost = list(filterfalse(self.known.__contains__, lost))
        new = [w for w in lost if w and not w[-1].isspace()]
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])
        known, older = self.known.get, self.older.get
        return [(known(w) or older(w)) if g is None else g for w, g in zip(words, got)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the places where each text begins and the last one ends. Null texts have none."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n"), " ")
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).copy()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        ids = self._recall(names)
        firsts = list(map(names.__getitem__, at[begin[:-1]].tolist()))  # no blank before these
        at[begin[:-1]] = len(names) + np.arange(len(firsts))
        ids += self._ids(firsts)
        uneven = []
        if None in ids or any(f != f.rstrip() for f in firsts):
            bad = np.array([g is None for g in ids], bool)
            bad[len(names) :] = [f != f.rstrip() for f in firsts]
            uneven = np.flatnonzero(np.add.reduceat(bad[at], begin[:-1])).tolist()
            ids = [g or b"" for g in ids]
            for k in uneven:  # its first word stands for the whole of it
                ids[len(names) + k] = self._uneven(texts[k].as_py())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        place = np.cumsum(size, dtype=np.int64) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = size[at]
        for k in uneven:
            size[begin[k] + 1 : begin[k + 1]] = 0
        end = np.cumsum(size, dtype=np.int64)
        out = flat[np.repeat(place[at] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        return out, np.concatenate(([0], end))[begin]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- Spark ------------------------------------------------------------------

MANIFEST = "path string, first struct<id:long,h:long>, last struct<id:long,h:long>, documents long, tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", chunk: int = CHUNK, file_tokens: int = FILE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Writes docs as files below the shared folder and returns the manifest, a staged table: one row per file, in no order, with its first and last keys.

    tokenizer: the path of a tokenizer's file on every worker.
    """
    spark = docs.sparkSession
    folder = f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, 1 + size // RANGE_BYTES), "id", "h", "row").sortWithinPartitions("id", "h").drop("row")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        fs, base = open_shared(folder)
        fs.create_dir(base, recursive=True)
        out, sink, name, first, last = None, None, "", None, None

        def done() -> pa.RecordBatch:
            out.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first": first, "last": last, "documents": len(out.ids), "tokens": out.tokens}], _MANIFEST)

        for b in in_small_batches(batches, most=8_000_000):
            flat, cuts = enc.encode(b.column("text"))
            cuts = cuts.tolist()
            for doc_id, h, x, y in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), cuts, cuts[1:]):
                key = {"id": doc_id, "h": h}
                if out is None:
                    name = f"{uuid.uuid4().hex}.fbp"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out, first = Writer(sink, planes, chunk), key
                last = key
                out.add(doc_id, np.append(flat[x:y], end))
                if out.tokens >= file_tokens:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    _KEY = pa.struct([("id", pa.int64()), ("h", pa.int64())])
    _MANIFEST = pa.schema([("path", pa.string()), ("first", _KEY), ("last", _KEY), ("documents", pa.int64()), ("tokens", pa.int64())])
    return staged(rows.mapInArrow(kernel, MANIFEST))


def file_starts(manifest: DataFrame, group: int = 1_000) -> DataFrame:
    """(path, start, tokens): how many tokens all files before have.

    Files come in the order of their first and then their last keys; of two with the same first key the one that ends with it comes first. Sums are taken inside groups of
    files by ranges of keys and over the groups, so that no window holds more than ``group`` or (files / group) rows, about.
    """
    n = manifest.count()
    keys = ["first.id", "first.h", "last.id", "last.h", "path"]
    parts = max(1, n // group)
    dealt = staged(manifest.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    order = Window.orderBy(*keys)
    sums = dealt.groupBy("part").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("tokens").over(order.partitionBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(F.broadcast(sums.select("part", "before")), "part").select("path", (F.col("before") + F.col("inside")).alias("start"), "tokens")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, as read back from them: chunk by chunk, files dealt out over the tasks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(b.column(c).to_pylist() for c in ("path", "start"))):
                fs, inner = open_shared(path)
                rows: list[tuple] = []
                with fs.open_input_file(inner) as source:
                    for doc_id, ids in read_documents(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 50_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    _batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)
    files = file_starts(manifest)
    return files.repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism, 10_000)), "path").mapInArrow(kernel, ", ".join(f"{c} long" for c in names))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op12_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer()))


QUERIES = {"op12_token_planes": op12_token_planes}
ORACLE: dict[str, str] = {}
