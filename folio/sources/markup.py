"""``markup``: a data source of folders of texts, and a writer of one file per source.

    register(spark)
    spark.read.format("markup").option("path", "/corpus").option("glob", "*.txt").option("documents", "true").load()
    df.select("source_id", "text").write.format("markup").option("path", "/out").option("suffix", ".html").mode("append").save()

Reading: files are listed once and packed into partitions of about ``split`` bytes, a larger file alone; a task reads its files one by one and hands on
Arrow batches. Rows: source_id (the path below ``path``), document (its number, 0 unless documents are split), text. Conditions on source_id (equality, a list, a beginning) choose
among the files before any is read, those on document among the documents. Bytes that aren't UTF-8 become U+FFFD.

Writing: a task writes each row's text to a file of its own below a folder of its attempt; only when all tasks have ended are the files moved to
``path``/source_id + suffix, by the task's list of them, and what an aborted job or a lost attempt leaves is removed. Of rows that share a source_id the job takes none: it fails, and
leaves nothing. mode("overwrite") replaces files of the same names.

Paths may be on any file system that Arrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

SPLIT = 64_000_000
_BATCH_BYTES = 4_000_000
_SEPARATOR = re.compile(r"(?m)^---[ \t]*\n?$\n?")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3a://", "s3://", path) if "://" in path else "file://" + path.removeprefix("file:"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions reach it."""
    spark.dataSource.register(MarkupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def documents_of(text: str) -> list[str]:
    """The documents of a stream: parts between separator lines, without empty ones; one at least."""
    return [p for p in _SEPARATOR.split(text) if p.strip()] or [""]


@dataclass
class _Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class MarkupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markup"

    def schema(self) -> str:
        return "source_id string, document int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("give a path")
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.split = int(options.get("split", SPLIT))
        self.cut = options.get("documents", "false").lower() == "true"
        self.wanted: set[str] | None = None
        self.starts: list[str] = []
        self.document: set[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("source_id",):
                self.wanted = values if self.wanted is None else self.wanted & values
            elif values is not None and f.attribute == ("document",):
                self.document = values if self.document is None else self.document & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("source_id",):
                self.starts.append(f.value)
            else:
                yield f

    def _takes(self, name: str) -> bool:
        return fnmatch.fnmatch(posixpath.basename(name), self.glob) and (self.wanted is None or name in self.wanted) and all(map(name.startswith, self.starts))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        where, base = _open(self.path)
        base = base.rstrip("/")
        found = where.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f.path[len(base) + 1 :], f.size) for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(base) + 1 :].split("/")))
        parts, names, size = [], [], 0
        for name, n in files:
            if not self._takes(name):
                continue
            if names and size + n > self.split:
                parts.append(_Files(tuple(names)))
                names, size = [], 0
            names.append(name)
            size += n
        return [*parts, _Files(tuple(names))] if names or not parts else parts

    def read(self, partition: _Files) -> Iterator:
        import pyarrow as pa

        where, base = _open(self.path)
        rows, size = [], 0
        schema = pa.schema([("source_id", pa.string()), ("document", pa.int32()), ("text", pa.string())])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for name in partition.names:
            with where.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                text = f.read().decode("utf-8", "replace")
            for k, part in enumerate(documents_of(text) if self.cut else [text]):
                if self.document is None or k in self.document:
                    rows.append((name, k, part))
                    size += len(part)
            if size > _BATCH_BYTES:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        if "path" not in options:
            raise ValueError("give a path")
        if columns[0] != "source_id" or len(columns) != 2:
            raise ValueError(f"columns are source_id and the text, not {columns}")
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        where, base = _open(self.path)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        names = []
        for row in iterator:
            name, text = row[0], row[1]
            if not name or name.startswith("/") or ".." in str(name).split("/"):
                raise ValueError(f"{name!r} names no file below the folder")
            name = str(name) + self.suffix
            at = f"{base.rstrip('/')}/{folder}/{name}"
            where.create_dir(posixpath.dirname(at), recursive=True)
            with where.open_output_stream(at) as f:
                f.write((text or "").encode())
            names.append(name)
        return _Written(folder, tuple(names))

    def _remove(self) -> None:
        from pyarrow import fs

        where, base = _open(self.path)
        at = f"{base.rstrip('/')}/{self.job}"
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        where, base = _open(self.path)
        base = base.rstrip("/")
        where.create_dir(base, recursive=True)
        moves = [(f"{base}/{m.folder}/{n}", f"{base}/{n}") for m in messages if m for n in m.names]
        try:
            if len({to for _, to in moves}) < len(moves):
                raise ValueError("several rows share a source_id")
            if not self.overwrite and (there := [to for _, to in moves if where.get_file_info(to).type != fs.FileType.NotFound]):
                raise FileExistsError(f"{len(there)} files are there already, {there[0]} among them")
            for folder in sorted({posixpath.dirname(to) for _, to in moves}):
                where.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda m: where.move(*m), moves))
        finally:
            self._remove()

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove()
