"""WARC archives: writing, reading, and resolving repeated payloads into revisit records.

Archives are written by Spark's own text writer, one record per row, so that commits, retries and remote stores work
as for any other table; the line separator supplies the end of a record. Reading goes through Spark's
binary files and a parser that follows Content-Length record by record. Resolution shuffles headers only, by payload
digest: the record with the smallest id of a digest stays the response, the others become revisits of it. Only what
concerns revisits goes back to the payloads: it is broadcast where its counted bytes are few, else joined by record number.

A file holds up to ``RECORDS_PER_FILE`` records with payloads of up to ``SMALL`` bytes, or ``LARGE_PER_FILE`` larger ones.

Defined cases: null html is an empty payload; empty payloads count as equal payloads like any other; null urls
give records without a target; every row, also one that repeats an id or a whole row, is a record with a number and
an id of its own; the smallest id of a digest (nulls last), or its first record, is the response. Payloads are UTF-8;
reading raises an error at others, at a cut-off record and at a digest that doesn't fit.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_root, staged

VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE, SMALL, LARGE_PER_FILE = 2_000, 128_000, 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def now() -> str:
    """The time of writing, as WARC-Date has it."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{key}')}>"


def _headers(pairs: list[tuple[str, str | None]], block: str) -> str:
    lines = [VERSION, *[f"{k}: {v}" for k, v in pairs if v is not None], f"Content-Length: {len(block.encode())}"]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF


def _clean(url) -> str | None:
    return None if url is None or url != url else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in str(url))


def response_record(key, page_id, url, payload: str, digest: str, date: str) -> str:
    """A response record but for its last line end."""
    body = payload.encode()
    block = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]) + CRLF * 2 + payload
    pairs = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", None if page_id is None else str(page_id)), ("X-Row", str(key)), ("X-Payload-Length", str(len(body))), ("Content-Type", "application/http; msgtype=response")]
    return _headers(pairs, block)


def revisit_record(key, page_id, url, length: int, digest: str, first_key, first_id, first_url, first_date: str, date: str) -> str:
    pairs = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_key)), ("WARC-Refers-To-Target-URI", _clean(first_url)), ("WARC-Refers-To-Date", first_date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", None if page_id is None else str(page_id)), ("X-Row", str(key)), ("X-Refers-To-Page", None if first_id is None else str(first_id)), ("X-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response")]
    return _headers(pairs, "")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, plain or gzipped (in one member or many), one record in memory at a time."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    count = 0
    while True:
        line = file.readline()
        while line == b"\r\n":
            line = file.readline()
        if not line:
            return
        count += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at record {count}")
        head: dict[str, str] = {}
        name = ""
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record {count} is cut off")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and name:
                head[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError(f"record {count} is cut off")
        yield head, block


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a record's block."""
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def write(records: DataFrame, size: str, path: str, largest: int) -> None:
    """records: a column record, and the payload's size, by which files are kept small enough to be read whole. largest: of the sizes."""
    for name, rows, most in (("small", records.where(F.col(size) <= SMALL), RECORDS_PER_FILE), ("large", records.where(F.col(size) > SMALL), LARGE_PER_FILE)):
        if name == "small" or largest > SMALL:
            out = rows.select("record").write.option("lineSep", CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
            out.option("maxRecordsPerFile", most).text(f"{path}/{name}")


READ_SCHEMA = "row long, page_id long, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"
_READ = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in READ_SCHEMA.split(", "))])


def read(spark: SparkSession, path: str, payloads: bool = True, verify: bool = True) -> DataFrame:
    """The records of all archives below a folder. payload is null unless asked for, and for revisits. verify: compute the digests again."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda h, k: int(h[k]) if k in h else None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, block in parse(data.as_py()):
                    body = payload_of(h, block)
                    kind = h["warc-type"]
                    if verify and kind == "response" and h["warc-payload-digest"] != f"sha1:{digest_of(body)}":
                        raise ValueError(f"payload digest of {h['warc-record-id']} doesn't fit")
                    rows.append((number(h, "x-row"), number(h, "x-page-id"), h.get("warc-target-uri"), h["warc-date"], kind, h["warc-payload-digest"].removeprefix("sha1:"), number(h, "x-payload-length"), number(h, "x-refers-to-page"), body.decode() if payloads and kind == "response" else None))
                    size += len(body) if payloads else 100
                    if size > 16_000_000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(records, READ_SCHEMA)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """A response record for each page, whatever its payload."""
    date = date or now()

    @F.pandas_udf("string")
    def record(row: pd.Series, pid: pd.Series, url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([response_record(k, p, u, t, digest_of(t.encode()), date) for k, p, u, t in zip(row, pid, url, html)])

    # numbers travel as text: beside nulls, pandas would take them for floats
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    cols = [F.monotonically_increasing_id().cast("string"), F.col(id_col).cast("long").cast("string"), F.col(url_col).cast("string"), html]
    x = pages.select(*[c.alias(n) for c, n in zip(cols, ("row", "id", "url", "html"))])
    largest = pages.agg(F.coalesce(F.max(F.octet_length(html)), F.lit(0))).first()[0]
    write(x.select(record("row", "id", "url", "html").alias("record"), F.octet_length("html").alias("size")), "size", path, largest)


def resolve(headers: DataFrame) -> DataFrame:
    """(row, page_id, record_type, first_*) for each header: which response, if any, it repeats.

    headers: row, page_id, url, date, payload_digest, payload_bytes. Firsts are pre-aggregated by digest, then looked up.
    """
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    firsts = headers.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.min_by(F.struct("url", "date"), order).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "first", "of")
    x = lookup(headers, firsts, ["payload_digest", "payload_bytes"], F.struct("row", "page_id"))
    again = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    get = lambda c: F.when(again, F.col(c))
    return x.select("row", "page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), get("first.page_id").alias("first_id"), get("first.row").alias("first_row"), get("of.url").alias("first_url"), get("of.date").alias("first_date"))


def dedup_archives(spark: SparkSession, source: str, target: str, limit: int = 0, date: str | None = None) -> None:
    """Read the archives below source and write them below target with repeated payloads (of ``limit`` bytes or more) as revisits."""
    date = date or now()
    headers = staged(read(spark, source, payloads=False).select("row", "page_id", "url", "date", "payload_digest", "payload_bytes"))
    found = resolve(headers.where(F.col("payload_bytes") >= limit)).where("record_type = 'revisit'").select("row", "first_id", "first_row", "first_url", "first_date")
    largest = headers.agg(F.coalesce(F.max("payload_bytes"), F.lit(0))).first()[0]
    x = lookup(read(spark, source, verify=False), found, ["row"], F.col("row"))  # the headers' pass has verified it

    @F.pandas_udf("string")
    def record(row: pd.Series, pid: pd.Series, url: pd.Series, digest: pd.Series, size: pd.Series, payload: pd.Series, frow: pd.Series, fid: pd.Series, furl: pd.Series, fdate: pd.Series) -> pd.Series:
        return pd.Series([response_record(r, p, u, t, d, date) if fr is None else revisit_record(r, p, u, int(n), d, fr, fi, fu, fd, date) for r, p, u, d, n, t, fr, fi, fu, fd in zip(row, pid, url, digest, size, payload, frow, fid, furl, fdate)])

    again = F.col("first_row").isNotNull()
    texts = [F.col(c).cast("string") for c in ("row", "page_id", "url", "payload_digest", "payload_bytes")]
    x = x.select(record(*texts, F.when(~again, F.col("payload")), *[F.col(c).cast("string") for c in ("first_row", "first_id", "first_url", "first_date")]).alias("record"), F.when(again, 0).otherwise(F.col("payload_bytes")).alias("size"))
    write(x, "size", target, largest)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{base}/all")
    dedup_archives(spark, f"{base}/all", f"{base}/unique")
    return read(spark, f"{base}/unique", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
QUERIES = {"op3_warc": op3_warc}
ORACLE = {
    "op3_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY h, payload_bytes ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{_B32}', 1 + ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> s) & 31)::INT, 1)), '')), '') AS payload_digest,
 CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM f"""
}
