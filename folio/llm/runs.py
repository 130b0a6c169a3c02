"""Runs of repeated words, found in linear time from Lyndon arrays.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping that period.
For both orders of the words (ascending and descending) one pass from left to right computes, for each suffix, the next
and the previous smaller suffix, and how far each such pair of suffixes agrees. Three facts keep the pass linear:

* on the path of previous smaller suffixes the agreement with a new suffix never shrinks until the path ends, and is known
  without a look at the words unless it equals the agreement stored on the path's edge;
* the stretch that reaches furthest right among all matched ones is a copy of an earlier stretch, so a pair inside it
  agrees as far as the pair one shift before, already stored (a pair whose agreement reaches the stretch's end goes on from there);
* so words are compared for equality only at a new right end, or once per pair.

In one of the two orders, the word before the run's end being given, every Lyndon root of a run ends where the next smaller
suffix begins. An edge that agrees for twice its length or more is a root of a run of high exponent; the first
root of each run is extended to the left by less than a period (words looked at there: at most the sum of the periods of the
runs found, the periods of such runs at one place at least doubling). No suffix arrays or trees, no hashes of words: words are only compared.

Defined cases: null and empty texts have no words and no runs; repeated rows and rows with null ids are treated each on
its own; a word is as long as it likes; time is linear and memory some 150 bytes a word of the longest text, whole texts going to one
task each and Arrow batches holding few of them. Only the id and the text are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, words_of

#: Production limits: a run is this many periods long, and this many words.
MIN_EXPONENT, MIN_LENGTH = 4, 6
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _roots(s: list, up: bool, times: int) -> list[tuple[int, int, int]]:
    """(i, j, agree): edges from a suffix i to the next smaller one j whose suffixes agree for ``times`` times j - i words or more.

    up: words in ascending order, else in descending order; a text's end is smaller than any word in both.
    """
    n = len(s)
    before, before_lce = [-1] * n, [0] * n  # previous smaller suffix
    after, after_lce = [n] * n, [0] * n  # next smaller suffix
    found: list[tuple[int, int, int]] = []
    copy, shift, reach = 0, 0, 0  # s[copy:reach] == s[copy - shift : reach - shift], of all matched stretches the furthest right
    for i in range(1, n):
        p, lce = i - 1, 0
        while True:
            at = i + lce
            if at < reach and p >= copy:
                q, k = p - shift, i - shift
                lce = after_lce[q] if after[q] == k else before_lce[k]
                at = i + lce
                if at >= reach:
                    at = reach
                    while at < n and s[p + at - i] == s[at]:
                        at += 1
                    lce = at - i
                    copy, shift, reach = i, i - p, at
            elif at < n and s[p + lce] == s[at]:
                at += 1
                while at < n and s[p + at - i] == s[at]:
                    at += 1
                lce = at - i
                if at > reach:
                    copy, shift, reach = i, i - p, at
            if at < n and (s[p + lce] > s[at]) is not up:
                before[i], before_lce[i] = p, lce
                break
            # suffix i is smaller than p, and than all on the path that agree with the one above them for longer
            while True:
                after[p], after_lce[p] = i, lce
                if lce and lce >= times * (i - p):
                    found.append((p, i, lce))
                stored, p = before_lce[p], before[p]
                if p < 0 or lce >= stored:
                    break
            if p < 0:
                break
            if lce > stored:
                before[i], before_lce[i] = p, stored
                break
    # of the roots of one run only the first
    return [(i, j, lce) for i, j, lce in found if i + i < j or after[i + i - j] != i or after_lce[i + i - j] != lce + j - i]


def word_runs(words: list, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``min_length`` words and ``min_exponent`` (3 at least) periods or more, by start, then period."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    if len(words) < min_exponent or len(words) < min_length:
        return []
    found = set()
    for up in (True, False):
        for i, j, agree in _roots(words, up, min_exponent - 2):
            period, start = j - i, i
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            length = j + agree - start
            if length >= min_exponent * period and length >= min_length:
                found.add((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    kept, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        if hi > at:
            kept += words[at : max(at, lo)]
            at = hi
    return kept + words[at:]


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, prepare: Callable[[int | None, list[str]], list[str]] | None = None
) -> DataFrame:
    """One row per row of docs: id, number of words, its runs by start and period, and the words that stay, joined by one space.

    prepare: called in the tasks with the id and the words, gives the words to use. No shuffle: a text is treated where it is read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_small_batches(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                if prepare:
                    words = prepare(doc_id, words)
                runs = word_runs(words, min_exponent, min_length)
                rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], " ".join(collapse(words, runs) if runs else words)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), _RUNS, pa.string()))], ["doc_id", "n_words", "runs", "collapsed"])

    _RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(kernel, SCHEMA)


def strongest(runs):
    """Of a column of runs, that of the greatest length / period; of equal ones that which starts first, then that of the shorter period."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  by start and period in order, so ties keep the first
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """What the query makes of every tenth text: from some word on, the first of these words repeat to the end."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=periodic_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def runs_sql(levels: int = 15) -> str:
    """The same in SQL, another way: stretches of 2 ** k words are named by doubling, the next place of the same stretch gives a period that is no longer than it, and
    for each period of a text all stretches with that period are listed. Finds periods below 2 ** levels, all that texts of four times as many words can have."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
 lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, one: CASE WHEN v & one = one THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""
    grams = ",\n".join(f"h{k} AS (SELECT r, i, md5(h || lead(h, {2 ** (k - 1)}) OVER (PARTITION BY r ORDER BY i)) AS h FROM h{k - 1} WHERE h IS NOT NULL)" for k in range(1, levels + 1))
    gaps = " UNION ALL ".join(f"SELECT r, g FROM (SELECT r, lead(i) OVER (PARTITION BY r, h ORDER BY i) - i AS g FROM h{k + 1} WHERE h IS NOT NULL) WHERE g >= {2 ** k} AND g < {2 ** (k + 1)}" for k in range(levels))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {crc} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
e AS (SELECT r, doc_id, h, ws, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (SELECT r, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT r, h, ws, a, p, unnest(range(0, n)) AS i FROM p)),
h0 AS (SELECT r, i, md5(w) AS h FROM w),
{grams},
gap AS (SELECT DISTINCT r, g FROM ({gaps})),
same AS (SELECT g.r, g.g, x.i, x.i - row_number() OVER (PARTITION BY g.r, g.g ORDER BY x.i) AS island FROM gap g JOIN w x ON x.r = g.r JOIN w y ON y.r = g.r AND y.i = x.i + g.g AND y.w = x.w),
long AS (SELECT r, g AS period, min(i) AS start, count(*) + g AS length FROM same GROUP BY r, g, island HAVING count(*) + g >= greatest(6, 4 * g)),
run AS (SELECT * FROM long a WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.r = a.r AND b.period < a.period AND b.start <= a.start AND b.start + b.length >= a.start + a.length)),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
 sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


QUERIES = {"op11_runs": op11_runs}
ORACLE = {"op11_runs": runs_sql()}
