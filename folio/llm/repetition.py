"""Quality rule: repetition inside a text, by a suffix array over its words.

The suffixes of all texts of an Arrow batch are sorted together by prefix doubling (only suffixes
that still share a rank are sorted again), the longest common prefix of neighbours is read off the
stored ranks or counted along the texts, and LCP intervals give the maximal repeated word sequences. Their spans are united;
a text is rejected when they cover too large a fraction of its words or when one is too long. Of the intervals that hold
a suffix the innermost is the longest, and its length is the larger of the suffix's two neighbouring LCPs: so spans are taken
from these, and the intervals themselves are listed only to count the maximal repeats.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged
each on its own; nothing is read but the text, so other columns and null ids don't matter. The work is
bounded by a group of whole texts of about ``GROUP_WORDS`` words (one longer text is a group by itself, of some 150 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words_of

#: Production thresholds: repeats count from MIN_WORDS words on.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 10, 0.4, 150
GROUP_WORDS = 400_000
#: Ranks that are kept: by the first 1, 2, 4, ... words.
LEVELS = 4
_STEP = 100_000
SYMBOLS = "#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_maximal long, covered_words long, longest_repeat long, kept boolean"


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many texts at once, and the ranks by the first 1, 2, 4 and 8 words.

    ids: word ids, equal only within one text (other texts have other ids); ends: for each position
    the end of its text. ranks[j] has one more element, for positions past the end.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable").astype(np.int32)  # a group has fewer words than 2 ** 31
    key = ids[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    ranks, h = [rank], 1
    while True:
        r = rank[sa]
        lone = np.ones(n, bool)
        lone[1:] &= r[1:] != r[:-1]
        lone[:-1] &= r[1:] != r[:-1]
        place = np.flatnonzero(~lone).astype(np.int32)
        if not len(place):
            return sa, ranks
        at, first = sa[place], r[place]
        nxt = at + h
        second = np.where(nxt < ends[at], rank[np.minimum(nxt, n)], -1)
        order = np.argsort(first.astype(np.int64) * (n + 1) + second + 1, kind="stable")
        at, first, second = at[order], first[order], second[order]
        sa[place] = at  # a group's places are one run, so sorting within groups keeps places
        head = np.ones(len(at), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy() if len(ranks) < LEVELS else rank if rank is not ranks[-1] else rank.copy()
        rank[at] = np.maximum.accumulate(np.where(head, place, 0))
        if len(ranks) < LEVELS:
            ranks.append(rank)
        h *= 2


def neighbour_lcp(ids: np.ndarray, sa: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray, least: int = 2) -> np.ndarray:
    """lcp[i]: words that suffixes sa[i-1] and sa[i] have in common, 0 where below ``least``.

    Short ones are read off the ranks. Longer ones are counted in the order of the texts, each starting from one less than that of the suffix
    before, which keeps the counting linear and needs no ranks by more words.
    """
    n = len(sa)
    lcp = np.zeros(n, np.int32)
    start = ranks[min(1 if least >= 2 else 0, len(ranks) - 1)]
    i = np.flatnonzero(start[sa[1:]] == start[sa[:-1]]) + 1
    a, b = sa[i - 1].copy(), sa[i].copy()
    enda, endb = ends[a], ends[b]
    got = np.zeros(len(i), np.int32)
    for j in range(len(ranks) - 1, -1, -1):
        ok = (a < enda) & (b < endb)
        eq = ok & (ranks[j][np.minimum(a, n)] == ranks[j][np.minimum(b, n)])
        step = eq * np.int32(1 << j)
        a, b, got = a + step, b + step, got + step
    got[got < least] = 0
    lcp[i] = got
    if len(ranks) == LEVELS:
        hot = np.flatnonzero(lcp >= 1 << (LEVELS - 1))
        hot = hot[np.argsort(sa[hot])]
        at, other = sa[hot], sa[hot - 1]
        most = np.minimum(ends[at] - at, ends[other] - other)
        words = ids.tolist() if len(hot) else []
        h, before = 0, -2
        for k in range(0, len(hot), _STEP):
            part, long = slice(k, k + _STEP), []
            for x, y, end in zip(at[part].tolist(), other[part].tolist(), most[part].tolist()):
                h = max(h - 1, 1 << (LEVELS - 1)) if x == before + 1 else 1 << (LEVELS - 1)
                while h < end and words[x + h] == words[y + h]:
                    h += 1
                before = x
                long.append(h)
            lcp[hot[part]] = long
    return lcp


def lcp_intervals(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, lo, hi) of each LCP interval of ``least`` words or more whose occurrences sa[lo:hi+1]
    differ in the word before: the maximal repeats. before: an id of the word before each position, unique at a text's start."""
    found = []
    mixed = -1
    join = lambda x, y: x if x == y else mixed
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return found
    for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
        stack: list[list] = []  # length, lo, left word
        for i, v in zip(run.tolist(), lcp[run].tolist()):
            lo, left = i - 1, int(before[sa[i - 1]])
            while stack and stack[-1][0] > v:
                length, lo, was = stack.pop()
                left = join(was, left)
                if left == mixed:
                    found.append((length, lo, i - 1))
            if stack and stack[-1][0] == v:
                stack[-1][2] = join(stack[-1][2], left)
            else:
                stack.append([v, lo, left])
        left = int(before[sa[run[-1]]])
        while stack:
            length, lo, was = stack.pop()
            left = join(was, left)
            if left == mixed:
                found.append((length, lo, int(run[-1])))
    return found


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the union of the spans covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:n]) > 0


def group_stats(groups: list[list[str]], min_words: int = MIN_WORDS, maximal_too: bool = True) -> list[tuple[int, int | None, int, int]]:
    """For each text (a list of words): words in repeated 3-word windows, maximal repeats (None unless asked for), words they cover, the longest."""
    sizes = np.array([len(g) for g in groups], np.int64)
    n = int(sizes.sum())
    if not n:
        return [(0, 0, 0, 0)] * len(groups)
    codes = pd.factorize(np.array([w for g in groups for w in g], dtype=object))[0].astype(np.int64)
    doc = np.repeat(np.arange(len(groups), dtype=np.int32), sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    ends = bounds[1:].astype(np.int32)[doc]
    ids = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    sa, ranks = suffix_ranks(ids, ends)
    lcp = neighbour_lcp(ids, sa, ranks, ends)
    del ranks
    most = np.zeros(n, np.int32)  # of each position: the innermost interval's length
    up = np.append(lcp[1:], 0)
    most[sa] = np.maximum(lcp, up)
    starts = np.arange(n, dtype=np.int32)
    three = covered(starts[most >= 3], np.full(int((most >= 3).sum()), 3), n)
    long = most >= min_words
    spans = covered(starts[long], most[long], n)
    before = np.empty(n, np.int64)
    before[1:] = codes[:-1]
    firsts = bounds[:-1][sizes > 0]
    before[firsts] = int(codes.max()) + 1 + np.arange(len(firsts))
    maximal = [None] * len(groups)
    if maximal_too:
        maximal = [0] * len(groups)
        for _, lo, _ in lcp_intervals(sa, lcp, before, min_words):
            maximal[doc[sa[lo]]] += 1
    add = lambda x: np.add.reduceat(np.append(x.astype(np.int64), 0), bounds[:-1]) * (sizes > 0)
    longest = np.zeros(len(groups), np.int64)
    np.maximum.at(longest, doc[long], most[long])
    return list(zip(add(three).tolist(), maximal, add(spans).tolist(), longest.tolist()))


def _judged(texts: list[str | None], min_words: int, max_covered: float, max_longest: int, maximal_too: bool) -> list[tuple]:
    rows, groups, size = [], [], 0

    def flush():
        nonlocal groups, size
        for (text, ws), (rep, maximal, cov, longest) in zip(groups, group_stats([ws for _, ws in groups], min_words, maximal_too)):
            seen, dup = set(), 0
            for line in text.split("\n"):
                if line in seen:
                    dup += bool(words_of(line))
                else:
                    seen.add(line)
            n = len(ws)
            failed = n < 50 or 100 * rep > 50 * n
            rows.append((n, sum(map(len, ws)), sum(map(text.count, SYMBOLS)), dup, rep, failed, maximal, cov, longest, not failed and cov <= max_covered * n and longest <= max_longest))
        groups, size = [], 0

    for text in texts:
        text = text if isinstance(text, str) else ""
        ws = words_of(text)
        groups.append((text, ws))
        size += len(ws)
        if size >= GROUP_WORDS:
            flush()
    flush()
    return rows


def repetition(text: Column, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, maximal: bool = True) -> Column:
    """A struct column with the counts and the verdict ``kept`` for each text; maximal=False leaves the number of maximal repeats null, which takes a walk over all intervals."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_judged(batch.tolist(), min_words, max_covered, max_longest, maximal), columns=names).astype({"n_maximal": "Int64"})

    return judge(text.cast("string"))


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of docs: the id and the columns of SCHEMA. No shuffle: each text is judged where it is read."""
    return docs.select(F.col(id_col).alias("doc_id"), repetition(F.col(text_col), **limits).alias("_q")).select("doc_id", "_q.*")


def drop_repetitive(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """docs, all columns, without the rejected rows."""
    kept = "_folio_kept"
    return docs.select("*", repetition(F.col(text_col), maximal=False, **limits)["kept"].alias(kept)).where(F.col(kept)).select(*[docs[c] for c in docs.columns])


def op1_repetition(spark, sf_dir: str) -> DataFrame:
    return staged(judge_repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"), maximal=False).drop("n_maximal"))  # written once, a few texts to an Arrow batch


#: The same in SQL: a repeat of k words or more covers exactly the k-word windows found twice or more, and
#: a repeat longer than m words exists exactly if a window of m + 1 words is found twice.
_BASE = r"""
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS r FROM documents),
three AS (SELECT r, i, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM three QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n3 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY r),
win AS (SELECT r, i, array_to_string(ws[i:i+MIN-1], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - MIN + 2)) AS i FROM w)),
lrep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
nl AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + MIN)) AS p FROM lrep) GROUP BY r),
over AS (SELECT DISTINCT r FROM (SELECT r, array_to_string(ws[i:i+TOP], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - TOP + 1)) AS i FROM w)) QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
ln AS (SELECT r, l, row_number() OVER (PARTITION BY r, l) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w)),
dl AS (SELECT r, count(*) AS n FROM ln WHERE k > 1 AND regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r)
""".replace("MIN", str(MIN_WORDS)).replace("TOP", str(MAX_LONGEST))
JUDGED_SQL = f"""WITH {_BASE}, q AS (
SELECT r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
 coalesce(n3.n, 0)::BIGINT AS n_repeat_words, (len(ws) < 50 OR 100 * coalesce(n3.n, 0) > 50 * len(ws)) AS base_failed,
 coalesce(nl.n, 0)::BIGINT AS covered_words, (over.r IS NOT NULL) AS too_long
FROM w LEFT JOIN dl USING (r) LEFT JOIN n3 USING (r) LEFT JOIN nl USING (r) LEFT JOIN over USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words,
 (NOT base_failed AND covered_words <= {MAX_COVERED} * n_words AND NOT too_long) AS kept FROM q"""


def op1_digest(spark, sf_dir: str) -> DataFrame:
    return op1_repetition(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "kept")


QUERIES = {"op1_repetition": op1_digest}
ORACLE = {"op1_repetition": JUDGED_SQL}
