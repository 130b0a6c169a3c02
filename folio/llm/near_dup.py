"""Near-duplicate groups by bottom-k sketches from one hash function.

Each text becomes the set of its distinct word shingles, hashed to 64 bits; its sketch is the ``K``
smallest hashes. Texts with equal sets are folded into one representative first. Inverted lists of
retained values generate candidates: a pair that is similar enough shares at least ``overlap`` retained
values, so it shares ``SHARED`` among the rarest ``len - overlap + SHARED`` of each (by their exact numbers over all
representatives), and only those are listed. The sketch of the union estimates the similarity and drops most
candidates; the rest is decided on the full sets.

Pairs are never rows of a table. First every set meets the smallest member of its lists that it shares most
values with; the links found join sets into components. Then members of a list meet if they are in different components,
and a pair meets once, in the list of its first shared value. A long list is cut into blocks; a task compares the
members of one list or of two blocks, first by their listed values, and only those with a candidate get their texts. So a
group of near copies costs a number of rows linear in its size, no task grows with a group, and no link between components
is lost. What remains quadratic is the comparing, inside tasks, of many texts that share a list and are alike, but not enough.

Chance: for sets within K the needed overlap is certain; beyond, a pair at the threshold has fewer than NEEDED
of K values in common with probability below 1e-6 (binomial), and falls below the estimate's margin as rarely.

Defined cases: null, empty and blank texts have empty sets and stay alone; a text of fewer words than a shingle
is one shingle, its whole sequence; rows that repeat an id are one node, linked where
any of their texts is (each row keeps its own n_shingles); null ids can't be named as a component, so they stay alone with a
null component and are kept. ``drop_near_duplicates`` takes rows that share an id but not the text for documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, in_small_batches, join_counted, split_words, staged, table_bytes, unstage

K = 64
NEEDED = 35  # of K, where sets are larger than SMALL: P(Bin(64, 0.8) < 35) < 1e-6
SMALL = 60
MARGIN = 0.25  # the estimate's slack: five standard deviations at K = 64
THRESHOLD = 80  # per cent
PAD = np.uint64(2**64 - 1)  # no shingle hashes to it but by a chance of 2 ** -64
SHARED = 3  # listed values that a pair shares at least
COLUMNS = 1024  # values that a comparison of blocks takes at once
BLOCK, BLOCK_SHINGLES = 500, 1_000_000  # members of a block, and elements of their sets together
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words; a shorter text is one shingle."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = names[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)

    def shingles(h: np.ndarray, n: int) -> np.ndarray:
        out = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            out = _mix(out * _M1 + h[i : len(h) - n + 1 + i])
        return out

    every = shingles(h, size)  # also across texts, where no text starts
    sets, at = [], 0
    for k in counts.tolist():
        out = np.sort(every[at : at + k - size + 1]) if k >= size else shingles(h[at : at + k], k) if k else h[:0]
        sets.append(out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out)
        at += k
    return sets


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of pairs from the bottom-k sketch of the union of their sketches. a, b: one padded sketch per row."""
    both = np.sort(np.concatenate((a, b), 1), 1)
    real = both != PAD
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    distinct = np.cumsum(real & ~again, 1)
    size = np.minimum(distinct[:, -1], K)
    return (again & (distinct <= K)).sum(1) / np.maximum(size, 1)


def padded(sketches) -> np.ndarray:
    """Sketches (lists of signed values, in unsigned order) as rows of K unsigned values, padded with PAD."""
    lens = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.full((len(lens), K), PAD, np.uint64)
    if len(lens):
        out[np.arange(K)[None, :] < lens[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in sketches]).view(np.uint64)
    return out


def overlap(n: Column, threshold: int) -> Column:
    """Retained values that a set of n elements shares at least with any set that is similar enough."""
    return F.when(n <= SMALL, F.ceil(n * threshold / 100)).otherwise(F.lit(NEEDED)).cast("int")


SKETCH = "doc_id long, n_shingles long, sig1 long, sig2 long, sketch array<long>"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_small_batches(batches):
            n, s1, s2, sk = [], [], [], []
            for s in word_sets(b.column("text"), size):
                raw = s.tobytes()
                n.append(len(s))
                s1.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                s2.append(xxhash.xxh64_intdigest(raw, 7) - (1 << 63))
                sk.append(s[:K].view(np.int64))
            cuts = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sk]))), pa.int32())
            values = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sk) if sk else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), values], schema=_SKETCH)

    return run


def listed_values(reps: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, n, v): each set's rarest retained values, so many that similar sets share SHARED of them. Staged.

    reps: (doc_id, n_shingles, sketch). Values that one set alone retains are its rarest, and are not listed.
    """
    # a set of so few elements is only similar to itself
    values = reps.where(100 * F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1)).select("doc_id", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    counts = staged(values.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    common = join_counted(values, counts, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("size", "v"))).alias("vs"))  # K values at most
    most = F.size("vs") - overlap(F.col("n"), threshold) + SHARED  # len - overlap + SHARED, less the values of this set alone
    got = common.select("doc_id", "n", F.slice("vs", 1, F.greatest(F.lit(0), most)).alias("vs")).where(F.size("vs") >= SHARED)
    lists = staged(got.select("doc_id", "n", F.explode("vs.v").alias("v")))
    unstage(counts)
    return lists


def _at(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with the texts of their ids; texts that none asks for are left where they are."""
    if table_bytes(rows) <= 24_000_000:
        return texts.join(F.broadcast(rows), "doc_id")
    ids = rows.select("doc_id").distinct()
    if ids.count() <= 1_000_000:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(rows, "doc_id")


def _link(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def star_links(star: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of pairs (a, b), one for each b, those that are linked. Staged. A head a comes before its members, BLOCK or so at a time."""
    counts = staged(star.groupBy("a").agg(F.count(F.lit(1)).alias("size")))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).cast("int")
    dealt = staged(join_counted(star, counts, "a").select("a", "b", part.alias("part")))
    asked = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("member")).unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("member")).distinct())
    rows = _at(texts, staged(asked)).repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for b in in_small_batches(batches):
            found = []
            for i, s, a, part, member in zip(b.column("doc_id").to_pylist(), word_sets(b.column("text"), size), *(b.column(c).to_pylist() for c in ("a", "part", "member"))):
                if not member:
                    heads = [*heads, s] if now == (a, part) else [s]
                    now = (a, part)
                    continue
                mine = s[:K]
                for h in heads:
                    if estimates(padded([mine.view(np.int64)]), padded([h[:K].view(np.int64)]))[0] >= threshold / 100 - MARGIN:
                        inter = len(np.intersect1d(s, h, True))
                        if 100 * inter >= threshold * (len(s) + len(h) - inter):
                            found.append((a, i))
                            break
            yield _link(found)

    links = staged(rows.mapInArrow(run, "a long, b long").distinct())
    unstage(counts, dealt)
    return links


# --- lists ------------------------------------------------------------------

GROUP = ["v", "i", "j"]  # a list's value, and two of its blocks
MEMBER = "v long, i int, j int, doc_id long, c long, n long, vs array<long>, block int"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal GROUP columns. Rows come sorted."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in GROUP], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[x])
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(x, y - x))
            last = key
    if held:
        yield pa.concat_tables(held)


def candidate_pairs(rows: pa.Table, threshold: int) -> np.ndarray:
    """Symmetric matrix: which rows of a group are of different components and of similar size, share SHARED listed values, and have no
    earlier list in common, in which they meet as well; and, between blocks, are of different ones."""
    v, i, j = (rows.column(c)[0].as_py() for c in GROUP)
    c, n, ids = (rows.column(k).to_numpy() for k in ("c", "n", "doc_id"))
    ok = (c[:, None] != c[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]))
    if i != j:
        side = rows.column("block").to_numpy()
        ok &= side[:, None] != side[None, :]
    ok &= ids[:, None] != ids[None, :]
    if not ok.any():
        return ok
    lists = rows.column("vs").combine_chunks()
    values, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(c)), np.diff(cuts))
    names, code, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times[code] > 1  # others are shared by none
    row, code = row[often], code[often]
    shared, early = (np.zeros(ok.shape, np.float32) for _ in range(2))
    for lo in range(0, len(names), COLUMNS):
        here = (code >= lo) & (code < lo + COLUMNS)
        has = np.zeros((len(c), min(COLUMNS, len(names) - lo)), np.float32)
        has[row[here], code[here] - lo] = 1
        shared += has @ has.T
        if names[lo] < v:
            has = has[:, names[lo : lo + COLUMNS] < v]
            early += has @ has.T
    return ok & (shared >= SHARED) & (early == 0)


def _with_candidates(threshold: int):
    """The rows of each group that are in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            keep = candidate_pairs(rows, threshold).any(1)
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _group_links(size: int, threshold: int):
    """Links (a, b) of each group that join different components; no more links than rows."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        ok = np.triu(candidate_pairs(rows, threshold))
        ids, labels = rows.column("doc_id").to_pylist(), rows.column("c").to_pylist()
        parent = {c: c for c in labels}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        elements = word_sets(rows.column("text").combine_chunks(), size)
        sketches = padded([e[:K].view(np.int64) for e in elements])
        lens = np.fromiter(map(len, elements), np.int64, len(elements))
        found = []
        for x in np.flatnonzero(ok.any(1)).tolist():
            mine = root(labels[x])
            y = np.array([k for k in np.flatnonzero(ok[x]).tolist() if root(labels[k]) != mine], np.int64)
            if len(y):
                y = y[estimates(np.broadcast_to(sketches[x], (len(y), K)), sketches[y]) >= threshold / 100 - MARGIN]
            if not len(y):
                continue
            every = np.concatenate([elements[k] for k in y])
            at = np.minimum(np.searchsorted(elements[x], every), lens[x] - 1)
            inter = np.add.reduceat((elements[x][at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(lens[y])[:-1])))
            for k in y[100 * inter >= threshold * (lens[x] + lens[y] - inter)].tolist():
                p, q = root(labels[x]), root(labels[k])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((ids[x], ids[k]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield _link(links(rows))

    return run


def list_links(members: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links between different components among the members (doc_id, n, c, v) of lists. Staged."""
    rows = members.withColumn("vs", F.collect_list("v").over(Window.partitionBy("doc_id"))).where(F.size("vs") >= SHARED)  # K rows a document at most
    rows = staged(rows)
    count = F.count(F.lit(1))
    lists = rows.groupBy("v").agg(count.alias("size"), F.greatest(F.ceil(count / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("size > 1")
    lists = staged(lists)
    x = join_counted(rows, lists, "v").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("v", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "doc_id", "c", "n", "vs", "block")
    in_order = lambda t: t.repartition(*GROUP).sortWithinPartitions(*GROUP, "doc_id")
    met = staged(in_order(x).mapInArrow(_with_candidates(threshold), MEMBER))
    unstage(rows, lists)
    links = staged(in_order(_at(texts, met)).select("text", *[c.split()[0] for c in MEMBER.split(", ")]).mapInArrow(_group_links(size, threshold), "a long, b long").distinct())
    unstage(met)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. threshold: per cent, 80 or more (K and NEEDED are made for these)."""
    if not THRESHOLD <= threshold <= 100:
        raise ValueError(f"a threshold from {THRESHOLD} to 100, not {threshold}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = staged(rows.mapInArrow(_sketches(shingle), SKETCH))
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "sig1", "sig2"]
    folded = staged(named.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = named.join(folded.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("rep")), [F.col("doc_id") == F.col("rep"), *[F.col(k) == F.col(f"_{k}") for k in key]])
    reps = staged(reps.select("doc_id", *key, "sketch").dropDuplicates(["doc_id", *key]).drop("sig1", "sig2"))
    lists = listed_values(reps, threshold)
    unstage(reps)
    fits = lambda x, y: (F.lit(100) * F.least(x, y)) >= (F.lit(threshold) * F.greatest(x, y))
    heads = staged(lists.groupBy("v").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = staged(join_counted(lists, heads, "v"))
    unstage(lists, heads)
    # first each set meets the one head that it shares most values with; one pair per set, whatever the size of its group
    met = shared.where((F.col("doc_id") != F.col("head.doc_id")) & fits(F.col("n"), F.col("head.n"))).groupBy(F.col("doc_id").alias("b"), F.col("head.doc_id").alias("a")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
    star = staged(met.groupBy("b").agg(F.max(F.struct(F.col("k"), (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b"))
    stars = star_links(star, rows, shingle, threshold)
    first = staged(components(stars))
    # then members of a list meet if they are still in different components
    labelled = staged(shared.join(first, F.col("doc_id") == F.col("node"), "left").select("v", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")))
    open_lists = staged(labelled.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("v", "size"))
    crossed = list_links(join_counted(labelled, open_lists, "v").select("doc_id", "n", "c", "v"), rows, shingle, threshold)
    unstage(shared, star, first, labelled, open_lists)
    # a document's node is its id; equal sets are linked with their representative. No aggregation by the set follows, so that a hot set's rows are split by adaptive execution
    member = named.join(folded, key).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    comps = staged(components(stars.unionByName(crossed).unionByName(member)))
    unstage(stars, crossed)
    out = sketched.select("doc_id", "n_shingles").join(comps, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each group: that with the smallest id. Rows with null ids all stay.

    A document is a row's id and text; of rows equal in both, one stays.
    """
    parts = [F.col(id_col), F.col(text_col).cast("string")]
    named = docs.where(F.col(id_col).isNotNull()).select(F.struct("*").alias("row"), parts[0].cast("long").alias("id"), parts[1].alias("text"), F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit("second"), *parts).alias("key2"))
    # two documents may have one key by chance: told apart by a second hash, they get keys of their own
    clash = staged(named.groupBy("key").agg(F.min("key2").alias("lo"), F.max("key2").alias("hi")).where("lo <> hi").select(F.col("key").alias("_clash")))
    if not clash.isEmpty():
        named = named.join(clash, F.col("key") == F.col("_clash"), "left").withColumn("key", F.when(F.col("_clash").isNull(), F.col("key")).otherwise(F.xxhash64("key", "key2"))).drop("_clash")
    groups = staged(near_duplicates(named, "key", "text", shingle, threshold).select(F.col("doc_id").alias("key"), F.col("component_id").alias("g")))
    # the smallest id of each group, and how many rows have its key
    sized = groups.groupBy("key", "g").agg(F.count(F.lit(1)).alias("rows"))
    ids = staged(named.select("id", "key").distinct().join(sized, "key"))
    first = staged(ids.groupBy("g").agg(F.min(F.struct("id", "key", "rows")).alias("first")).select("first.key", "first.rows").withColumnsRenamed({"key": "_key", "rows": "_rows"}))
    kept = named.join(first, F.col("key") == F.col("_key"))
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.to_json("row")))  # as text, since a map has no hash
    once = kept.where("_rows = 1").select("row.*")
    again = kept.where("_rows > 1").withColumn("_k", F.row_number().over(order)).where("_k = 1").select("row.*")
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SET = r"""SELECT doc_id, coalesce(CASE WHEN len(w) >= {0} THEN list_distinct(list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i+{0}-1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, []) AS s
 FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {1})"""


def oracle_ctes(docs: str, shingle: int, threshold: int = THRESHOLD) -> str:
    """CTEs sets(doc_id, s) and comp(doc_id, c), brute force over shared shingles. Needs WITH RECURSIVE."""
    return f"""sets AS ({_SET.format(shingle, docs)}),
gram AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * k >= {threshold} * (na + nb - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)"""


QUERIES = {"op5_near_dup": op5_near_dup}
ORACLE = {"op5_near_dup": f"WITH RECURSIVE {oracle_ctes('documents', 2)} SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN comp USING (doc_id)"}
