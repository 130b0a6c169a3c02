"""URL filter: host rules, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are shrunk level by level through beta-binomial priors: the suffix
towards the whole table, the registered domain towards its suffix, the host towards its domain. The strength of each
prior is estimated from the spread of its children by the method of moments. A host is blocked if a lower
bound of its posterior bad rate (normal approximation of the beta posterior) is above a threshold, so
a host with few labels is judged by its domain and suffix, and a host without any by the posterior
of its domain, else of its suffix, else of the whole table.

Counts are integers summed in partial aggregates; the join back to pages is broadcast below a counted
bound and salted beyond, so that a host with a third of all pages is spread.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule, and verdict allow unless the
empty host is itself blocked by outcomes; null outcomes don't count; several outcomes of one page all count;
rows that repeat are judged each; without any outcome every url without a rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, staged

#: The rules as set, (rule, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Block where the posterior bad rate exceeds THRESHOLD with about 95 % probability.
THRESHOLD, Z = 0.5, 1.645
STRENGTH = (1.0, 1000.0)  # bounds of a prior's strength, in pseudo-labels
#: Suffixes of two labels under which anyone may register. Others are their last label.
SUFFIXES = "ac.jp ac.nz ac.uk ac.za blogspot.com co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.my com.sg com.tr com.tw com.ua edu.au edu.cn github.io gitlab.io gov.au gov.cn gov.uk ne.jp net.au net.br net.cn net.nz net.uk or.jp or.kr org.au org.br org.cn org.nz org.tw org.uk org.za".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are part of the plan: up to 1,000."""
    if len(rules) > 1000:
        raise ValueError("more than 1,000 rules: deal them out as a table instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> dict[str, Column]:
    """Suffix (of one label, or two where listed) and registered domain (one label more) of a host without user and port."""
    parts = F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")
    two = last(2).isin(*SUFFIXES)
    return {"suffix": F.when(two, last(2)).otherwise(last(1)), "domain": F.when(two, last(3)).otherwise(last(2)), "host": host}


def reputation(outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z, hosts: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, rate, bound, blocked) from outcomes (host, bad: 0 or 1), also for those of hosts (host) that have no outcome."""
    counts = staged(outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k")).select("*", *[c.alias(k) for k, c in _levels(F.col("host")).items() if k != "host"]))
    root = nodes = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit("").alias("key"), (F.col("k") / F.col("n")).alias("rate"))
    parent, above = None, {}
    for level in ("suffix", "domain", "host"):
        up = [] if parent is None else [parent]
        if level == "host":
            kids = counts.select("n", "k", F.col("host").alias("key"), F.col("domain").alias("up"))
        else:
            kids = counts.groupBy(level, *up).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("n", "k", F.col(level).alias("key"), (F.col(parent) if parent else F.lit("")).alias("up"))
        kids = kids.join(nodes.select(F.col("key").alias("up"), F.col("rate").alias("m")), "up")
        # between-children variance left after the binomial part, relative to the binomial variance of one label
        v = kids.agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) ** 2 - F.col("m") * (1 - F.col("m"))).alias("over"), F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("room"))
        share = F.when(F.col("room") > 0, F.col("over") / F.col("room")).otherwise(F.lit(0.0))
        strength = F.when(share <= 0, F.lit(STRENGTH[1])).otherwise(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / share - 1)))
        prior = v.select(strength.alias("s"))
        kids = kids.join(F.broadcast(prior), how="cross")  # one row
        nodes = staged(kids.select("key", "n", "k", ((F.col("k") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).alias("rate"), (F.col("n") + F.col("s")).alias("total")))
        parent, above[level] = level, nodes
    if hosts is not None:
        # no label (n = k = 0): the prior alone. Labelled hosts alone tell how strong it is
        new = hosts.select("host").distinct().join(counts.select("host"), "host", "left_anti").select(*[c.alias(k) for k, c in _levels(F.col("host")).items()])
        for level in ("domain", "suffix"):
            new = lookup(new, above[level].select(F.col("key").alias(level), F.col("rate").alias(f"{level}_rate")), [level], F.col("host"))
        new = new.join(F.broadcast(root.select(F.col("rate").alias("root_rate"))), how="cross").join(F.broadcast(prior), how="cross")  # one row each
        rate, none = F.coalesce("domain_rate", "suffix_rate", "root_rate"), F.lit(0).cast("long")
        nodes = nodes.unionByName(new.select(F.col("host").alias("key"), none.alias("n"), none.alias("k"), rate.alias("rate"), F.col("s").alias("total")))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))
    bound = F.col("rate") - z * sd
    return nodes.select(F.col("key").alias("host"), "n", F.col("k").alias("bad"), "rate", bound.alias("bound"), (bound > threshold).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, **limits) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. outcomes: (page_id, bad)."""
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = p.join(outcomes.select(F.col("page_id").alias("_o_id"), "bad"), F.col("page_id") == F.col("_o_id")).select("host", "bad")
    blocked = reputation(seen, hosts=p.select("host"), **limits).where("blocked").select("host", "blocked")
    x = lookup(p, blocked, ["host"], F.struct("page_id", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return x.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """A page counts as bad where the label of the same id marks low quality or toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)


_NAME = r"string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.')"
_TWO = f"array_to_string({_NAME}[-2:], '.') IN ({', '.join(repr(x) for x in SUFFIXES)})"
_LEVELS_SQL = f"CASE WHEN {_TWO} THEN array_to_string({_NAME}[-2:], '.') ELSE {_NAME}[-1] END AS suffix, array_to_string(CASE WHEN {_TWO} THEN {_NAME}[-3:] ELSE {_NAME}[-2:] END, '.') AS domain"


def _sql() -> str:
    fits = "CASE " + " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))) + " END"
    verdicts = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    lo, hi = STRENGTH
    ctes = [
        rf"p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        "o AS (SELECT host, (quality = 0 OR toxic = 1)::INT AS bad FROM p JOIN labels ON page_id = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL)",
        f"c AS (SELECT host, count(*) AS n, sum(bad) AS k, {_LEVELS_SQL} FROM o GROUP BY host)",
        "n0 AS (SELECT '' AS key, sum(k) / sum(n) AS rate FROM c)",
        "k1 AS (SELECT suffix AS key, sum(n) AS n, sum(k) AS k, rate AS m FROM c, n0 GROUP BY suffix, rate)",
        "k2 AS (SELECT domain AS key, sum(n) AS n, sum(k) AS k, rate AS m FROM c JOIN n1 ON n1.key = suffix GROUP BY domain, suffix, rate)",
        "k3 AS (SELECT host AS key, n, k, rate AS m FROM c JOIN n2 ON n2.key = domain)",
    ]
    for i in (1, 2, 3):
        ctes.append(f"v{i} AS (SELECT CASE WHEN room > 0 THEN over / room ELSE 0 END AS share FROM (SELECT sum(n * (k / n - m) ** 2 - m * (1 - m)) AS over, sum((n - 1) * m * (1 - m)) AS room FROM k{i}))")
        ctes.append(f"s{i} AS (SELECT CASE WHEN share <= 0 THEN {hi} ELSE greatest({lo}, least({hi}, 1 / share - 1)) END AS s FROM v{i})")
        ctes.append(f"n{i} AS (SELECT key, (k + s * m) / (n + s) AS rate, n + s AS total FROM k{i}, s{i})")
    order = {x.split(" ")[0]: x for x in ctes}
    ctes = [order[k] for k in ("p", "o", "c", "n0", "k1", "v1", "s1", "n1", "k2", "v2", "s2", "n2", "k3", "v3", "s3", "n3")]
    # hosts without labels: the prior of the domain, else of the suffix, else of the whole table
    ctes.append(f"u AS (SELECT DISTINCT host, {_LEVELS_SQL} FROM p WHERE host NOT IN (SELECT host FROM c))")
    ctes.append("n4 AS (SELECT key, rate, total FROM n3 UNION ALL SELECT host, coalesce(n2.rate, n1.rate, n0.rate), s FROM u LEFT JOIN n2 ON n2.key = domain LEFT JOIN n1 ON n1.key = suffix, n0, s3)")
    return f"WITH {', '.join(ctes)}, b AS (SELECT key FROM n4 WHERE rate - {Z} * sqrt(rate * (1 - rate) / (total + 1)) > {THRESHOLD}), r AS (SELECT page_id, host, path, {fits} AS rule FROM p) SELECT page_id, host, path, rule, coalesce({verdicts}, CASE WHEN host IN (SELECT key FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM r"


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE = {"op8_url_filter": _sql()}
