"""URL filter by empirical-Bayes host reputation, under a list of explicit rules.

Pages with a label (labels.doc_id = page_id; bad if toxic or of low quality) are counted per host. Hosts with few
labelled pages are shrunk towards their registered domain, domains towards their suffix, suffixes towards the whole
corpus: at each level the children's counts are beta-binomial around their parent's mean, and the strength of that
prior is estimated from all children by moments. A host is blocked if the lower bound of its posterior share of bad
pages exceeds the threshold. Only counts per host are shuffled; a host with many pages is summed before the shuffle.

Explicit rules are matched first: a rule holds for its host and all subdomains where the path starts with the rule's
path; the longest rule wins, of equally long ones the first by name.

Defined cases: NULL urls and urls without `://` have empty host and path and share the reputation of the empty host.
Labels that repeat a page count once, bad if one is. Pages without a label add nothing; hosts without one get their
domain's mean. Without any label the mean is one half. Repeated pages are rows. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

# The explicit rules, host and path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Second-level names under which country suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
BLOCK_ABOVE = 0.5
DEVIATIONS = 1.645
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 1)
    return c.lower_ascii(host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 2)


def suffix_of(host: Column) -> Column:
    names = F.split(host, r"\.")
    two = (F.size(names) > 2) & (F.length(F.element_at(names, -1)) == 2) & F.element_at(names, F.when(F.size(names) > 1, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    return F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, both NULL if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in reversed(ordered):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _level(counts: DataFrame, child: str, parent: str | None, means: DataFrame) -> DataFrame:
    """Posterior of each child around its parent's mean. `counts`: per host; `means`: parent, mean."""
    keys = [child] if parent is None or parent == child else [child, parent]
    own = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    own = own.join(means, parent) if parent else own.join(F.broadcast(means))  # the corpus' mean is one row
    m, n, k = F.col("mean"), F.col("n"), F.col("k")
    noise = n * m * (1 - m)
    excess = F.try_divide(F.sum((k - n * m) * (k - n * m) - noise), F.sum(noise * (n - 1)))
    share = own.agg(F.least(F.lit(0.9), F.greatest(F.lit(0.0001), F.coalesce(excess, F.lit(0.0001)))).alias("rho"))
    joined = own.join(F.broadcast(share))  # one row
    strength = (1 - F.col("rho")) / F.col("rho")
    return joined.withColumn("strength", strength).withColumn("prior", m).withColumn("mean", (k + F.col("strength") * m) / (n + F.col("strength")))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per host: n labelled, k bad, posterior mean and lower bound."""
    bad = labels.groupBy(F.col("doc_id").alias("_page")).agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("_bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(bad, F.col("page_id") == F.col("_page"), "left")
    counts = seen.groupBy("host").agg(F.count("_bad").cast("double").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).cast("double").alias("k"))
    counts = counts.withColumn("suffix", suffix_of(F.col("host")))
    counts = c.materialise(counts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    whole = counts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    suffixes = _level(counts, "suffix", None, whole).select("suffix", "mean")
    domains = _level(counts, "domain", "suffix", suffixes).select("domain", "mean")
    hosts = _level(counts, "host", "domain", domains)
    a, b = F.col("k") + F.col("strength") * F.col("prior"), F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("prior"))
    return hosts.withColumn("bound", F.col("mean") - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).select("host", "n", "k", "mean", "bound")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """Every page with host, path, rule, verdict, and its host's reputation."""
    hosts = reputations(pages, labels)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > block_above, "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "bound")


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(c.table(spark, sf_dir, "pages").select("page_id", "url"), c.table(spark, sf_dir, "labels")).drop("mean", "bound")


def _sql_level(name: str, child: str, parent: str | None, above: str) -> str:
    keys = child if parent is None else f"{child}, {parent}"
    join = f"JOIN {above} USING ({parent})" if parent else f", {above}"
    return f"""
{name}_own AS (SELECT c.*, a.mean AS prior FROM (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM counts GROUP BY {keys}) c
  {join.replace(above, f"(SELECT {parent + ', ' if parent else ''}mean FROM {above}) a")}),
{name}_rho AS (SELECT least(0.9, greatest(0.0001, coalesce(sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior))
  / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0.0001))) AS rho FROM {name}_own),
{name} AS (SELECT o.*, (1 - rho) / rho AS strength, (k + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM {name}_own o, {name}_rho)"""


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{{{i}}}'"
    for i, (h, p) in enumerate((r[0].partition("/")[0], r[0].partition("/")[2]) for r in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))))
_ORDERED = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{c.UPPER}', '{c.LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, string_split(host, '.') AS parts
      FROM p LEFT JOIN bad ON page_id = doc_id GROUP BY host),
s AS (SELECT *, CASE WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS deep FROM h),
counts AS (SELECT host, n, k, array_to_string(parts[-deep:], '.') AS suffix, array_to_string(parts[-(deep + 1):], '.') AS domain FROM s),
whole AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM counts),
{_sql_level("sx", "suffix", None, "whole")},
{_sql_level("dx", "domain", "suffix", "sx")},
{_sql_level("hx", "host", "domain", "dx")},
hosts AS (SELECT host, mean - {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound
          FROM (SELECT *, k + strength * prior AS a, n - k + strength * (1 - prior) AS b FROM hx))
SELECT page_id, host, path, CASE {_FITS.format(*[r[0] for r in _ORDERED])} END AS rule,
       coalesce(CASE {_FITS.format(*[r[1] for r in _ORDERED])} END, CASE WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hosts USING (host)
"""
