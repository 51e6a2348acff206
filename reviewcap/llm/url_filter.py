"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, by registered domain (the last
two labels) and by suffix (the last label).  Each level is a beta-binomial
whose prior mean is the level above it and whose prior weight comes from the
data, by the method of moments over that level's groups: a host with few
labels is shrunk to its domain, a domain to its suffix, a suffix to the whole.
A host is blocked when the lower bound of its posterior rate of bad pages is
above a limit, that is, when it is credibly bad and not merely unlucky.

Defined results: a null address or one without ``://`` has an empty host and
path, no rule, and belongs to the empty host, which is judged like others; a
page without outcome counts for no host; rows that repeat a page are judged
each; with no label at all the prior rate is one half and nothing is blocked;
empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# Fixed values: (verdict, host, beginning of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0  # of a prior, in pages
Z = 1.645  # one-sided 95 % bound
LIMIT = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _weight(groups: DataFrame) -> DataFrame:
    """weight: prior pages by the method of moments over rows (bad, n, mean: the prior's mean of the group)."""
    n, rate, mean = F.col("n"), F.col("bad") / F.col("n"), F.col("mean")
    # E[(rate - mean)^2] = mean (1 - mean) (1/n + (1 - 1/n) / (weight + 1)), summed with weights n.
    spread = F.sum(n * (rate - mean) * (rate - mean))
    chance = F.sum(mean * (1 - mean))
    most = F.sum((n - 1) * mean * (1 - mean))
    own = F.when(spread - chance <= 0, F.lit(MOST_WEIGHT)).otherwise(most / (spread - chance) - 1)
    return groups.agg(F.least(F.greatest(F.coalesce(own, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))


def host_reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """host, n, bad, rate, bound, blocked for every host of ``outcomes`` (host, bad: 1, 0 or null)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(F.lit(0.5)).alias("mean"))

    def shrunk(groups: DataFrame) -> DataFrame:
        """alpha, beta of each group's posterior; ``mean`` is its prior's."""
        joined = groups.withColumn("weight", _weight(groups.filter("n > 0")).scalar())
        prior = F.col("mean") * F.col("weight")
        return joined.withColumn("alpha", prior + F.col("bad")).withColumn("beta", F.col("weight") - prior + F.col("n") - F.col("bad"))

    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    suffixes = shrunk(suffixes.withColumn("mean", whole.scalar()))
    domains = shrunk(domains.join(suffixes.select("suffix", mean.alias("mean")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("suffix", "domain", mean.alias("mean")), ["suffix", "domain"]))
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    bound = F.greatest(mean - F.lit(z) * deviation, F.lit(0.0))
    return hosts.select("host", "n", "bad", mean.alias("rate"), bound.alias("bound"), (bound > limit).alias("blocked"))


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = "bad", rules: tuple = RULES,
                z: float = Z, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled of every page; ``bad_col``: its outcome (1, 0, null: none)."""
    url = col(url_col).cast("string")
    bad = col(bad_col).cast("int") if bad_col else F.lit(None).cast("int")
    rows = pages.select(col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), bad.alias("bad"))
    hosts = host_reputation(rows.select("host", "bad"), z, limit).select("host", "n", "blocked", F.xxhash64("host").alias("digest"))
    # Joining on the digest too deals out both sides anew, so that Spark can split a large host's pages.
    named = rows.withColumn("digest", F.xxhash64("host")).join(hosts, ["digest", "host"])
    own = rule_of(F.col("host"), F.col("path"), rules)
    return named.select("page_id", "host", "path", own["rule"].alias("rule"),
                        F.coalesce(own["verdict"], F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                        F.col("n").alias("host_labelled"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, bad: pages with the outcome of the document whose number ends their path.

    A document is bad when it is toxic or of low quality; one labelled more than once is bad if any label says so.
    """
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT)")
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad")).filter("doc_id IS NOT NULL")
    rows = pages.select("page_id", "url", path_of(F.col("url")).alias("path")).withColumn("doc_id", number)
    return rows.join(bad, "doc_id", "left").select("page_id", "url", "bad")


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), l AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), r AS (
  SELECT q.*, l.bad FROM q LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(q.path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT)
), h AS (
  SELECT host, list_extract(string_split(host, '.'), -1) AS suffix,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
    count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM r GROUP BY host
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), w AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END AS mean FROM s
), s1 AS (SELECT s.*, w.mean FROM s, w
), ws AS (
  SELECT greatest({LEAST_WEIGHT}, least({MOST_WEIGHT}, coalesce(CASE WHEN sum(n * (bad / n - mean) ** 2) <= sum(mean * (1 - mean)) THEN {MOST_WEIGHT}
    ELSE sum((n - 1) * mean * (1 - mean)) / (sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) - 1 END, {MOST_WEIGHT}))) AS m FROM s1 WHERE n > 0
), s2 AS (SELECT suffix, (mean * m + bad) / (m + n) AS mean FROM s1, ws
), d1 AS (SELECT d.*, s2.mean FROM d JOIN s2 USING (suffix)
), wd AS (
  SELECT greatest({LEAST_WEIGHT}, least({MOST_WEIGHT}, coalesce(CASE WHEN sum(n * (bad / n - mean) ** 2) <= sum(mean * (1 - mean)) THEN {MOST_WEIGHT}
    ELSE sum((n - 1) * mean * (1 - mean)) / (sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) - 1 END, {MOST_WEIGHT}))) AS m FROM d1 WHERE n > 0
), d2 AS (SELECT suffix, domain, (mean * m + bad) / (m + n) AS mean FROM d1, wd
), h1 AS (SELECT h.*, d2.mean FROM h JOIN d2 USING (suffix, domain)
), wh AS (
  SELECT greatest({LEAST_WEIGHT}, least({MOST_WEIGHT}, coalesce(CASE WHEN sum(n * (bad / n - mean) ** 2) <= sum(mean * (1 - mean)) THEN {MOST_WEIGHT}
    ELSE sum((n - 1) * mean * (1 - mean)) / (sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) - 1 END, {MOST_WEIGHT}))) AS m FROM h1 WHERE n > 0
), h2 AS (SELECT host, n, mean * m + bad AS a, m - mean * m + n - bad AS b FROM h1, wh
), h3 AS (SELECT host, n, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} AS blocked FROM h2
), v AS (
  SELECT r.page_id, r.host, r.path, h3.n AS host_labelled, h3.blocked,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS "rule"
  FROM r JOIN h3 USING (host)
)
SELECT page_id, host, path, "rule",
  CASE WHEN "rule" IN ('org/', 'com/fr/') THEN 'allow' WHEN "rule" IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
  host_labelled
FROM v
"""
