"""URL filter: explicit rules first, then an empirical-Bayes reputation of hosts.

A page's host has the labelled outcomes (good or not) of its pages. Hosts with few labels
say little alone, so rates are shrunk along the chain host, registered domain, suffix, all:
each unit's rate has a beta prior whose mean is the posterior mean of the unit above, and
whose strength is estimated from how much the units of that level differ (method of moments
for the beta-binomial). A host passes when the lower bound of its posterior, mean minus
``Z`` standard deviations, reaches ``LEAST``.

Rules name a host and a path prefix; they hold for the host and all subdomains and win
over the reputation, the longest rule first.

All steps are DataFrame expressions, aggregations and joins: counts are summed before they are
shuffled, three pairs of level totals come to the driver, and pages meet their host's
verdict in a join whose skewed host adaptive execution splits.

Defined cases: a null url or one without ``://`` has empty host and path (the empty host is
a host like any other); null labels and labels of unknown pages do not count; of repeated labels for one
page the best counts; repeated pages each get their row; without any labels all hosts have the
prior of one good and one bad page. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import cut

# Rules of the query, as host/path and verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
# Common suffixes of two labels.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
Z = 1.645
LEAST = 0.8
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

LEVELS = ("suffix", "domain", "host")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host`` and ``path`` of every url."""
    url = F.coalesce(pages[url_col].cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase
    )
    return pages.select(
        pages[id_col].alias("page_id"),
        host.alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def matched_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col(
            "path"
        ).startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_levels(hosts: DataFrame) -> DataFrame:
    """``hosts`` with registered ``domain`` and ``suffix`` of ``host``."""
    parts = F.split("host", r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    labels = F.when(two.isin(*TWO_LABELS), 2).otherwise(1)
    last = F.greatest(F.size(parts) - labels + 1, F.lit(1))
    before = F.greatest(F.size(parts) - labels, F.lit(1))
    return hosts.withColumn("suffix", F.array_join(F.slice(parts, last, 3), ".")).withColumn(
        "domain", F.array_join(F.slice(parts, before, 3), ".")
    )


def _strength(units: DataFrame) -> float:
    """Pages that the prior of a level is worth, from ``good`` and ``n`` of its units."""
    k, n, good, squares = units.where("n > 0").agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("good"), F.sum(F.col("n") * F.col("n"))
    ).first()
    if not n:
        return WEAKEST
    mean = good / n
    spread = (
        units.where("n > 0")
        .agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.lit(mean), 2)))
        .first()[0]
    )
    within = mean * (1 - mean)
    room = n - squares / n
    if within <= 0 or room <= 0:
        return STRONGEST
    share = (spread - (k - 1) * within) / room / within
    return min(STRONGEST, max(WEAKEST, 1 / share - 1)) if share > 0 else STRONGEST


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of every host: ``host``, ``n``, ``good``, ``mean`` and ``bound``.

    ``pages`` holds ``page_id`` and ``host``, ``outcomes`` ``page_id`` and ``good`` (0 or 1).
    """
    labelled = (
        outcomes.where("page_id IS NOT NULL AND good IN (0, 1)")
        .groupBy("page_id")
        .agg(F.max("good").alias("good"))
    )
    hosts = cut(
        with_levels(
            pages.join(labelled, "page_id", "left")
            .groupBy("host")
            .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        ),
        "hosts",
    )
    total_n, total_good = hosts.agg(F.sum("n"), F.sum("good")).first()
    above = F.lit(((total_good or 0) + 1) / ((total_n or 0) + 2))
    known = hosts
    for level in LEVELS:
        units = hosts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        worth = F.lit(float(_strength(units)))
        if level == "host":
            break
        mean_above = above if level == "suffix" else F.col("prior")
        prior = units if level == "suffix" else units.join(
            known.select(level, "prior").distinct(), level
        )
        means = prior.select(
            level,
            ((F.col("good") + worth * mean_above) / (F.col("n") + worth)).alias("prior"),
        )
        known = known.drop("prior").join(means, level)
    good = F.col("good") + worth * F.col("prior")
    size = F.col("n") + worth
    return known.withColumn("mean", good / size).select(
        "host",
        "n",
        F.col("good").cast("bigint").alias("good"),
        "mean",
        (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("bound"),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) of every page."""
    rows = parsed(pages)
    bounds = reputation(rows, outcomes).select("host", "bound")
    rule, says = matched_rule(rules)
    own = F.when(F.col("bound") >= LEAST, "allow").otherwise("block")
    return rows.join(bounds, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict")
    )


def _level_sql(level: str, above: str) -> str:
    """Strength of a level and posterior means of its units, in SQL."""
    return f"""
u_{level} AS (SELECT {level}, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY {level}),
t_{level} AS (
  SELECT count(*) AS k, sum(n) AS n, sum(good) AS g, sum(n * n) AS sq, sum(good) / sum(n) AS m
  FROM u_{level} WHERE n > 0
),
q_{level} AS (
  SELECT any_value(t.k) AS k, any_value(t.n) AS n, any_value(t.m) AS m, any_value(t.sq) AS sq,
         sum(u.n * power(u.good / u.n - t.m, 2)) AS spread
  FROM u_{level} u, t_{level} t WHERE u.n > 0
),
s_{level} AS (
  SELECT CASE WHEN n IS NULL THEN {WEAKEST}
              WHEN m * (1 - m) <= 0 OR n - sq / n <= 0 THEN {STRONGEST}
              WHEN spread - (k - 1) * m * (1 - m) <= 0 THEN {STRONGEST}
              ELSE least({STRONGEST}, greatest({WEAKEST},
                1 / ((spread - (k - 1) * m * (1 - m)) / (n - sq / n) / (m * (1 - m))) - 1))
         END AS worth
  FROM q_{level}
)"""


def sql() -> str:
    """The same as ``judge`` over ``pages`` and ``labels.quality``, for DuckDB."""
    cases = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        f" THEN '{t}'"
        for t, h, p in sorted(
            ((t, *t.split("/", 1)) for t, _ in RULES), key=lambda r: -len(r[0])
        )
    )
    verdicts = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in RULES)
    two = ", ".join(f"'{s}'" for s in TWO_LABELS)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
),
p AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{upper}', '{lower}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
lab AS (
  SELECT doc_id, max(quality) AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id
),
h AS (
  SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good,
         string_split(host, '.') AS parts
  FROM p LEFT JOIN lab ON page_id = doc_id GROUP BY host
),
h2 AS (
  SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({two}) THEN 2 ELSE 1 END AS l FROM h
),
hosts AS (
  SELECT host, n, good,
         array_to_string(parts[greatest(len(parts) - l + 1, 1):], '.') AS suffix,
         array_to_string(parts[greatest(len(parts) - l, 1):], '.') AS domain
  FROM h2
),
g AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m FROM hosts),
{_level_sql("suffix", "")},
{_level_sql("domain", "")},
{_level_sql("host", "")},
m_suffix AS (SELECT suffix, (good + worth * m) / (n + worth) AS m FROM u_suffix, s_suffix, g),
m_domain AS (
  SELECT domain, (u.good + worth * x.m) / (u.n + worth) AS m
  FROM u_domain u JOIN (SELECT DISTINCT domain, suffix FROM hosts) USING (domain)
  JOIN m_suffix x USING (suffix), s_domain
),
m_host AS (
  SELECT host, n + worth AS size, (good + worth * m) / (n + worth) AS mean
  FROM hosts JOIN m_domain USING (domain), s_host
),
b AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM m_host),
ruled AS (SELECT *, CASE
{cases}
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE rule {verdicts}
            ELSE CASE WHEN bound >= {LEAST} THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled JOIN b USING (host)
"""
