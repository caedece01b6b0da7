"""URL filter: allow and block rules, then empirical-Bayes reputation of hosts.

The host of a url is what follows its first `://` up to `/`, `?`, `#` or the end,
with A-Z lower-cased; the path follows up to `?`, `#` or the end.  A null url or
one without `://` has an empty host and path.

Rules name a host and a path prefix.  A rule fits its host and all subdomains
if the path starts with its path; of several the longest (host and path
together) decides.

Urls without a rule are judged by labelled outcomes.  Suffixes (the last label
of a host), registered domains (the last two) and hosts each have a bad rate
that is shrunk towards its parent's by a beta-binomial prior; the strength of
each level's prior is fitted by moments to the spread that the rates of its
groups show beyond sampling noise.  A host is blocked if the lower bound of its
posterior bad rate exceeds a threshold.  A host without labels has the prior of
its domain, so little evidence never blocks.

One SQL text serves Spark and DuckDB; it holds no Python code on the executors.
Counts are summed map-side before they are shuffled, so a host with a third of
all pages costs one row per task; the join back splits such a host by
adaptive skew handling or broadcasts the reputations where they are small.
Null or repeated ids and ties are kept: every input row gives one output row.
Repeated labels of one id count once, as bad if any of them is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: (action, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _case(rules: list[tuple[str, str, str]], pick: int | None) -> str:
    """CASE over the rules, longest first; gives the rule's string, or its action with pick=0."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        _, host, path = rule
        fits = f"(host = {quote(host)} OR right(host, {len(host) + 1}) = {quote('.' + host)}) AND substr(path, 1, {len(path)}) = {quote(path)}"
        out.append(f"WHEN {fits} THEN {quote(rule[0] if pick == 0 else host + path)}")
    return "CASE " + " ".join(out) + " END" if out else "CAST(NULL AS STRING)"


def _level(name: str, parent: str, above: str, key: str) -> str:
    """CTEs of one level: the groups' counts with the parent's mean, the strength of the prior, the shrunk means."""
    return f"""
  {name}_n AS (SELECT {key} AS k, max({parent}) AS up, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY {key}),
  {name}_s AS (
    SELECT sum(bad) * 1.0D / sum(n) AS mu, count(*) * 1.0D / sum(n) AS noise,
           sum(bad * 1.0D * bad / n) / sum(n) - (sum(bad) * 1.0D / sum(n)) * (sum(bad) * 1.0D / sum(n)) AS spread
    FROM {name}_n),
  {name}_m AS (
    SELECT CASE WHEN spread > mu * (1 - mu) * noise
                THEN least(1000.0D, greatest(1.0D, (mu * (1 - mu) - spread) / (spread - mu * (1 - mu) * noise)))
                ELSE 1000.0D END AS m, mu FROM {name}_s),
  {name}_p AS (
    SELECT c.k, c.n, c.bad, (SELECT max(m) FROM {name}_m) AS m, {above} AS mean_up
    FROM {name}_n c{f' JOIN {parent}_p u ON u.k = c.up' if parent != "''" else ''})"""


def sql(pages: str, labels: str, rules: list[tuple[str, str, str]], bound: float, z: float, dialect: str = "spark") -> str:
    """The statement over the tables pages(page_id, url) and labels(doc_id, quality, toxic)."""
    suffix_up = "(SELECT max(mu) FROM suffix_m)"
    shrunk = "(u.bad + u.m * u.mean_up) / (u.n + u.m)"
    text = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM {pages}),
  parsed AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
  placed AS (
    SELECT page_id, host, path, regexp_extract(host, '(([^.]*[.])?[^.]*)$', 1) AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix FROM parsed),
  outcomes AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM {labels}
    WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
  counts AS (
    SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM placed JOIN outcomes ON page_id = doc_id GROUP BY host, domain, suffix),
  {_level("suffix", "''", suffix_up, "suffix")},
  {_level("domain", "suffix", shrunk, "domain")},
  {_level("host", "domain", shrunk, "host")},
  posterior AS (SELECT k, bad + m * mean_up AS a, n - bad + m * (1 - mean_up) AS b FROM host_p),
  judged AS (SELECT k, a / (a + b) - {z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM posterior)
SELECT page_id, host, path, {_case(rules, 1)} AS rule,
       coalesce({_case(rules, 0)}, CASE WHEN low > {bound}D THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN judged ON host = k"""
    if dialect == "duckdb":
        import re

        text = re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", text).replace("AS STRING", "AS VARCHAR")
    return text


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, bound: float = 0.25, z: float = 1.64) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Labels belong to the page whose page_id equals their doc_id; an outcome is
    bad if quality is 0 or toxic is 1.  bound is the highest bad rate that the
    lower posterior bound (z standard deviations below the mean) may reach.
    """
    return pages.sparkSession.sql(sql("{pages}", "{labels}", rules, bound, z), pages=pages.select("page_id", "url"), labels=labels.select("doc_id", "quality", "toxic"))
