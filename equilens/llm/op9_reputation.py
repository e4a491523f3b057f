"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (0 good, 1 bad) are counted per host. Each level of the
hierarchy host -> registered domain -> suffix -> everything is shrunk towards
the level above it: a node's posterior mean is (bad + k * parent mean) /
(n + k), where the prior weight k of a level is estimated from the spread of
its observed rates (beta-binomial moments, one value per level). A host is
blocked when the lower bound of its beta posterior, mean - z * sd, exceeds
``threshold``; hosts without outcomes inherit the bound of their domain, their
suffix or everything. A registered domain is the last two labels of a host (no
list of longer public suffixes is kept), so under ``co.uk`` all are one.

The counts are partial aggregates, so a host with a third of all pages is one
row after the map side. Only the reputation of hosts (one row each) is joined
to the pages; a hot host is on the streamed side of that join.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed (nothing is known of an empty host); levels are
kept apart, so a host of one label is not taken for its own domain or suffix
and every page is answered once; a level whose nodes all have one outcome has
no spread to estimate and takes the greatest prior weight; outcomes for
unknown pages are ignored; with no outcomes at all every unruled page is
allowed; repeated pages are each answered; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, isolate, write_once

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
THRESHOLD, Z = 0.5, 1.645
#: Bounds of a level's prior weight, where its moments give none.
LEAST_K, MOST_K = 1.0, 1000.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def domain_of(host: Column) -> Column:
    """The last two labels (no list of longer public suffixes is kept)."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):   # the longest ends outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _prior_weight(nodes: DataFrame) -> DataFrame:
    """One row ``k`` for a level of (n, bad, parent_mean): moments of the beta-binomial around the parents' means."""
    mu, n = F.col("parent_mean"), F.col("n")
    rate = F.col("bad") / n
    # E (rate - mu)^2 = mu (1 - mu) (1/n + (1 - 1/n) rho), rho = 1 / (k + 1)
    var = mu * (1 - mu)
    spread = F.sum((n - 1) * var)   # 0 where no node has a second outcome
    rho = F.when(spread > 0, (F.sum(n * (rate - mu) ** 2) - F.sum(var)) / spread)
    k = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(MOST_K))
    return nodes.agg(F.least(F.greatest(F.coalesce(k, F.lit(MOST_K)), F.lit(LEAST_K)), F.lit(MOST_K)).alias("k"))


def reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad") -> DataFrame:
    """(level, name, mean, lower): posterior of the bad rate of every host with outcomes, its domain and suffix and,
    if there are any outcomes, of everything (level ``all``, name ``*``). The hosts' counts are written once; the
    other levels follow from that table."""
    named = F.col(host)
    hosts = write_once(outcomes.where(named != "").groupBy(named.alias("host"))
                       .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("bad"))
                       .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("suffix").alias("suffix"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # one prior bad and one prior good outcome keep the overall mean inside (0, 1)
    counts = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, levels = (counts["bad"] + 1) / (counts["n"] + 2), []

    def shrink(nodes: DataFrame, name: str) -> DataFrame:
        nodes = write_once(nodes, name)
        k = float(_prior_weight(nodes).first()["k"])   # one number per level
        a = F.col("bad") + F.lit(k) * F.col("parent_mean")
        size = F.col("n") + F.lit(k)
        mean = a / size
        nodes = nodes.withColumns({"mean": mean, "lower": mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (size + 1))})
        levels.append(nodes.select(F.lit(name).alias("level"), F.col(name).alias("name"), "mean", "lower"))
        return nodes

    s = shrink(suffixes.withColumn("parent_mean", F.lit(total)), "suffix")
    d = shrink(domains.join(s.select("suffix", F.col("mean").alias("parent_mean")), "suffix"), "domain")
    shrink(hosts.join(d.select("domain", F.col("mean").alias("parent_mean")), "domain"), "host")
    if counts["n"]:
        lower = total - Z * math.sqrt(total * (1 - total) / (counts["n"] + 3))
        levels.append(outcomes.sparkSession.range(1).select(F.lit("all").alias("level"), F.lit("*").alias("name"), F.lit(total).alias("mean"), F.lit(lower).alias("lower")))
    return reduce(DataFrame.unionByName, levels)


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) of every page; ``outcomes`` is (host, bad)."""
    base, at = isolate(pages)
    url = F.col(at[url_col])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # a host with no outcomes falls back to its domain, then its suffix, then everything; of "" nothing is known
    known = write_once(reputation(outcomes), "reputation")

    def level(name: str) -> DataFrame:
        return known.where(F.col("level") == name).select(F.col("name").alias(name), F.col("lower").alias(f"{name}_lower"))

    top = known.where(F.col("level") == "all").select(F.col("lower").alias("top_lower"))   # one row at most
    bound = (base.select(host_of(url).alias("host")).where("host <> ''").distinct()
             .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
             .join(level("host"), "host", "left").join(level("domain"), "domain", "left").join(level("suffix"), "suffix", "left")
             .join(F.broadcast(top), F.lit(True), "left")
             .select("host", F.coalesce("host_lower", "domain_lower", "suffix_lower", "top_lower").alias("lower")))
    judged = base.select(F.col(at[id_col]).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own_verdict = F.when(F.col("lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(bound, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own_verdict).alias("verdict"),
        F.col("lower").alias("reputation"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose document is labelled: the last number of a
    url's path is the id of the document that the page shows; bad is quality 0."""
    base, at = isolate(pages)
    lab, l = isolate(labels)
    url = F.col(at["url"])
    number = F.regexp_extract(path_of(url), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    shown = base.select(host_of(url).alias("host"), F.when(number != "", number.cast("long")).alias("doc"))
    marks = (lab.where(F.col(l["quality"]).isNotNull()).groupBy(F.col(l["doc_id"]).cast("long").alias("doc"))
             .agg((F.min(l["quality"]) == 0).cast("int").alias("bad")))
    return shown.join(marks, "doc").select("host", "bad")


def query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The reputation is shown to six decimals; verdicts follow from the full number."""
    return judge(pages, page_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict", F.round("reputation", 6).alias("reputation"))


def _shrunk(level: str, nodes: str) -> str:
    return f"""{level}_k AS (
  SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {MOST_K} END, {MOST_K}), {LEAST_K}), {MOST_K}) AS k
  FROM (SELECT CASE WHEN sum((n - 1) * pm * (1 - pm)) > 0
        THEN (sum(n * (bad / n - pm) ** 2) - sum(pm * (1 - pm))) / sum((n - 1) * pm * (1 - pm)) END AS rho FROM {nodes})
), {level}_s AS (
  SELECT *, mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) AS lower
  FROM (SELECT *, (bad + k * pm) / (n + k) AS mean FROM {nodes}, {level}_k)
)"""


ORACLE = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), marks AS (SELECT doc_id, CASE WHEN min(quality) = 0 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (
  SELECT p.host, m.bad FROM p JOIN marks m ON m.doc_id = TRY_CAST(regexp_extract(path, '/(\d{{1,18}})(?:\.\w+)?/?$', 1) AS BIGINT) WHERE p.host <> ''
), parts AS (
  SELECT host, CASE WHEN len(string_split(host, '.')) <= 2 THEN host ELSE string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] END AS domain,
         string_split(host, '.')[-1] AS suffix FROM (SELECT DISTINCT host FROM p)
), h AS (SELECT o.host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM outcomes o JOIN parts USING (host) GROUP BY o.host),
d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
t AS (SELECT mean, CASE WHEN n > 0 THEN mean - {Z} * sqrt(mean * (1 - mean) / (n + 3)) END AS lower
      FROM (SELECT coalesce(sum(n), 0) AS n, (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM h)),
s_p AS (SELECT s.*, t.mean AS pm FROM s, t), {_shrunk("s", "s_p")},
d_p AS (SELECT d.*, s_s.mean AS pm FROM d JOIN s_s USING (suffix)), {_shrunk("d", "d_p")},
h_p AS (SELECT h.*, d_s.mean AS pm FROM h JOIN d_s USING (domain)), {_shrunk("h", "h_p")},
bound AS (
  SELECT x.host, CASE WHEN x.host <> '' THEN coalesce(h_s.lower, d_s.lower, s_s.lower, t.lower) END AS lower
  FROM parts x LEFT JOIN h_s ON h_s.host = x.host LEFT JOIN d_s ON d_s.domain = x.domain LEFT JOIN s_s ON s_s.suffix = x.suffix, t
), rules(what, h, path) AS (VALUES {", ".join(f"('{w}', '{h}', '{p}')" for w, h, p in RULES)}),
ruled AS (
  SELECT p.host, p.path, arg_max({{'rule': r.h || r.path, 'what': r.what}}, len(r.h || r.path)) AS r
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.path) GROUP BY p.host, p.path
)
SELECT p.page_id, p.host, p.path, ruled.r.rule AS rule, coalesce(ruled.r.what, CASE WHEN b.lower > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(b.lower, 6) AS reputation
FROM p LEFT JOIN ruled ON ruled.host = p.host AND ruled.path = p.path LEFT JOIN bound b ON b.host = p.host
"""
