"""URL filter: rules by host and path, then an Empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. Each
level's beta prior is centred on the posterior mean of the level above (suffix on
the rate of all), its strength fitted by moments from the spread of the level's
own rates. A host is blocked when the lower posterior bound of its bad rate
passes the threshold. Everything is DataFrame expressions; hosts seen in very many
pages are joined by broadcast of at most 500 rows (see common.join_by_share).

Null urls, and urls without ://, have an empty host and path; the empty host has a
reputation like any other. Repeated pages each get their row. Extra columns of the
input are not returned. Null or repeated labels: null outcomes are skipped, and a
page that is labelled twice counts as bad if any label says so. No labels at all:
every page without a rule is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_share, saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        name, verdict = F.when(fits, at + begin).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(n: str, bad: str) -> list[Column]:
    """Beta prior strength by moments: sums from which 1 / (1 + strength) follows."""
    return [F.sum(n), F.sum(bad), F.sum(F.col(bad) * F.col(bad) / F.col(n)), F.count(F.lit(1)), F.sum(F.col(n) * F.col(n))]


def _fitted(sums) -> float:
    n, bad, squares, groups, n2 = (float(x or 0) for x in sums)
    if groups < 2 or not 0 < bad < n:
        return 10.0
    p = bad / n
    between = (squares - n * p * p - (groups - 1) * p * (1 - p)) / (n - n2 / n) if n > n2 / n else 0.0
    return min(200.0, max(0.5, p * (1 - p) / between - 1)) if between > 0 else 200.0


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Of (host, pages, n, bad), one row a host: the lower posterior bound of each host's bad rate."""
    hosts = saved(
        outcomes.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "reputation"
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("domain_n"), F.sum("bad").alias("domain_bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_bad").alias("suffix_bad"))
    of_host = hosts.where("n > 0").agg(*_strength("n", "bad")).first()
    of_domain = domains.where("domain_n > 0").agg(*_strength("domain_n", "domain_bad")).first()
    of_suffix = suffixes.where("suffix_n > 0").agg(*_strength("suffix_n", "suffix_bad")).first()
    rate = (float(of_host[1]) + 0.5) / (float(of_host[0]) + 1) if of_host[0] else 0.0
    a, b, c = _fitted(of_suffix), _fitted(of_domain), _fitted(of_host)
    suffixes = suffixes.select("suffix", ((F.col("suffix_bad") + a * rate) / (F.col("suffix_n") + a)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", ((F.col("domain_bad") + b * F.col("suffix_rate")) / (F.col("domain_n") + b)).alias("domain_rate")
    )
    alpha, total = F.col("bad") + c * F.col("domain_rate"), F.col("n") + c
    mean = alpha / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    return hosts.join(domains, "domain").select("host", "pages", bound.alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages (page_id, url), labels (number, bad): a page's label is that of the last number in its path."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    bad = labels.where("number is not null and bad is not null").groupBy("number").agg(F.max("bad").cast("double").alias("bad"))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
    # pages without a number, or with a very common one, are summed by (host, number) before the shuffle
    by_host = (
        parts.groupBy("host", number.alias("number")).agg(F.count(F.lit(1)).alias("pages"))
        .join(bad, "number", "left")
        .groupBy("host")
        .agg(
            F.sum("pages").alias("pages"),
            F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).cast("double").alias("n"),
            F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0.0)).alias("bad"),
        )
    )
    known = saved(reputations(by_host), "hosts")
    total = known.agg(F.sum("pages")).first()[0] or 0
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return join_by_share(parts, known, "host", "pages", total, F.col("page_id")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bad_bound", 6).alias("bad_bound")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), (1 - F.col("quality")).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


_STRENGTH = """case when count(*) < 2 or not (sum({bad}) > 0 and sum({bad}) < sum({n})) then 10.0
  when sum({n}) <= sum({n} * {n}) / sum({n}) or (sum({bad} * {bad} / {n}) - sum({bad}) * sum({bad}) / sum({n}) - (count(*) - 1) * (sum({bad}) / sum({n})) * (1 - sum({bad}) / sum({n}))) <= 0 then 200.0
  else least(200.0, greatest(0.5, (sum({bad}) / sum({n})) * (1 - sum({bad}) / sum({n})) / ((sum({bad} * {bad} / {n}) - sum({bad}) * sum({bad}) / sum({n}) - (count(*) - 1) * (sum({bad}) / sum({n})) * (1 - sum({bad}) / sum({n}))) / (sum({n}) - sum({n} * {n}) / sum({n}))) - 1)) end"""

SQL = f"""
with cut as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
bad as (select doc_id as number, cast(max(1 - quality) as double) as bad from labels where doc_id is not null and quality is not null group by 1),
hosts as (select host, split_part(host, '.', -1) as suffix, case when instr(host, '.') = 0 then host else split_part(host, '.', -2) || '.' || split_part(host, '.', -1) end as domain,
  cast(count(bad) as double) as n, coalesce(sum(bad), 0.0) as bad from parts left join bad on bad.number = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint) group by 1, 2, 3),
domains as (select domain, suffix, sum(n) as dn, sum(bad) as db from hosts group by 1, 2),
suffixes as (select suffix, sum(dn) as sn, sum(db) as sb from domains group by 1),
fit as (select (select {_STRENGTH.format(n="sn", bad="sb")} from suffixes where sn > 0) as a, (select {_STRENGTH.format(n="dn", bad="db")} from domains where dn > 0) as b,
  (select {_STRENGTH.format(n="n", bad="bad")} from hosts where n > 0) as c, (select case when sum(n) > 0 then (sum(bad) + 0.5) / (sum(n) + 1) else 0.0 end from hosts) as rate),
means as (select host, n + c as total, (bad + c * ((db + b * ((sb + a * rate) / (sn + a))) / (dn + b))) / (n + c) as mean from hosts join domains using (domain) join suffixes on suffixes.suffix = domains.suffix, fit),
bounds as (select host, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) as bound from means),
ruled as (select *, case when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from parts)
select page_id, host, path, rule,
  case rule when 'example.com/de/' then 'block' when 'net/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
  else case when bound > 0.5 then 'block' else 'allow' end end as verdict, round(bound, 6) as bad_bound
from ruled join bounds using (host)
"""
