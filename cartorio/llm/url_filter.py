"""URL filters: rules for hosts and paths, and an empirical-Bayes reputation of hosts for the rest.

A labelled page is good or bad. The share of bad pages of a host is shrunk towards that of its registered domain,
the domain's towards that of its suffix, the suffix's towards that of all pages: at each level a beta prior whose mean
is the level above and whose strength is estimated from how much the children of one parent differ (moments of the
beta-binomial distribution). A host is blocked when the lower posterior bound of its bad share exceeds a limit, so a
few bad pages alone don't block a host, and an unlabelled one has the reputation of its domain.

Only ids, urls and outcomes are read and exchanged. Hosts are sums of their pages, made before any exchange of
them; levels above are sums of sums. Three rows of moments reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.llm.shared import Scratch

#: Rules (verdict, host, beginning of path) of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of more than one label that a registered domain stands below; every other suffix is the last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.br", "gov.uk", "net.br", "or.jp", "org.br", "org.uk")
#: A host is blocked when its bad share exceeds LIMIT with a probability of 95 % (one-sided normal quantile).
LIMIT, QUANTILE = 0.25, 1.645
#: Strength of a prior in labelled pages: where moments say nothing, and bounds of what they say.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 10_000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host in lower case and path of a url column; both empty where it is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "(:[0-9]*|\\.)$", "")


def suffix_of(bare: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Public suffix of a bare host; empty for addresses in numbers."""
    listed = "|".join(s.replace(".", "\\.") for s in suffixes)
    found = F.regexp_extract(bare, f"(?:^|\\.)({listed}|[^.]+)$" if listed else "(?:^|\\.)([^.]+)$", 1)
    return F.when(bare.rlike("^[0-9.]+$|[:\\[]"), "").otherwise(found)


def domain_of(bare: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label before it, or the host itself where there is none."""
    rest = F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    alone = (suffix == "") | (F.length(bare) <= F.length(suffix))
    return F.when(alone, bare).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule list is configuration: it becomes one expression."""
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def strength(children: DataFrame, parent: str) -> float:
    """Strength of the prior of a level, from rows (parent, n, bad): one number for all parents."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    parents = children.filter("n > 0").groupBy(parent).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), F.sum(bad).alias("bad"),
        F.sum((bad * bad / n).cast("decimal(30,6)")).cast("double").alias("spread"),
    )
    share = F.col("bad") / F.col("n")
    own = share * (1 - share)
    free = F.col("k") - 1
    row = parents.agg(
        F.sum((F.col("spread") - F.col("bad") * share - own * free).cast("decimal(30,6)")).cast("double").alias("above"),
        F.sum((own * (F.col("n") - F.col("squares") / F.col("n") - free)).cast("decimal(30,6)")).cast("double").alias("below"),
    ).first()
    if not row.below or row.below <= 0:
        return STRENGTH
    alike = row.above / row.below
    return STRONGEST if alike <= 0 else min(max(1 / alike - 1, WEAKEST), STRONGEST)


def shrunk(children: DataFrame, parents: DataFrame, parent: str, force: float) -> DataFrame:
    """Children with column ``mean``: their bad share, shrunk towards the mean of their parent."""
    above = parents.select(parent, F.col("mean").alias("prior"))
    mean = (F.lit(force) * F.col("prior") + F.col("bad")) / (F.lit(force) + F.col("n"))
    return children.join(above, parent).withColumn("mean", mean)


def host_reputations(pages: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per host of ``pages`` (host, bad: 1, 0 or null for an unlabelled page): host, domain, suffix, n, bad, mean, lower.

    ``mean`` and ``lower`` are the posterior mean and lower bound of the bad share. Without any labelled page all is
    allowed (mean 0).
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    bare = bare_host(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(bare, suffixes)).withColumn("domain", domain_of(bare, F.col("suffix")))
    hosts = scratch.keep(hosts, "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    ends = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(1))
    total = ends.agg(*sums).first()
    top = (total.bad / total.n) if total.n else 0.0
    force = strength(ends, "all")
    ends = ends.withColumn("mean", (F.lit(force * top) + F.col("bad")) / (F.lit(force) + F.col("n")))
    domains = shrunk(domains, ends, "suffix", strength(domains, "suffix"))
    last = strength(hosts.withColumn("parent", F.struct("domain", "suffix")), "parent")
    above = domains.select("domain", "suffix", F.col("mean").alias("prior"))
    mass = F.lit(last) + F.col("n")
    mean = (F.lit(last) * F.col("prior") + F.col("bad")) / mass
    placed = hosts.join(above, ["domain", "suffix"]).withColumn("mean", mean)
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (mass + 1))
    return placed.select("host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - F.lit(QUANTILE) * spread).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, host_labelled, host_bad.

    ``outcomes`` (page_id, bad) holds 1 for a bad page and 0 for a good one; null says nothing, of several rows of one
    page a bad one counts, rows without an id are of no page. Every page with a labelled id counts, repeated rows as
    often as they stand there. A null url, or one without ``://``, has an empty host, which is a host like others.
    Of rules of equal length the one with the longer host wins. Other columns are ignored; no pages give no rows.
    """
    known = outcomes.select("page_id", F.col("bad").cast("int").alias("bad")).filter("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = pages.select("page_id", "url")
    host, path = host_and_path("url")
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    hosts = host_reputations(urls.join(known, "page_id", "left").select("host", "bad"), suffixes)
    judged = urls.join(hosts.select("host", "n", "bad", "lower"), "host", "left").withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"),
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes (page_id, bad) of a label table (doc_id, quality, toxic): bad is toxic or of no quality; null where neither is known."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def _strength_sql(above: str, below: str) -> str:
    return f"CASE WHEN {below} IS NULL OR {below} <= 0 THEN {STRENGTH} WHEN {above} / {below} <= 0 THEN {STRONGEST} ELSE least(greatest(1 / ({above} / {below}) - 1, {WEAKEST}), {STRONGEST}) END"


def _level_sql(children: str, parent: str) -> str:
    """One row of the strength of a level."""
    return f"""(SELECT {_strength_sql('above', 'below')} AS force FROM (
        SELECT sum(CAST(spread - bad * (bad / n) - (bad / n) * (1 - bad / n) * (k - 1) AS DECIMAL(30,6)))::DOUBLE AS above,
            sum(CAST((bad / n) * (1 - bad / n) * (n - squares / n - (k - 1)) AS DECIMAL(30,6)))::DOUBLE AS below
        FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS squares, sum(bad)::DOUBLE AS bad,
                sum(CAST(bad::DOUBLE * bad / n AS DECIMAL(30,6)))::DOUBLE AS spread
            FROM {children} WHERE n > 0 GROUP BY {parent})))"""


def oracle_sql() -> str:
    listed = "|".join(s.replace(".", "\\.") for s in SUFFIXES)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH outcomes AS (
    SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1
), cut AS (
    SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS after FROM pages
), urls AS (
    SELECT page_id, translate(regexp_extract(after, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), counted AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY 1
), bared AS (
    SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|\\.)$', '') AS bare FROM counted
), ended AS (
    SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$|[:\\[]') THEN '' ELSE regexp_extract(bare, '(?:^|\\.)({listed}|[^.]+)$', 1) END AS suffix FROM bared
), hosts AS (
    SELECT *, CASE WHEN suffix = '' OR length(bare) <= length(suffix) THEN bare ELSE split_part(left(bare, length(bare) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM ended
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2
), ends AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1
), top AS (
    SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS mean FROM ends
), end_means AS (
    SELECT suffix, (f.force * t.mean + bad) / (f.force + n) AS mean FROM ends, top t, {_level_sql('ends', '1 + 0 * length(suffix)')} f
), domain_means AS (
    SELECT domain, d.suffix, (f.force * e.mean + bad) / (f.force + n) AS mean FROM domains d JOIN end_means e ON d.suffix = e.suffix, {_level_sql('domains', 'suffix')} f
), host_means AS (
    SELECT host, h.n, h.bad, f.force + h.n AS mass, (f.force * d.mean + h.bad) / (f.force + h.n) AS mean
    FROM hosts h JOIN domain_means d ON h.domain = d.domain AND h.suffix = d.suffix, {_level_sql('hosts', 'domain, suffix')} f
), rules(verdict, name, start) AS (VALUES {rules}
), fits AS (
    SELECT u.host, u.path, arg_max(name || start, length(name || start) * 1000 + length(name)) AS rule, arg_max(verdict, length(name || start) * 1000 + length(name)) AS verdict
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (u.host = name OR ends_with(u.host, '.' || name)) AND starts_with(u.path, start) GROUP BY 1, 2
)
SELECT u.page_id, u.host, u.path, f.rule,
    coalesce(f.verdict, CASE WHEN m.mean - {QUANTILE} * sqrt(m.mean * (1 - m.mean) / (m.mass + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    m.n AS host_labelled, m.bad AS host_bad
FROM urls u JOIN host_means m ON u.host = m.host LEFT JOIN fits f ON u.host = f.host AND u.path = f.path
"""
