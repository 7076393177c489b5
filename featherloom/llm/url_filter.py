"""URL filter: empirical-Bayes host reputation, and rules that override it.

Page outcomes (good or bad) are counted by host. A host's share of good pages
is shrunk towards that of its registered domain, which is shrunk towards that
of its suffix, which is shrunk towards that of all pages: at each level the
parent's mean is the prior of a beta-binomial model, whose strength is fitted
by the method of moments from the spread of the level's groups. A host is
blocked if even the upper bound of its posterior is under ``threshold``; few
or no outcomes leave a wide posterior, so an unknown host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import ascii_lower, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes under which names are registered, besides the last label of any host: a
#: host's longest fitting rule is its suffix. ``*.x`` stands for any one label before
#: x, ``!y.x`` excepts y.x from it, whose suffix is then x. A caller passes the rules
#: of its own list; these are the usual second levels and the hosts of the test tables.
SECOND_LEVELS = tuple(f"{second}.{top}" for top in ("uk", "jp", "au", "nz", "za", "br", "in", "kr", "tr", "cn", "tw", "il", "th", "mx", "ar") for second in ("ac", "co", "com", "edu", "gov", "net", "or", "org"))
PLATFORMS = ("example.com", "example.net", "example.org", *SECOND_LEVELS)
THRESHOLD, Z, STRENGTH = 0.6, 1.6448536269514722, 10.0
#: A host with this share of the rows or more is joined by broadcast: there are at most 1 / HEAVY of them.
HEAVY = 0.001


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, under = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + under)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domains(host: Column, platforms=PLATFORMS) -> tuple[Column, Column]:
    """Suffix and registered domain of a host without its port."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    labels = 1 + F.length(bare) - F.length(F.translate(bare, ".", ""))
    plain = [p for p in platforms if p[0] not in "*!"]
    wild, excepted = [p[2:] for p in platforms if p[0] == "*"], [p[1:] for p in platforms if p[0] == "!"]
    n = F.lit(1)  # labels of the suffix
    for k in range(2, 2 + max([p.count(".") for p in [*plain, *(f"*.{w}" for w in wild)]], default=0)):
        tail = F.substring_index(bare, ".", -k)
        here = [p for p in plain if p.count(".") == k - 1]
        under = [w for w in wild if w.count(".") == k - 2]
        fits = (labels >= k) & tail.isin(*here)
        if under:
            fits = fits | ((labels >= k) & F.substring_index(bare, ".", 1 - k).isin(*under) & ~tail.isin(*excepted))
        n = F.when(fits, F.lit(k)).otherwise(n)
    cut = lambda k: F.array_join(F.slice(F.split(bare, "\\."), F.greatest(F.lit(1), labels - k + 1), k), ".")
    return cut(n), cut(n + 1)


def _strength(level: DataFrame, parent: str, name: str) -> DataFrame:
    """One row: the prior strength of groups (n, k) within their ``parent``.

    ``n2`` of a parent is its groups' sum of squares over its rows; the spread
    is around the parent's own share.
    """
    up = level.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    share = F.col("pk") / F.col("pn")
    spread = level.join(up, parent).agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - share, F.lit(2.0))).alias("s"))
    room = up.agg(
        F.sum(F.col("g") - 1).alias("dof"),
        F.sum(share * (1 - share) * (F.col("g") - 1)).alias("binomial"),
        F.sum(share * (1 - share) * (F.col("pn") - F.col("nn") / F.col("pn") - (F.col("g") - 1))).alias("extra"),
    )
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), (F.col("s") - F.col("binomial")) / F.col("extra")))
    fitted = F.when((F.col("dof") > 0) & (F.col("extra") > 0), 1 / rho - 1).otherwise(F.lit(STRENGTH))
    return spread.join(F.broadcast(room)).select(fitted.alias(name))


def reputation(hosts: DataFrame, platforms=PLATFORMS, z: float = Z) -> DataFrame:
    """(host, upper): the upper posterior bound of each host with outcomes.

    ``hosts`` has host, n (outcomes) and k (good ones), one row a host.
    """
    suffix, domain = domains(F.col("host"), platforms)
    hosts = hosts.where("n > 0").select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain"))
    by_domain = checkpointed(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    by_suffix = checkpointed(by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1)))
    whole = by_suffix.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"))
    # One row each: the prior mean of all, and the strengths of the three levels.
    fits = checkpointed(whole.join(F.broadcast(_strength(by_suffix, "all", "s_suffix"))).join(F.broadcast(_strength(by_domain, "suffix", "s_domain"))).join(F.broadcast(_strength(hosts, "domain", "s_host"))))
    fits = F.broadcast(fits)
    shrunk = lambda s, m: (F.col("k") + F.col(s) * F.col(m)) / (F.col("n") + F.col(s))
    m_suffix = by_suffix.join(fits).select("suffix", shrunk("s_suffix", "m0").alias("m_suffix"))
    m_domain = by_domain.join(fits).join(m_suffix, "suffix").select("domain", shrunk("s_domain", "m_suffix").alias("m_domain"))
    posterior = hosts.join(fits).join(m_domain, "domain").select("host", shrunk("s_host", "m_domain").alias("m"), (F.col("n") + F.col("s_host")).alias("w"))
    return posterior.select("host", (F.col("m") + z * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("w") + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, verdict and posterior_upper to ``pages`` (url).

    ``outcomes`` has page_id and good, one row a page at most. A host without
    outcomes has no bound and is allowed. Null and malformed urls have an empty
    host, which is judged like any other. Repeated pages are judged alike.
    """
    host, path = split_url(F.col("url"))
    read = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    judged = read.join(outcomes, "page_id", "left")
    hosts = checkpointed(judged.groupBy("host").agg(F.count("*").alias("rows"), F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k")))
    rated = checkpointed(hosts.select("host", "rows").join(reputation(hosts), "host", "left"))
    total = rated.agg(F.sum("rows").alias("total"))
    heavy = rated.join(F.broadcast(total)).where(F.col("rows") >= HEAVY * F.col("total"))
    # Heavy hosts: at most 1 / HEAVY of them. The others go by a shuffle in which no host is large.
    top = heavy.select(F.col("host").alias("h1"), F.col("upper").alias("u1"), F.lit(True).alias("is_heavy"))
    rest = rated.select(F.col("host").alias("h2"), F.col("upper").alias("u2"))
    key = F.when(F.col("is_heavy"), F.concat(F.lit("/"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))
    joined = read.join(F.broadcast(top), F.col("host") == F.col("h1"), "left").withColumn("key", key).join(rest, F.col("key") == F.col("h2"), "left")
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    upper = F.coalesce("u1", "u2")
    verdict = F.coalesce(said, F.when(upper < threshold, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round(upper, 6).alias("posterior_upper"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and good of pages whose url names a labelled document (the first
    number after a slash): good quality and not toxic. Conflicting or repeated
    labels of a document count as their minimum."""
    named = pages.where(F.col("url").isNotNull()).select("page_id", F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})', 1), '') as bigint)").alias("doc_id"))
    good = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)).alias("good"))
    return named.join(good, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))


def op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _sql_strength(level: str, parent: str) -> str:
    return f"""(WITH up AS (SELECT {parent}, sum(n)::DOUBLE pn, sum(k)::DOUBLE pk, count(*)::DOUBLE g, sum(n * n)::DOUBLE nn FROM {level} GROUP BY {parent}),
     v AS (SELECT (SELECT sum(n * power(k::DOUBLE / n - pk / pn, 2)) FROM {level} JOIN up USING ({parent})) s, sum(g - 1) dof,
       sum(pk / pn * (1 - pk / pn) * (g - 1)) binomial, sum(pk / pn * (1 - pk / pn) * (pn - nn / pn - (g - 1))) extra FROM up)
     SELECT CASE WHEN dof > 0 AND extra > 0 THEN 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, (s - binomial) / extra)) - 1 ELSE {STRENGTH}::DOUBLE END FROM v)"""


def op1_sql() -> str:
    fits = lambda r: f"((r.host = '{r.split('/')[0]}' OR ends_with(r.host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    longest = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    said = " ".join(f"WHEN {fits(r)} THEN '{k}'" for k, r in longest)
    two = ", ".join(f"'{p}'" for p in PLATFORMS)  # all of two labels
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
r AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) good FROM labels GROUP BY doc_id),
o AS (SELECT page_id, min(good) good FROM r JOIN l ON l.doc_id = try_cast(nullif(regexp_extract(url, '/([0-9]{{1,18}})', 1), '') AS BIGINT) GROUP BY page_id),
h0 AS (SELECT host, count(*) n, sum(good)::BIGINT k, regexp_replace(host, ':[0-9]*$', '') bare FROM r JOIN o USING (page_id) WHERE good IS NOT NULL GROUP BY host),
h1 AS (SELECT *, CASE WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ({two}) THEN array_to_string(string_split(bare, '.')[-2:], '.') ELSE split_part(bare, '.', -1) END suffix FROM h0),
hosts AS (SELECT host, n, k, suffix, array_to_string(CASE WHEN strpos(suffix, '.') > 0 THEN string_split(bare, '.')[-3:] ELSE string_split(bare, '.')[-2:] END, '.') AS domain FROM h1),
by_domain AS (SELECT suffix, domain, sum(n)::BIGINT n, sum(k)::BIGINT k FROM hosts GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(n)::BIGINT n, sum(k)::BIGINT k, 1 AS whole FROM by_domain GROUP BY suffix),
f AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) m0, {_sql_strength('by_suffix', 'whole')} s_suffix, {_sql_strength('by_domain', 'suffix')} s_domain, {_sql_strength('hosts', 'domain')} s_host FROM by_suffix),
ms AS (SELECT suffix, (k + s_suffix * m0) / (n + s_suffix) m FROM by_suffix, f),
md AS (SELECT domain, (k + s_domain * m) / (n + s_domain) m FROM by_domain JOIN ms USING (suffix), f),
mh AS (SELECT host, (k + s_host * m) / (n + s_host) m, n + s_host w FROM hosts JOIN md USING (domain), f),
p AS (SELECT host, m + {Z} * sqrt(m * (1 - m) / (w + 1)) upper FROM mh)
SELECT page_id, r.host AS host, path, CASE {rule} END AS rule,
  CASE {said} WHEN upper < {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, round(upper, 6) AS posterior_upper
FROM r LEFT JOIN p ON r.host = p.host
"""
