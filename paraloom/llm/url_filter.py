"""URL filters: rules by host and path first, then empirical-Bayes host reputation.

Labelled pages are Bernoulli outcomes (bad: label quality 0 or toxic 1). Hosts, registered domains and suffixes form a tree. Each level's rate is a beta-binomial
posterior whose prior has the mean of the level above and a strength fitted by the method of moments over all groups of
the level; the top prior is the corpus rate. A host with few outcomes or none so inherits its domain's or suffix's rate.
A page is blocked if the lower posterior bound of its host's bad rate (mean less Z standard deviations) is over BLOCK_RATE.

Defined cases: a null url or one without `://` has empty host and path, matches no rule, and is judged as the host of no name; a repeated page is a page of its
own; a page whose url names no labelled document adds no outcome; a document with several label rows adds each; without
outcomes nothing is blocked but by rule; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import ascii_lower, cut, read_table, small

#: (rule, verdict): a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Suffixes of more than one label under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.za", "com.cn")
Z, BLOCK_RATE = 1.645, 0.5
#: Prior strengths are kept within these, in outcomes.
STRENGTH = (1.0, 1000.0)
#: Suffixes that are broadcast with their rates at most; more are joined by shuffle.
BROADCAST_SUFFIXES = 200_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def suffix_of(host: Column) -> Column:
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[\d.]*$"), name).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = _name(host)
    labels = F.when(F.substring_index(name, ".", -2).isin(*LONG_SUFFIXES), 3).otherwise(2)
    return F.when(name.rlike(r"^[\d.]*$"), name).when(labels == 3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of rules of one length that both fit (a.org/ and org/ab) the last by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, start = text.partition("/")[0].lower(), text[len(text.partition("/")[0]) :]
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _level(groups: DataFrame, by: str, above: str | None) -> DataFrame:
    """(by, mean, strength) posteriors of a level from rows (by, above, n, bad, prior_mean)."""
    # moments of the squared distance from the prior mean: E (bad - n m)^2 = m (1 - m) n (1 + (n - 1) rho), rho = 1 / (strength + 1)
    m, n, off = F.col("prior_mean"), F.col("n"), F.col("bad") - F.col("n") * F.col("prior_mean")
    over, pairs = groups.where("n > 0").agg(F.sum(off * off - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = min(1.0, max(0.0, over / pairs)) if pairs else 0.0
    prior = min(STRENGTH[1], max(STRENGTH[0], (1 - rho) / rho)) if rho else STRENGTH[1]
    return groups.select(by, *[above] * (above is not None), "n", "bad", ((prior * m + F.col("bad")) / (prior + n)).alias("mean"), (prior + n).alias("strength"))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, bad, mean, strength, low) from rows (host, n, bad), one per host with its outcomes; only sums come to the driver."""
    named = cut(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"))
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    by_suffix = _level(suffixes.withColumn("prior_mean", F.lit(bad / n if n else 0.0)), "suffix", None)
    by_domain = _level(domains.join(small(cut(by_suffix.select("suffix", F.col("mean").alias("prior_mean"))), BROADCAST_SUFFIXES), "suffix"), "domain", "suffix")
    by_host = _level(named.join(by_domain.select("domain", "suffix", F.col("mean").alias("prior_mean")), ["domain", "suffix"]), "host", None)
    low = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return by_host.select("host", "n", "bad", "mean", "strength", low.alias("low"))


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, block_rate: float = BLOCK_RATE) -> DataFrame:
    """pages with the struct column `url_filter` (host, path, rule, verdict, bad_low); a column of that name is replaced."""
    url = F.col(url_col)
    held = pages.select(F.struct(*pages.columns).alias("__p"), host_of(url).alias("__host"), path_of(url).alias("__path"))
    # the last number of a path names the document whose label is the page's outcome
    outcome = pages.select(host_of(url).alias("host"), F.regexp_extract(path_of(url), r"(\d{1,18})[^\d]*$", 1).alias("number"))
    outcome = outcome.groupBy("host", F.when(F.col("number") != "", F.col("number").cast("long")).alias("doc")).agg(F.count("*").alias("pages"))
    bad = F.coalesce(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0), F.lit(0))
    said = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(F.col("doc_id").alias("doc"), bad.alias("bad")).groupBy("doc").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = outcome.join(said, "doc", "left").groupBy("host").agg(F.coalesce(F.sum(F.col("pages") * F.col("n")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("pages") * F.col("bad")), F.lit(0)).alias("bad"))
    low = reputation(counted).select(F.col("host").alias("__h"), "low")
    rule, verdict = longest_rule(F.col("__host"), F.col("__path"), rules)
    out = held.join(low, F.col("__host") == F.col("__h"), "left")
    method = F.when(F.col("low") > block_rate, "block").otherwise("allow")
    struct = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("low").alias("bad_low"))
    return out.select(*[F.col("__p")[c].alias(c) for c in pages.columns if c != "url_filter"], struct.alias("url_filter"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("url_filter")
    out = judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), read_table(spark, sf_dir, "labels"))
    return out.select("page_id", *[x[c].alias(c) for c in ("host", "path", "rule", "verdict")])


def _oracle() -> str:
    """The query in DuckDB's SQL, from the same constants."""
    fits = {
        rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')" for rule, _ in RULES
    }
    by_length = sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in by_length)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in by_length)
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"

    def level(name: str, source: str, keys: str) -> str:
        return f"""{name}_fit AS (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN least(1.0, greatest(0.0, sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) ELSE 0.0 END AS rho FROM {source} WHERE n > 0),
{name} AS (SELECT {keys}, (p * m + bad) / (p + n) AS mean, p + n AS strength FROM {source}, (SELECT CASE WHEN rho > 0 THEN least({STRENGTH[1]}, greatest({STRENGTH[0]}, (1 - rho) / rho)) ELSE {STRENGTH[1]} END AS p FROM {name}_fit))"""

    return f"""
WITH pg AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
said AS (SELECT doc_id AS doc, count(*) AS n, count(*) FILTER (WHERE coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
seen AS (SELECT host, try_cast(nullif(regexp_extract(path, '(\\d{{1,18}})[^\\d]*$', 1), '') AS BIGINT) AS doc FROM pg),
named AS (SELECT host, regexp_replace(host, '^.*@|:\\d*$', '', 'g') AS name, coalesce(sum(said.n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM seen LEFT JOIN said USING (doc) GROUP BY 1),
tree AS (SELECT host, n, bad, CASE WHEN regexp_full_match(name, '[\\d.]*') THEN name WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix,
  CASE WHEN regexp_full_match(name, '[\\d.]*') THEN name WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain FROM named),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM tree GROUP BY 1, 2), suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY 1),
suf_m AS (SELECT *, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.0 END FROM suf) AS m FROM suf),
{level("suf_post", "suf_m", "suffix")},
dom_m AS (SELECT dom.*, mean AS m FROM dom JOIN suf_post USING (suffix)),
{level("dom_post", "dom_m", "domain, suffix")},
host_m AS (SELECT tree.*, mean AS m FROM tree JOIN dom_post USING (domain, suffix)),
{level("host_post", "host_m", "host")}
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN mean - {Z} * sqrt(mean * (1 - mean) / (strength + 1)) > {BLOCK_RATE} THEN 'block' ELSE 'allow' END AS verdict FROM pg JOIN host_post USING (host)
"""


ORACLE_SQL = _oracle()
