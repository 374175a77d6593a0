"""URL filters: curated rules first, then the empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or not) are counted by host. A host's rate of good pages is
beta-binomial, its prior centred on the posterior mean of its registered domain, that one's on
its suffix's, and the suffixes' on the mean of all. How strongly each level is held to the one
above is estimated from the data by the method of moments (the overdispersion of the children
around their parents). A host with many outcomes speaks for itself, one with few is shrunk to its
domain, one with none has its domain's rate. The uncertainty of a level's mean is handed down: a host's
variance is that of its own posterior and, by the square of the prior's share in it, that of its domain. A page
is blocked where the posterior's upper bound stays under the least rate wanted: doubt keeps a page.

All of it is DataFrame functions; counts are aggregated before anything is joined, the table of hosts is
staged once, and no table is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered. A whole list is given as a table.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za")
#: (action, host, path) of a rule.
Rule = tuple[str, str, str]
#: Up to so many rules are a literal of the plan; more are joined.
MOST_RULES = 10_000
Z, LEAST_RATE = 1.645, 0.8
#: Bounds of the intraclass correlation that a level's strength is made from.
LEAST_RHO, MOST_RHO = 0.001, 0.9
#: A page's text is good if it has so many words and at most one of these marks in ten words.
LEAST_WORDS, MARKS = 50, "#*$%"
_KIND = "struct<n:int,blocks:int,rule:string,action:string,path:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    found = F.coalesce(at > 0, F.lit(False))
    return F.when(found, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def site_of(host: Column) -> Column:
    """The name that a host's reputation goes by: without user, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def good_text(html: Column) -> Column:
    """Whether a page's text, tags left out, has enough words and few marks; null for a null page."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    words = F.regexp_count(text, F.lit(WORD))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return (words >= LEAST_WORDS) & (marks * 10 <= words)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as (n, blocks, rule, action, path); null if none fits. Of equals, a block wins."""
    if not rules:
        return F.lit(None).cast(_KIND)
    by_host: dict[str, list[Column]] = {}
    for action, at, start in rules:
        by_host.setdefault(at, []).append(F.struct(F.lit(len(at + start)).alias("n"), F.lit(int(action == "block")).alias("blocks"), F.lit(at + start).alias("rule"), F.lit(action).alias("action"), F.lit(start).alias("path")))
    table = F.create_map(*[x for at, found in by_host.items() for x in (F.lit(at), F.array(*found))])
    fitting = F.flatten(F.transform(_ends(host), lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(f"array<{_KIND}>"))))
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path, r["path"])))


def _ends(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_joined(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) for every distinct host and path of ``judged``, as :func:`rule_for`, with ``rules`` (action, host, path) of any number.

    A rule's path is a prefix of one of the lengths that the rules of its host have; so a page looks up one key for each
    domain above it and each such length, however many rules a host has.
    """
    keyed = rules.groupBy(F.col("host").alias("at"), F.col("path").alias("start")).agg(F.min("action").alias("low"), F.max("action").alias("action"))
    keyed = keyed.withColumn("size", F.length("start"))
    lengths = keyed.select(F.col("at").alias("named"), F.col("size").alias("cut")).distinct()
    once = judged.select("host", "path").distinct()
    above = once.select("host", "path", F.explode(_ends(F.col("host"))).alias("end")).join(lengths, F.col("end") == F.col("named"))
    above = above.where(F.length("path") >= F.col("cut")).withColumn("prefix", F.expr("substring(path, 1, cut)"))
    hits = above.join(keyed, (F.col("end") == F.col("at")) & (F.col("prefix") == F.col("start")))
    rule = F.concat("at", "start")
    found = F.struct(F.length(rule).cast("int").alias("n"), (F.col("action") == "block").cast("int").alias("blocks"), rule.alias("rule"), "action", F.col("start").alias("path"))
    return hits.groupBy("host", "path").agg(F.max(found).alias("found"))


def suffix_and_domain(site: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix (the last label, or two of a known pair) and the registered domain below it.

    An address is its own domain, and its suffix is empty, as that of the empty name.
    """
    last = lambda n: F.substring_index(site, ".", -n)
    two = last(2).isin(*two_labels)
    address = site.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    return F.when(address, "").when(two, last(2)).otherwise(last(1)), F.when(address, site).when(two, last(3)).otherwise(last(2))


def registered(sites: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds suffix and domain to ``sites`` (site); ``suffixes`` (suffix), if given, is a whole list of public suffixes of any length."""
    suffix, domain = suffix_and_domain(F.col("site"))
    short = sites.withColumn("suffix", suffix).withColumn("domain", domain)
    if suffixes is None:
        return short
    listed = suffixes.where("suffix <> ''").select(F.col("suffix").alias("listed")).distinct()
    ends = short.where("suffix <> ''").select(F.col("site").alias("of"), F.explode(_ends(F.col("site"))).alias("end"))
    longest = ends.join(listed, F.col("end") == F.col("listed")).groupBy("of").agg(F.max_by("end", F.length("end")).alias("longest"))
    label = F.substring_index(F.expr("substring(site, 1, greatest(length(site) - length(longest) - 1, 0))"), ".", -1)
    below = F.when(F.col("site") == F.col("longest"), F.col("longest")).otherwise(F.concat(label, F.lit("."), "longest"))
    joined = short.join(longest, F.col("site") == F.col("of"), "left")
    return joined.withColumn("domain", F.coalesce(below, "domain")).withColumn("suffix", F.coalesce("longest", "suffix")).drop("of", "longest")


def _moments(children: DataFrame, level: str, k: str, n: str, pk: str, pn: str) -> DataFrame:
    """One row: the spread of a level's rates around their parents' as sums."""
    p, mean = F.try_divide(F.col(k), F.col(n)), F.try_divide(F.col(pk), F.col(pn))
    spread = mean * (1 - mean)
    sums = (F.sum(F.col(n) * (p - mean) * (p - mean)), F.sum(spread), F.sum((F.col(n) - 1) * spread))
    return children.where(F.col(n) > 0).agg(F.lit(level).alias("level"), *(x.alias(c) for x, c in zip(sums, "svw", strict=True)))


def _strength(row) -> float:
    """The pseudo-count of a level's prior: 1/rho - 1; one where nothing is known of the spread."""
    if row["w"] is None or row["w"] <= 0:
        return 1.0
    return 1 / min(max((row["s"] - row["v"]) / row["w"], LEAST_RHO), MOST_RHO) - 1


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None, z: float = Z) -> DataFrame:
    """One row for each site of ``outcomes`` (host, good boolean or null): counts, prior, posterior mean and upper bound.

    Returns host (the site, see :func:`site_of`), domain, suffix, n_labelled, n_good, prior, rate and upper. A null ``good``
    is an unlabelled page: its host gets a reputation, its outcome does not count. Null hosts are left out. Without any
    label the mean of all is one half and every bound is wide. The driver gets four rows of sums.
    """
    counted = outcomes.where(F.col("host").isNotNull()).groupBy(site_of(F.col("host")).alias("site")).agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k"))
    hosts = staged(registered(counted, suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    whole = suffixes_.agg(F.coalesce(F.sum("sk"), F.lit(0)).alias("k"), F.coalesce(F.sum("sn"), F.lit(0)).alias("n")).first()
    mean, doubt = (whole["k"] + 1) / (whole["n"] + 2), (whole["k"] + 1) * (whole["n"] - whole["k"] + 1) / ((whole["n"] + 2) ** 2 * (whole["n"] + 3))
    in_domain = hosts.join(domains.select(F.col("domain").alias("of"), F.col("suffix").alias("under"), "dn", "dk"), (F.col("domain") == F.col("of")) & (F.col("suffix") == F.col("under")))
    in_suffix = domains.join(suffixes_.withColumnRenamed("suffix", "of"), F.col("suffix") == F.col("of"))
    top = suffixes_.withColumn("ak", F.lit(float(whole["k"]))).withColumn("an", F.lit(float(whole["n"])))
    levels = _moments(top, "s", "sk", "sn", "ak", "an").unionByName(_moments(in_suffix, "d", "dk", "dn", "sk", "sn")).unionByName(_moments(in_domain, "h", "k", "n", "dk", "dn"))
    hold = {r["level"]: _strength(r) for r in levels.collect()}

    def posterior(k: str, n: str, level: str, prior: Column, var: Column) -> tuple[Column, Column]:
        """Mean and variance under a prior that is itself only known to ``var``."""
        h = F.lit(hold.get(level, 1.0))
        rate = (F.col(k) + h * prior) / (F.col(n) + h)
        share = h / (F.col(n) + h)
        return rate, rate * (1 - rate) / (F.col(n) + h + 1) + share * share * var

    rate, var = posterior("sk", "sn", "s", F.lit(mean), F.lit(doubt))
    s_rate = suffixes_.select(F.col("suffix").alias("of"), rate.alias("s_rate"), var.alias("s_var"))
    rate, var = posterior("dk", "dn", "d", F.col("s_rate"), F.col("s_var"))
    d_rate = domains.join(s_rate, F.col("suffix") == F.col("of")).select(F.col("domain").alias("named"), F.col("suffix").alias("under"), rate.alias("d_rate"), var.alias("d_var"))
    rate, var = posterior("k", "n", "h", F.col("d_rate"), F.col("d_var"))
    made = hosts.join(d_rate, (F.col("domain") == F.col("named")) & (F.col("suffix") == F.col("under")))
    return made.select(F.col("site").alias("host"), "domain", "suffix", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), F.col("d_rate").alias("prior"), rate.alias("rate"), (rate + z * F.sqrt(var)).alias("upper"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, outcomes: DataFrame | None = None, least_rate: float = LEAST_RATE, suffixes: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, optional html): page_id, host, path, rule, verdict, upper.

    The verdict is the longest fitting rule's, else ``block`` if the upper bound of the host's rate of
    good pages is under ``least_rate``, else ``allow``. ``rules`` are a sequence or, however many, a table (action, host,
    path). ``outcomes`` (host, good) are labelled pages; where it is None the pages themselves are: good or not as the
    rule says that decides them, else as their text does (:func:`good_text`; a page without html is not labelled).

    Nulls: a null url, and one without ``://``, has an empty host and path, and is judged as the host
    ``''``. A null page_id is carried. Very long urls are read whole. Repeated rows count and are
    returned each. Other columns are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    text = good_text(F.col("html")) if "html" in pages.columns else F.lit(None).cast("boolean")
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("good"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    if isinstance(rules, DataFrame):
        found = rules_joined(judged, rules).select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), "found")
        judged = judged.join(found, (F.col("host") == F.col("at_host")) & (F.col("path") == F.col("at_path")), "left").drop("at_host", "at_path")
    else:
        judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    known = judged.select("host", F.coalesce(F.col("found.action") == "allow", F.col("good")).alias("good"))
    if outcomes is not None:
        known = judged.select("host", F.lit(None).cast("boolean").alias("good")).unionByName(outcomes.select("host", "good"))
    standing = reputations(known, suffixes).select(F.col("host").alias("of"), "upper")
    method = F.when(F.col("upper") < least_rate, F.lit("block")).otherwise(F.lit("allow"))
    out = judged.join(standing, site_of(F.col("host")) == F.col("of"), "left")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.action"), method).alias("verdict"), F.round("upper", 6).alias("upper"))


#: The rules of the query, in the order in which they are given.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

ORACLE = rf"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         regexp_replace(html, '<[^>]*>', ' ', 'g') AS shown FROM cut),
ruled AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS site,
    len(regexp_extract_all(shown, '{WORD}')) AS words, length(shown) - length(translate(shown, '{MARKS}', '')) AS marks, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parts),
acted AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM ruled),
judged AS (SELECT *, coalesce(action = 'allow', words >= {LEAST_WORDS} AND marks * 10 <= words) AS good FROM acted),
hosts0 AS (SELECT site, count(good) AS n, coalesce(count(*) FILTER (good), 0)::BIGINT AS k, string_split(site, '.') AS l FROM judged GROUP BY site),
hosts1 AS (SELECT *, regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$|^\[') AS address, array_to_string(l[-2:], '.') IN ({", ".join(repr(x) for x in TWO_LABEL_SUFFIXES)}) AS two FROM hosts0),
hosts AS (SELECT site, n, k, CASE WHEN address THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
                 CASE WHEN address THEN site WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM hosts1),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS dn, sum(k)::BIGINT AS dk FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dk)::BIGINT AS sk FROM domains GROUP BY suffix),
overall AS (SELECT coalesce(sum(sk), 0)::DOUBLE AS ak, coalesce(sum(sn), 0)::DOUBLE AS an FROM suffixes),
pairs AS (
  SELECT 's' AS level, sk::DOUBLE AS k, sn::DOUBLE AS n, ak / nullif(an, 0) AS m FROM suffixes, overall
  UNION ALL SELECT 'd', dk, dn, sk::DOUBLE / nullif(sn, 0) FROM domains JOIN suffixes USING (suffix)
  UNION ALL SELECT 'h', k, n, dk::DOUBLE / nullif(dn, 0) FROM hosts JOIN domains USING (domain, suffix)),
moments AS (
  SELECT level, sum(n * (k / n - m) * (k / n - m)) AS s, sum(m * (1 - m)) AS v, sum((n - 1) * m * (1 - m)) AS w FROM pairs WHERE n > 0 GROUP BY level),
holds AS (SELECT level, CASE WHEN w > 0 THEN 1 / least(greatest((s - v) / w, {LEAST_RHO}), {MOST_RHO}) - 1 ELSE 1 END AS hold FROM moments),
hold AS (SELECT coalesce(max(hold) FILTER (level = 's'), 1) AS s, coalesce(max(hold) FILTER (level = 'd'), 1) AS d, coalesce(max(hold) FILTER (level = 'h'), 1) AS h FROM holds),
s0 AS (SELECT suffix, sn, hold.s AS h, (sk + hold.s * (ak + 1) / (an + 2)) / (sn + hold.s) AS rate, (ak + 1) * (an - ak + 1) / ((an + 2) ** 2 * (an + 3)) AS var FROM suffixes, hold, overall),
s1 AS (SELECT suffix, rate AS s_rate, rate * (1 - rate) / (sn + h + 1) + (h / (sn + h)) ** 2 * var AS s_var FROM s0),
d0 AS (SELECT domain, suffix, dn, hold.d AS h, (dk + hold.d * s_rate) / (dn + hold.d) AS rate, s_var FROM domains JOIN s1 USING (suffix), hold),
d1 AS (SELECT domain, suffix, rate AS d_rate, rate * (1 - rate) / (dn + h + 1) + (h / (dn + h)) ** 2 * s_var AS d_var FROM d0),
h0 AS (SELECT site, n, hold.h AS h, (k + hold.h * d_rate) / (n + hold.h) AS rate, d_var FROM hosts JOIN d1 USING (domain, suffix), hold),
standing AS (SELECT site, rate + {Z} * sqrt(rate * (1 - rate) / (n + h + 1) + (h / (n + h)) ** 2 * d_var) AS upper FROM h0)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN upper < {LEAST_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(upper, 6) AS upper
FROM judged JOIN standing USING (site)
"""
