"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages (bad or not) are counted by host, registered domain and public suffix.
Each level's bad rate is shrunk towards the level above by a beta prior whose strength comes
from the data: the intraclass correlation of the level's groups (analysis of variance) gives
the number of pseudo-outcomes. A host is blocked if the lower posterior bound of its bad rate
is over a limit. Everything is DataFrame expressions; the url's html is never read. Hosts with
their outcomes are written once; the three strengths are three numbers, worked out from one row
of sums each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import cut


@dataclass(frozen=True)
class UrlRule:
    """``where`` is a host, a slash and the start of a path: ``net/es/``."""

    allow: bool
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return self.where[len(self.host) :]


RULES = (
    UrlRule(True, "com/"), UrlRule(False, "example.com/en/"), UrlRule(True, "www.example.com/en/"), UrlRule(False, "net/es/"),
    UrlRule(False, "net/fr/"),
)


# Public suffixes of two labels; any other last label is a public suffix by itself.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "ed.jp", "co.kr", "or.kr", "ac.kr", "go.kr",
    "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.hk", "org.hk", "edu.hk", "com.tw", "org.tw", "edu.tw",
    "com.sg", "edu.sg", "com.my", "com.ph", "com.vn", "co.th", "ac.th", "co.id", "ac.id", "co.in", "net.in", "org.in", "ac.in",
    "com.pk", "com.bd", "com.br", "org.br", "net.br", "gov.br", "com.ar", "com.mx", "com.co", "com.pe", "com.ve", "com.ec", "com.uy",
    "co.za", "org.za", "ac.za", "co.ke", "com.ng", "com.gh", "com.eg", "co.il", "org.il", "ac.il", "com.sa", "com.tr", "org.tr", "edu.tr",
    "com.ua", "com.pl", "com.gr", "com.pt", "com.ru",
)


@dataclass(frozen=True)
class Reputation:
    """``z``: normal quantile of the bound; a host whose bound is over ``limit`` is blocked."""

    z: float = 1.645
    limit: float = 0.3
    #: pseudo-outcomes of a level's prior stay between these
    least: float = 1.0
    most: float = 1000.0
    suffixes: tuple[str, ...] = SUFFIXES


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(host: Column, path: Column, rules: Sequence[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.where), r.where)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


PORT, ADDRESS = r":[0-9]*$", r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, its port left out; a numeric address is its own domain."""
    name = F.regexp_replace(host, PORT, "")
    labels = F.split(name, r"\.")

    def last(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")

    double, numeric = last(2).isin(*suffixes), name.rlike(ADDRESS)
    domain = F.when(numeric, name).when(double, last(3)).otherwise(last(2))
    return domain, F.when(numeric, F.lit("")).when(double, last(2)).otherwise(last(1))


def _sums(groups: DataFrame, level: str, n: str, bad: str) -> DataFrame:
    """One row of the sums that tell how far the groups' rates agree with each other."""
    return groups.where(f"{n} > 0").agg(
        F.lit(level).alias("level"),
        F.count("*").cast("double").alias("m"),
        F.sum(n).cast("double").alias("t"),
        F.sum(bad).cast("double").alias("b"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"),
        F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)).alias("q"),
    )


def _strength(sums: dict, model: Reputation) -> float:
    """Pseudo-outcomes of a level's prior, from its row of sums."""
    m, t, b, nn, q = (sums[k] or 0.0 for k in ("m", "t", "b", "nn", "q"))
    if m <= 1 or t <= m:
        return model.most
    between, within, size = (q - b * b / t) / (m - 1), (b - q) / (t - m), (t - nn / t) / (m - 1)
    whole = between + (size - 1) * within
    share = (between - within) / whole if whole else 0.0
    return max(model.least, min(model.most, (1 - share) / share)) if share > 0 else model.most


def host_reputation(hosts: DataFrame, model: Reputation) -> DataFrame:
    """``(host, n, bad, bound)`` from ``hosts(host, n, bad)``, n 0 where a host has no outcomes.

    Hosts without outcomes take their domain's prior, else their suffix's, else the overall rate.
    """
    domain, suffix = levels(F.col("host"), model.suffixes)
    known = cut(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")))
    domains = cut(known.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    rows = _sums(suffixes, "s", "sn", "sbad").union(_sums(domains, "d", "dn", "dbad")).union(_sums(known, "h", "n", "bad")).collect()
    sums = {r.level: r.asDict() for r in rows}
    ks, kd, kh = (F.lit(_strength(sums[x], model)) for x in "sdh")
    rate = F.lit(((sums["h"]["b"] or 0.0) + 0.5) / ((sums["h"]["t"] or 0.0) + 1.0))
    above = suffixes.select("suffix", ((F.col("sbad") + ks * rate) / (F.col("sn") + ks)).alias("srate"))
    prior = domains.join(above, "suffix").select("domain", "suffix", ((F.col("dbad") + kd * F.col("srate")) / (F.col("dn") + kd)).alias("drate"))
    both = F.col("n") + kh
    mean = (F.col("bad") + kh * F.col("drate")) / both
    bound = mean - F.lit(model.z) * F.sqrt(mean * (1 - mean) / (both + 1))
    return known.join(prior, ["domain", "suffix"]).select("host", "n", "bad", bound.alias("bound"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[UrlRule] = RULES, model: Reputation | None = None, id_col: str = "page_id",
    url_col: str = "url", label_id: str = "doc_id",
) -> DataFrame:
    """One row per row of ``pages``: ``(id, host, path, rule, verdict, n_labelled, bad_bound)``.

    An outcome is a row of ``labels`` whose id is the page's; it is bad if ``quality`` is 0 or
    ``toxic`` is 1 (null labels are no outcome). Repeated labels of a page are several outcomes;
    repeated pages each carry theirs. A rule fits its host and all subdomains where the path
    begins with its path; the longest rule that fits decides, else the host's reputation. Null
    urls and urls without ``://`` have empty host and path; the empty host has no reputation, so
    outcomes of its pages count nowhere and it is allowed (``n_labelled`` and ``bad_bound`` null).
    A null page id matches no label. Without any outcomes every host has the prior's
    bound. Other columns are ignored. A hot host meets its one reputation row in a sort-merge
    join whose large partitions AQE splits; its outcomes are summed before they are shuffled.
    """
    model = model or Reputation()
    host, path = url_parts(F.col(url_col).cast("string"))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    good = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col(label_id).alias("id"), good.alias("bad")).where("bad is not null and id is not null").groupBy("id").agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad"),
    )
    named = seen.where("host <> ''").join(outcomes, "id", "left")
    counted = named.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    judged = seen.join(host_reputation(counted, model), "host", "left")
    rule = _ruled(F.col("host"), F.col("path"), rules, lambda r: r.where)
    action = _ruled(F.col("host"), F.col("path"), rules, lambda r: "allow" if r.allow else "block")
    own = F.when(F.col("bound") > model.limit, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        F.col("n").alias("n_labelled"), F.round("bound", 6).alias("bad_bound"),
    )


def oracle(rules: Sequence[UrlRule] = RULES, model: Reputation | None = None) -> str:
    """DuckDB SQL for ``filter_urls`` over the views ``pages`` and ``labels``."""
    m = model or Reputation()
    whens = {
        x: " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.where if x == 'rule' else 'allow' if r.allow else 'block'}'" for r in sorted(rules, key=lambda r: (-len(r.where), r.where))
        ) for x in ("rule", "verdict")
    }

    two = ", ".join(f"'{x}'" for x in m.suffixes)

    def last(n: int) -> str:
        return f"array_to_string(list_slice(l, greatest(len(l) - {n - 1}, 1), len(l)), '.')"

    def strength(source: str, n: str, b: str) -> str:
        return f"""(SELECT CASE WHEN share > 0 THEN greatest({m.least}::DOUBLE, least({m.most}::DOUBLE, (1 - share) / share)) ELSE {m.most}::DOUBLE END FROM (
  SELECT (x - y) / nullif(x + (n0 - 1) * y, 0) AS share FROM (
    SELECT CASE WHEN ok THEN (q - b * b / t) / (m - 1) END AS x, CASE WHEN ok THEN (b - q) / (t - m) END AS y, CASE WHEN ok THEN (t - nn / t) / (m - 1) END AS n0 FROM (
      SELECT *, m > 1 AND t > m AS ok FROM (SELECT count(*)::DOUBLE AS m, sum({n})::DOUBLE AS t, sum({b})::DOUBLE AS b, sum({n}::DOUBLE * {n}) AS nn, sum({b}::DOUBLE * {b} / {n}) AS q FROM {source} WHERE {n} > 0)))))"""

    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS id, count(*) AS n, sum(bad) AS bad FROM (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels) WHERE bad IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s LEFT JOIN o ON s.page_id = o.id WHERE host <> '' GROUP BY host),
p AS (SELECT *, regexp_replace(host, '{PORT}', '') AS name, string_split(regexp_replace(host, '{PORT}', ''), '.') AS l FROM c),
hosts AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
  CASE WHEN regexp_matches(name, '{ADDRESS}') THEN '' WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM p),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
prior AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS rate, {strength('suffixes', 'n', 'bad')} AS ks, {strength('domains', 'n', 'bad')} AS kd, {strength('hosts', 'n', 'bad')} AS kh FROM suffixes),
sr AS (SELECT suffix, (bad + ks * rate) / (n + ks) AS srate FROM suffixes, prior),
dr AS (SELECT domain, domains.suffix, (bad + kd * srate) / (n + kd) AS drate FROM domains JOIN sr ON domains.suffix = sr.suffix, prior),
e AS (SELECT host, n, (bad + kh * drate) / (n + kh) AS mean, n + kh AS k FROM hosts JOIN dr ON hosts.domain = dr.domain AND hosts.suffix = dr.suffix, prior),
b AS (SELECT host, n, mean - {m.z}::DOUBLE * sqrt(mean * (1 - mean) / (k + 1)) AS bound FROM e)
SELECT page_id, host, path, CASE {whens['rule']} END AS rule, coalesce(CASE {whens['verdict']} END, CASE WHEN bound > {m.limit}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, n::BIGINT AS n_labelled, round(bound, 6) AS bad_bound
FROM s LEFT JOIN b USING (host)"""
