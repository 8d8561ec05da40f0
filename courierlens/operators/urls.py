"""Checks of URLs and of their hosts: each distinct one is looked at once, and the findings are joined back.

Word lists are kept by administrators and are arguments. A finding has the
family ``domain`` or ``content``, a category and a score; scores of one URL
add up within a family.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.operators.text import COMPOUND_SUFFIXES, host_of, registrable


class Lists(NamedTuple):
    """Words and domains that the checks look for."""

    tlds: Sequence[str] = ()
    hosters: Sequence[str] = ()
    readable: Sequence[str] = ()
    numeric: Sequence[str] = ()
    trusted: Sequence[str] = ()
    paths: Sequence[str] = ()
    params: Sequence[str] = ()


def _finding(category: str, holds: Column, score: Column | float) -> Column:
    value = score if isinstance(score, Column) else F.lit(score)
    return F.when(holds, F.struct(F.lit(category).alias("category"), value.cast("double").alias("score")))


def _some(column: Column, words: Sequence[str], test: str) -> Column:
    return reduce(Column.__or__, (getattr(column, test)(w) for w in words), F.lit(False))


def host_findings(hosts: DataFrame, lists: Lists) -> DataFrame:
    """(host, category, score) of distinct hosts: what their labels look like."""
    h, labels = F.col("host"), F.split("host", "[.]")
    first, n = F.get(labels, F.lit(0)), F.size(labels)
    compound = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".").isin(*COMPOUND_SUFFIXES)
    main = F.coalesce(F.get(labels, n - F.when(compound, 3).otherwise(2)), first)
    after = F.regexp_replace(F.regexp_replace(first, "^www", ""), "^-+|-+$", "")
    odd = ~main.isin(*lists.readable)
    cluster = (F.length(main) >= 6) & main.rlike("[bcdfghjklmnpqrstvwxyz]{4,}")
    consonants = F.length(F.regexp_replace(main, "[^a-z]|[aeiou]", ""))
    octets = F.split(first, "-")
    checks = (
        _finding("suspicious_tld", F.element_at(labels, -1).isin(*lists.tlds), 0.15),
        _finding("www_impersonation", (n >= 2) & first.startswith("www") & (F.length(first) > 3) & ~after.rlike("^[0-9]+$"), 0.25),
        _finding("free_hosting", _some(h, lists.hosters, "endswith"), 0.20),
        _finding("long_domain", F.length(h) > 40, 0.15),
        _finding("deep_subdomain", n > 4, 0.15),
        _finding("random_domain", odd & (cluster | ((F.length(main) >= 5) & (10 * consonants >= 7 * F.length(main)))), 0.20),
        _finding("numeric_domain", main.rlike("^[0-9]{4,}$") & ~registrable(h).isin(*lists.numeric), 0.15),
        _finding("embedded_ip", (F.size(octets) == 4) & F.forall(octets, lambda o: o.rlike("^(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$")), 0.20),
    )
    return hosts.select("host").distinct().select("host", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("host", "f.*")


def url_findings(urls: DataFrame, lists: Lists, url: str = "url") -> DataFrame:
    """(url, category, score) of distinct URLs: words of their paths and parameters, length, and encodings that hide something.

    Hosts of trusted domains, and what is below them, give none.
    """
    plain = F.col(url)
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    rows = urls.select(url).distinct().select(url, F.lower(plain).alias("_u"))
    rest = F.regexp_replace("_u", "^https?://", "")
    whole = F.split_part(rest, F.lit("#"), F.lit(1))
    before, query = F.split_part(whole, F.lit("?"), F.lit(1)), F.regexp_extract(whole, "[?](.*)$", 1)
    path = F.when(before.contains("/"), F.regexp_extract(before, "(/.*)$", 1)).otherwise("/")
    rows = rows.select(url, "_u", path.alias("_path"), F.concat(path, F.lit(" "), F.regexp_extract(rest, "#(.*)$", 1)).alias("_said"), F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))).alias("_params"),
        F.regexp_extract(rest, "^[^/?#]*", 0).alias("_authority"), host_of(F.col("_u")).alias("_host"))
    trusted = reduce(Column.__or__, ((F.col("_host") == d) | F.col("_host").endswith(f".{d}") for d in lists.trusted), F.lit(False))
    words = reduce(Column.__add__, (F.col("_said").contains(w).cast("int") for w in lists.paths), F.lit(0))
    names = reduce(Column.__add__, (F.array_contains("_params", w).cast("int") for w in lists.params), F.lit(0))
    checks = (
        _finding("suspicious_path", words > 0, F.least(F.lit(0.30), 0.10 * words)),
        _finding("suspicious_params", names > 0, F.least(F.lit(0.25), 0.08 * names)),
        _finding("long_url", F.length("_u") > 400, 0.10),
        _finding("double_encoding", F.col("_path").contains("%25"), 0.25),
        _finding("encoded_separator", F.col("_path").contains("%2f") | F.col("_path").contains("%5c"), 0.15),
        _finding("at_sign_obfuscation", F.col("_authority").contains("@"), 0.35),
    )
    return rows.filter(~trusted).select(url, F.explode(F.array_compact(F.array(*checks))).alias("f")).select(url, "f.*")


def findings(links: DataFrame, lists: Lists, url: str = "url") -> DataFrame:
    """(url, host, family, category, score) of the distinct URLs of links; what is found of a host holds for all its URLs."""
    each = links.select(url).distinct().withColumn("host", host_of(F.col(url))).filter("host <> ''")
    of_hosts = each.join(host_findings(each, lists), "host").select(url, "host", F.lit("domain").alias("family"), "category", "score")
    of_urls = url_findings(each, lists, url).join(each, url).select(url, "host", F.lit("content").alias("family"), "category", "score")
    return of_hosts.unionByName(of_urls)


def message_scores(links: DataFrame, found: DataFrame, id_: str, url: str = "url") -> DataFrame:
    """(id, n_links, domain_score, content_score): the worst link of a message in each family, 1 at most; 0 without a finding."""
    per = found.groupBy(url).agg(*(F.least(F.lit(1.0), F.sum(F.when(F.col("family") == k, F.col("score")).otherwise(0.0))).alias(f"{k}_score") for k in ("domain", "content")))
    each = links.select(id_, url).distinct().join(per, url, "left")
    return each.groupBy(id_).agg(F.count(F.lit(1)).alias("n_links"), *(F.coalesce(F.max(f"{k}_score"), F.lit(0.0)).alias(f"{k}_score") for k in ("domain", "content")))


def domain_scores(links: DataFrame, found: DataFrame, id_: str, url: str = "url") -> DataFrame:
    """(domain, n_messages, n_urls, score): of each registered domain with a finding, its messages and URLs and the greatest sum of a URL's findings."""
    per = found.groupBy(url).agg(F.least(F.lit(1.0), F.sum("score")).alias("score"))
    each = links.select(id_, url).distinct().join(per, url, "left").withColumn("domain", registrable(host_of(F.col(url))))
    counted = each.groupBy("domain").agg(F.count_distinct(id_).alias("n_messages"), F.count_distinct(url).alias("n_urls"), F.max("score").alias("score"))
    return counted.filter("score is not null")
