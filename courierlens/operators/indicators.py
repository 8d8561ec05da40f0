"""Indicators in mails: taken out of sessions, matched with what is known, and recorded from verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.operators.signals import domain_of

#: Attack type -> parts of category names, the first that fits; days until an automatic indicator expires.
ATTACKS = (
    ("phishing", ("phishing", "url_typo", "brand_impersonation")), ("bec", ("bec",)), ("malware", ("malware", "dangerous_extension")), ("nonsensical_spam", ("nonsensical",)),
    ("spam", ("spam", "mass_mailing")), ("data_leak", ("dlp",)), ("injection", ("xss", "header_injection")),
)
DAYS = 30


def attack_type(categories: Column) -> Column:
    """The attack of the first category that names one."""

    def one(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, parts in reversed(ATTACKS):
            out = F.when(F.lower(c).rlike("|".join(parts)), name).otherwise(out)
        return out

    return F.coalesce(F.get(F.filter(F.transform(categories, one), lambda x: x.isNotNull()), F.lit(0)), F.lit("unknown"))


def observables(sessions: DataFrame, private: str) -> DataFrame:
    """(session_id, ioc_type, indicator), each once: public addresses, senders, their domains, file hashes and links, normalised.

    sessions: session_id, ip, mail_from, hashes and urls (arrays).
    """
    of = lambda kind, v: F.when(F.coalesce(v != "", F.lit(False)), F.struct(F.lit(kind).alias("ioc_type"), v.alias("indicator")))
    listed = lambda kind, c, f: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: of(kind, f(v)))
    mail = F.lower(F.trim("mail_from"))
    single = F.array(of("ip", F.when(~F.col("ip").rlike(private), F.col("ip"))), of("email", F.when(mail.contains("@"), mail)), of("domain", domain_of(F.col("mail_from"))))
    each = F.array_compact(F.concat(single, listed("hash", F.col("hashes"), lambda v: F.lower(F.trim(v))), listed("url", F.col("urls"), lambda v: F.regexp_replace(F.trim(v), "[#].*$", ""))))
    return sessions.select("session_id", F.explode(F.array_distinct(each)).alias("o")).select("session_id", "o.*")


def enriched(seen: DataFrame, iocs: DataFrame, allowed: DataFrame) -> DataFrame:
    """(session_id, ioc_type, indicator, hits, confidence, verdict): observables that are known as malicious or suspicious and not allowed.

    Known rows are put together first, so the join adds one row for each message and indicator.
    """
    keys = ["ioc_type", "indicator"]
    bad = iocs.filter("verdict <> 'clean'").join(allowed.select(*keys).distinct(), keys, "left_anti")
    known = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.max("confidence").alias("confidence"), F.min("verdict").alias("verdict"))
    return seen.join(known, keys).select("session_id", *keys, "hits", "confidence", "verdict")


def from_verdicts(verdicts: DataFrame, seen: DataFrame, allowed: DataFrame, least: float = 0.85) -> DataFrame:
    """(ioc_type, indicator, attack_type, hit_count, confidence, expires_at) of the observables of critical verdicts (session_id, risk, confidence, created_at, categories)."""
    critical = verdicts.filter(F.col("risk") >= least).select("session_id", "confidence", "created_at", attack_type(F.col("categories")).alias("attack_type"))
    keys = ["ioc_type", "indicator"]
    rows = critical.join(seen, "session_id").join(allowed.select(*keys).distinct(), keys, "left_anti")
    expiry = F.max("created_at") + F.make_dt_interval(F.lit(DAYS))
    return rows.groupBy(*keys).agg(F.min("attack_type").alias("attack_type"), F.count(F.lit(1)).alias("hit_count"), F.max("confidence").alias("confidence"), expiry.alias("expires_at"))
