"""Campaigns by domain: bulk mailings, harvests of bounces, and outside senders, with a few samples of each.

Counts of different values come from distinct pairs, and only the first few
values of a domain are ever put into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled(rows: DataFrame, key: str, value: str, most: int, count: str, samples: str) -> DataFrame:
    """(key, count, samples): how many different values a key has, and the first of them in order."""
    pairs = rows.select(key, value).filter(F.col(value).isNotNull()).distinct()
    ranked = pairs.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    first = F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.col(value))))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias(count), first.alias(samples))


def bulk_mailing(sessions: DataFrame, recipients: DataFrame, least_mails: int = 5, least_recipients: int = 3) -> DataFrame:
    """(sender_domain, mails, recipients, distinct_starts, subjects, severity) of domains that send many mails to several recipients; sessions without a recipient do not count."""
    sent = sessions.join(recipients.select("session_id").distinct(), "session_id", "left_semi")
    to = sent.select("session_id", "sender_domain").join(recipients.select("session_id", "recipient"), "session_id").select("sender_domain", "recipient").distinct()
    per = sent.groupBy("sender_domain").agg(F.count(F.lit(1)).alias("mails")).filter(F.col("mails") >= least_mails)
    per = per.join(to.groupBy("sender_domain").agg(F.count(F.lit(1)).alias("recipients")).filter(F.col("recipients") >= least_recipients), "sender_domain")
    starts = sent.select("sender_domain", "started_at").distinct().groupBy("sender_domain").agg(F.count("started_at").alias("distinct_starts"))
    rows = per.join(starts, "sender_domain").join(sampled(sent, "sender_domain", "subject", 3, "_n", "subjects"), "sender_domain", "left").drop("_n")
    severity = F.when(F.col("mails") >= 50, "critical").when(F.col("mails") >= 20, "high").when(F.col("mails") >= 10, "medium").otherwise("low")
    return rows.withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>"))).withColumn("severity", severity)


def bounce_harvest(sessions: DataFrame, recipients: DataFrame, least_bounces: int = 10, least_targets: int = 3) -> DataFrame:
    """(rcpt_domain, bounces, targets, samples) of domains whose addresses are tried in many of these (bounced) sessions."""
    rows = recipients.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    bounces = rows.select("rcpt_domain", "session_id").distinct().groupBy("rcpt_domain").agg(F.count(F.lit(1)).alias("bounces")).filter(F.col("bounces") >= least_bounces)
    return bounces.join(sampled(rows, "rcpt_domain", "recipient", 10, "targets", "samples"), "rcpt_domain").filter(F.col("targets") >= least_targets)


def external_senders(sessions: DataFrame, recipients: DataFrame, internal: DataFrame, least_mails: int = 3) -> DataFrame:
    """(sender_domain, mails, recipients, first_seen, last_seen, subjects, recipient_samples) of senders of other domains than internal (domain)."""
    rows = sessions.join(internal.select(F.col("domain").alias("sender_domain")).distinct(), "sender_domain", "left_anti")
    per = rows.groupBy("sender_domain").agg(F.count(F.lit(1)).alias("mails"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen")).filter(F.col("mails") >= least_mails)
    to = rows.select("session_id", "sender_domain").join(recipients.select("session_id", "recipient"), "session_id")
    out = per.join(sampled(rows, "sender_domain", "subject", 5, "_n", "subjects"), "sender_domain", "left").join(sampled(to, "sender_domain", "recipient", 5, "recipients", "recipient_samples"), "sender_domain", "left")
    none = F.array().cast("array<string>")
    return out.select("sender_domain", "mails", F.coalesce("recipients", F.lit(0)).alias("recipients"), "first_seen", "last_seen", F.coalesce("subjects", none).alias("subjects"), F.coalesce("recipient_samples", none).alias("recipient_samples"))
