"""Retention: what is kept of facts, their children, indicators, state and quarantine, as of a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(facts: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Facts of the last days."""
    return facts.filter(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def of_kept(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Children of facts that are kept."""
    return children.join(kept.select(key).distinct(), key, "left_semi")


def live_indicators(iocs: DataFrame, now: Column) -> DataFrame:
    """Indicators that have not expired; those without an expiry stay."""
    return iocs.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def extended(iocs: DataFrame, chosen: Column, now: Column, days: int) -> DataFrame:
    """iocs, the chosen ones expiring some days after now or after their present expiry, whichever is later."""
    later = F.greatest(F.coalesce("expires_at", now), now) + F.make_dt_interval(F.lit(days))
    return iocs.withColumn("expires_at", F.when(chosen, later).otherwise(F.col("expires_at")))


def live_state(state: DataFrame, now: Column, days: int, least: float = 0.0) -> DataFrame:
    """Entity states seen in the last days, or still over a level."""
    return state.filter((F.col("last_seen") >= now - F.make_dt_interval(F.lit(days))) | (F.col("level") > least))


def held(quarantine: DataFrame, now: Column, days: int) -> DataFrame:
    """Quarantined mails that still wait, or were settled in the last days."""
    return quarantine.filter((F.col("status") == "held") | (F.col("settled_at") >= now - F.make_dt_interval(F.lit(days))))
