"""Webmail data security: drafts, self-sends, file uploads and outbound mail with sensitive content.

Each takes sessions and the findings of one DLP pass over their bodies, so the
texts are scanned once whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.operators.dlp import level_of
from courierlens.operators.relational import direction

EXECUTABLE = ("exe", "dll", "scr", "bat", "cmd", "js", "vbs", "ps1", "msi", "jar")
SENSITIVE = ("sql", "bak", "db", "mdb", "pem", "key", "pfx", "kdbx")
ENCRYPTED = ("zip_encrypted", "7z_encrypted", "rar_encrypted", "office_encrypted")


def with_findings(sessions: DataFrame, findings: DataFrame, key: str = "session_id") -> DataFrame:
    """sessions with the classes found in them and the highest level; those without findings have none and 0."""
    per = findings.groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("classes"), F.max(level_of(F.col("class"))).alias("level"))
    joined = sessions.join(per, key, "left")
    return joined.withColumns({"classes": F.coalesce("classes", F.array().cast("array<string>")), "level": F.coalesce("level", F.lit(0))})


def address(mail: Column) -> Column:
    """An address in lower case, without a tag after a plus sign."""
    return F.regexp_replace(F.lower(F.trim(mail)), "[+][^@]*@", "@")


def draft_abuse(found: DataFrame) -> DataFrame:
    """Saved drafts (POST or PUT to a draft address, or to a compose address that saves) with findings other than e-mail addresses."""
    uri = F.lower("uri")
    draft = uri.contains("draft") | (uri.contains("compose") & uri.contains("save"))
    return found.filter(F.col("method").isin("POST", "PUT") & draft & F.exists("classes", lambda c: c != "email_address"))


def self_send(found: DataFrame) -> DataFrame:
    """Mails to the sender's own address with findings."""
    own = F.exists("recipients", lambda r: address(r) == address(F.col("sender")))
    return found.filter(own & (F.size("classes") > 0))


def outbound(found: DataFrame, internal: Sequence[str], least: int = 3) -> DataFrame:
    """Outbound mails with an action: block from the highest level, quarantine from ``least``, else allow."""
    domain = lambda m: F.lower(F.regexp_extract(m, "@(.*)$", 1))
    rows = found.withColumn("direction", direction(domain(F.col("sender")), F.transform("recipients", domain), internal)).filter("direction = 'outbound'")
    return rows.withColumn("action", F.when((F.col("level") >= 4) & (least <= 4), "block").when(F.col("level") >= least, "quarantine").otherwise("allow"))


def file_transit(uploads: DataFrame) -> DataFrame:
    """uploads (filename, declared_type, detected_type, ...) with flags of what their file is, and a severity."""
    ext = F.lower(F.regexp_extract("filename", "[.]([^.]+)$", 1))
    rows = uploads.withColumns({
        "executable": ext.isin(*EXECUTABLE) | F.coalesce(F.col("detected_type") == "executable", F.lit(False)),
        "mismatch": F.coalesce(F.col("detected_type") != F.col("declared_type"), F.lit(False)),
        "encrypted": F.coalesce(F.col("detected_type").isin(*ENCRYPTED), F.lit(False)),
        "sensitive_name": ext.isin(*SENSITIVE),
    })
    severity = F.when(F.col("executable") & F.col("mismatch"), "critical").when(F.col("executable") | F.col("encrypted"), "high").when(F.col("sensitive_name") | F.col("mismatch"), "medium")
    return rows.withColumn("severity", severity).filter("severity is not null")
