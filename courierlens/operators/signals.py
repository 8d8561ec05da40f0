"""Signals of mails: structural checks, content lures, and the indicators that some of them leave.

Checks are tables of conditions over derived columns of one row per message,
so all of them are one projection; findings are one long table, and counts per
domain and day follow from it. Word lists are kept by administrators and are
arguments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (family, category, condition over the columns of derived()).
MESSAGE_RULES: tuple[tuple[str, str, str], ...] = (
    ("subject", "mass_mailing", "n_recipients > 10"),
    ("subject", "no_recipients", "n_recipients = 0"),
    ("subject", "all_caps_subject", "n_letters >= 5 AND n_upper = n_letters AND 10 * n_letters >= 4 * (n_letters + n_digits) AND NOT has_han AND NOT is_file_name"),
    ("subject", "multilingual_gibberish", "n_scripts >= 3"),
    ("subject", "empty_subject", "subject_length = 0 AND n_attachments = 0"),
    ("subject", "empty_subject_with_attachment", "subject_length = 0 AND (n_dangerous > 0 OR n_attachments > 1)"),
    ("subject", "off_hours_send", "sent_hour < 5 AND (is_urgent OR n_attachments > 0)"),
    ("subject", "spam_cannon", "n_recipients > 50"),
    ("identity", "display_name_spoof", "display_domain <> '' AND display_domain <> from_domain"),
    ("identity", "envelope_mismatch", "envelope_domain <> '' AND envelope_domain <> from_domain"),
    ("identity", "reply_chain_anomaly", "is_reply AND NOT has_parent"),
    ("identity", "random_sender", "NOT known_domain AND NOT known_name AND sender_length >= 5 AND sender_letters = sender_length AND sender_consonants >= 4"),
    ("identity", "random_domain", "NOT known_domain AND label_length >= 4 AND (label_consonants >= 5 OR label_length <= 8 AND label_digits > 0 AND label_letters BETWEEN 1 AND 5)"),
    ("header", "domain_mismatch", "reply_domain <> '' AND reply_domain <> from_domain"),
    ("header", "auth_spf_dmarc_fail", "spf_fail AND dmarc_fail"),
    ("header", "auth_spf_fail", "spf_fail AND NOT dmarc_fail"),
    ("header", "auth_dmarc_fail", "dmarc_fail AND NOT spf_fail"),
    ("header", "no_auth_results", "NOT has_auth"),
    ("header", "missing_date", "NOT has_date"),
    ("header", "future_date", "has_date AND skew_seconds >= 3601"),
    ("header", "stale_date", "has_date AND skew_seconds <= -691200"),
    ("header", "missing_message_id", "NOT has_message_id"),
    ("header", "no_received", "n_received = 0"),
    ("header", "excessive_hops", "n_received > 15"),
    ("mime", "missing_from", "from_domain = ''"),
    ("mime", "empty_content_type", "NOT has_type"),
    ("mime", "multi_address_from", "n_from > 1"),
    ("attachment", "dangerous_extension", "n_dangerous > 0"),
    ("attachment", "double_extension", "n_double > 0"),
    ("attachment", "mime_mismatch", "n_mismatch > 0"),
    ("attachment", "zero_byte", "n_empty > 0"),
    ("attachment", "oversized", "n_large > 0"),
)
#: Extensions of programs, and the greatest size of an attachment.
DANGEROUS = ("exe", "scr", "bat", "cmd", "com", "pif", "vbs", "vbe", "js", "jse", "wsf", "hta", "ps1", "msi", "jar", "lnk", "iso", "img")
LARGEST = 25 * 1024 * 1024
#: What makes a mail of the small hours urgent, and letters that are no vowels.
URGENT = ("urgent", "immediately", "asap", "verify", "verification", "confirm", "suspended", "locked", "expire", "expired", "紧急", "立即", "尽快", "验证", "确认", "冻结", "停用", "限时")
CONSONANTS = "[bcdfghjklmnpqrstvwxyz]+"
HAN, OTHER_SCRIPTS = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]", "[\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0900}-\\x{097F}\\x{0E00}-\\x{0E7F}\\x{1000}-\\x{109F}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def domain_of(address: Column) -> Column:
    """The domain of an address in lower case, or nothing."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(address, "@([^@>\\s]+)>?\\s*$", 1), F.lit("")), F.lit("")))


def derived(messages: DataFrame, known_domains: Sequence[str] = (), known_names: Sequence[str] = ()) -> DataFrame:
    """message_id, day, and the columns that the rules look at.

    messages: message_id, sent_at, received_at, sent_offset (minutes that the
    Date header is ahead of UTC), subject, from_header, envelope_from, reply_to,
    display_name, recipients, in_reply_to, auth_results, n_received, id_header,
    content_type, attachments (array of name, declared, detected, size).
    known_domains (ours, public mail services, brands; with what is below them)
    and known_names are never random.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    subject, files = text("subject"), F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType))
    left = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.lower(c), F.lit(f"({CONSONANTS})"), 1), F.length)), F.lit(0))
    scripts = [subject.rlike(p).cast("int") for p in ("[A-Za-z]", HAN, OTHER_SCRIPTS)]
    sender = F.trim(F.regexp_replace(F.coalesce("envelope_from", "from_header", F.lit("")), "[<>]", ""))
    local, domain = F.split_part(sender, F.lit("@"), F.lit(1)), domain_of(sender)
    label = F.split_part(domain, F.lit("."), F.lit(1))
    known = reduce(Column.__or__, ((domain == d) | domain.endswith(f".{d}") for d in known_domains), F.lit(False))
    parts = lambda x: F.split(F.lower(x["name"]), "[.]")
    dangerous = lambda x: (F.size(parts(x)) > 1) & F.element_at(parts(x), -1).isin(*DANGEROUS)
    count = lambda f: F.size(F.filter(files, f))
    auth = F.lower(text("auth_results"))
    sent, received = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("sent_at", "received_at"))
    declared = F.pmod(F.floor((sent / 60_000_000 + F.coalesce("sent_offset", F.lit(0))) / 60), F.lit(24))
    return messages.select(
        "message_id",
        F.to_date("received_at").alias("day"),
        domain_of(F.col("from_header")).alias("from_domain"),
        domain_of(F.col("envelope_from")).alias("envelope_domain"),
        domain_of(F.col("reply_to")).alias("reply_domain"),
        domain_of(F.col("display_name")).alias("display_domain"),
        F.size(F.coalesce("recipients", F.array().cast("array<string>"))).alias("n_recipients"),
        left(subject, "[A-Za-z]").alias("n_letters"),
        left(subject, "[A-Z]").alias("n_upper"),
        left(subject, "[0-9]").alias("n_digits"),
        subject.rlike(HAN).alias("has_han"),
        F.trim(subject).rlike("^[A-Za-z0-9._\\- ()]+[.][A-Za-z0-9]{2,5}$").alias("is_file_name"),
        reduce(Column.__add__, scripts).alias("n_scripts"),
        F.length(F.trim(subject)).alias("subject_length"),
        reduce(Column.__or__, (F.lower(subject).contains(w) for w in URGENT)).alias("is_urgent"),
        F.size(files).alias("n_attachments"),
        declared.alias("sent_hour"),
        F.lower(subject).startswith("re:").alias("is_reply"),
        F.col("in_reply_to").isNotNull().alias("has_parent"),
        known.alias("known_domain"),
        F.lower(local).isin(*known_names).alias("known_name"),
        F.length(local).alias("sender_length"),
        left(local, "[A-Za-z]").alias("sender_letters"),
        longest(local).alias("sender_consonants"),
        F.length(label).alias("label_length"),
        left(label, "[a-z]").alias("label_letters"),
        left(label, "[0-9]").alias("label_digits"),
        longest(label).alias("label_consonants"),
        auth.contains("spf=fail").alias("spf_fail"),
        auth.contains("dmarc=fail").alias("dmarc_fail"),
        (auth != "").alias("has_auth"),
        F.col("sent_at").isNotNull().alias("has_date"),
        ((sent - received) / 1e6).alias("skew_seconds"),
        F.col("id_header").isNotNull().alias("has_message_id"),
        F.coalesce("n_received", F.lit(0)).alias("n_received"),
        (text("content_type") != "").alias("has_type"),
        (F.length(text("from_header")) - F.length(F.translate(text("from_header"), "@", ""))).alias("n_from"),
        count(dangerous).alias("n_dangerous"),
        count(lambda x: dangerous(x) & (F.size(parts(x)) > 2)).alias("n_double"),
        count(lambda x: x["declared"] != x["detected"]).alias("n_mismatch"),
        count(lambda x: x["size"] == 0).alias("n_empty"),
        count(lambda x: x["size"] > LARGEST).alias("n_large"),
    )


def message_findings(messages: DataFrame, rules: Sequence[tuple[str, str, str]] = MESSAGE_RULES, known_domains: Sequence[str] = (), known_names: Sequence[str] = ()) -> DataFrame:
    """(message_id, day, from_domain, family, category) of every check that a message fails."""
    hits = F.array(*(F.when(F.expr(condition), F.struct(F.lit(family).alias("family"), F.lit(category).alias("category"))) for family, category, condition in rules))
    found = derived(messages, known_domains, known_names).select("message_id", "day", "from_domain", F.explode(F.array_compact(hits)).alias("f"))
    return found.select("message_id", "day", "from_domain", "f.*")


def finding_counts(findings: DataFrame) -> DataFrame:
    """(from_domain, day, category, n): partial counts merge before the shuffle."""
    return findings.groupBy("from_domain", "day", "category").agg(F.count(F.lit(1)).alias("n"))


#: Lure -> (condition, score) over the counts of words of each list in the subject (s_) or body (b_).
LURES: dict[str, tuple[str, str]] = {
    "gateway_pre_classified": ("s_gateway + b_gateway > 0", "0.05"),
    "phishing_subject": ("s_phishing > 0", "LEAST(0.5, 0.10 * s_phishing)"),
    "phone_in_subject": ("s_phones > 0 AND s_chat = 0", "0.15"),
    "image_only_phishing": ("body_length < 50 AND n_images > 0", "0.15"),
    "account_security_phishing": ("external AND (b_threat > 0 AND b_action > 0 OR s_threat > 0)", "CASE WHEN b_threat > 0 AND b_action > 0 THEN CASE WHEN well_known THEN 0.30 ELSE 0.65 END WHEN well_known THEN 0.20 ELSE 0.50 END"),
    "subsidy_fraud": ("external AND (b_subsidy >= 2 AND b_urgency > 0 OR s_subsidy >= 2)", "CASE WHEN b_subsidy >= 2 AND b_urgency > 0 THEN 0.60 ELSE 0.45 END"),
    "invoice_spam": ("external AND b_invoice >= 1 AND (b_contact >= 2 OR b_contact >= 1 AND b_phones >= 1)", "CASE WHEN b_phones >= 1 THEN 0.62 ELSE 0.52 END"),
    "external_impersonation": ("external AND b_authority >= 2 AND s_chat = 0", "0.30"),
    "lang_inconsistency": ("b_signature > 0 AND body_length > 20 AND 10 * n_han > 3 * body_length", "0.08"),
}
PHONES_ALONE = "b_phones >= 2 AND s_phones = 0"
LISTS = {"s": ("gateway", "phishing", "threat", "subsidy", "chat"), "b": ("gateway", "threat", "action", "subsidy", "urgency", "invoice", "contact", "authority", "signature")}
PHONE = "(?:^|[^0-9])(1[3-9][0-9]{9})"


def content_lures(mails: DataFrame, words: dict[str, Sequence[str]], internal: Sequence[str], well_known: Sequence[str]) -> DataFrame:
    """(message_id, lure, score) from mails (message_id, sender_domain, subject, body, n_images).

    Several telephone numbers in a body count only beside another lure.
    """
    subject, body = (F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "body"))
    solid = F.regexp_replace("_b", "\\s", "")
    rows = mails.select("message_id", F.lower(F.coalesce("sender_domain", F.lit(""))).alias("_d"), subject.alias("_s"), body.alias("_b"), F.coalesce("n_images", F.lit(0)).alias("n_images"))
    hits = lambda c, names: reduce(Column.__add__, (F.col(c).contains(w).cast("int") for w in names), F.lit(0))
    phones = lambda c: F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(PHONE), 1)))
    rows = rows.select(
        "message_id", "n_images", *(hits(f"_{c}", words.get(k, ())).alias(f"{c}_{k}") for c, kinds in LISTS.items() for k in kinds), phones("_s").alias("s_phones"), phones("_b").alias("b_phones"),
        (~F.col("_d").isin(*internal)).alias("external"), F.col("_d").isin(*well_known).alias("well_known"), F.length(solid).alias("body_length"), F.length(F.regexp_replace("_b", "[^\\x{4E00}-\\x{9FFF}]", "")).alias("n_han"),
    )
    found = [F.when(F.expr(c), F.struct(F.lit(k).alias("lure"), F.expr(s).cast("double").alias("score"))) for k, (c, s) in LURES.items()]
    some = F.array_compact(F.array(*found))
    phone = F.when(F.expr(PHONES_ALONE), F.array(F.struct(F.lit("phone_in_body").alias("lure"), F.least(F.lit(0.12), 0.04 * F.col("b_phones")).alias("score"))))
    rows = rows.select("message_id", some.alias("f"), phone.alias("p"))
    both = F.when((F.size("f") > 0) & F.col("p").isNotNull(), F.concat("f", "p")).otherwise(F.col("f"))
    return rows.select("message_id", F.explode(both).alias("x")).select("message_id", "x.*")


#: Threat rank of a critical verdict, the least likeness and sureness of special indicators, and the sureness of those of spoofing.
CRITICAL, ALIKE, VERY_ALIKE, SURE, SPOOFED = 4, 0.30, 0.40, 0.70, 0.6


def special_iocs(sessions: DataFrame, internal: DataFrame, lookalikes: DataFrame, allowed: DataFrame, private: str) -> DataFrame:
    """(indicator, ioc_type, attack, confidence, hits) from mails that spoof our domain, come from look-alikes, or make no sense.

    sessions: session_id, mail_from, recipients, origin_ip, rank (of the verdict), nonsense_rank and nonsense_confidence.
    internal (domain) and lookalikes (domain, score) are joined; allowed (ioc_type, indicator) become indicators of spoofing only,
    and an allowed domain is no look-alike.
    """
    ours = internal.select(F.lower("domain").alias("d")).distinct()
    rows = sessions.withColumns({"sender": F.lower(F.trim("mail_from")), "sender_domain": domain_of(F.col("mail_from"))})
    public = F.coalesce(F.col("origin_ip") != "", F.lit(False)) & ~F.coalesce(F.col("origin_ip").rlike(private), F.lit(True))
    of = lambda kind, value, sure: F.struct(F.lit(kind).alias("ioc_type"), value.alias("indicator"), sure.alias("confidence"))

    def of_sender(sure: Column, of_ip: Column) -> Column:
        """The public address, the e-mail address and the domain that a mail comes from."""
        domain, sender = F.col("sender_domain"), F.col("sender")
        return F.explode(F.array_compact(F.array(F.when(public, of("ip", F.col("origin_ip"), of_ip)), F.when(sender != "", of("email", sender, sure)), F.when(domain != "", of("domain", domain, sure)))))

    inside = rows.filter(F.col("rank") >= CRITICAL).join(ours, F.col("sender_domain") == F.col("d"), "left_semi")
    to_us = inside.select("session_id", F.explode("recipients").alias("r")).join(ours, domain_of(F.col("r")) == F.col("d"), "left_semi").select("session_id").distinct()
    spoofed = inside.join(to_us, "session_id", "left_semi").select(of_sender(F.lit(SPOOFED), F.lit(SPOOFED)).alias("i"), F.lit("spoofing").alias("attack"))
    passed = allowed.filter("ioc_type = 'domain'").select(F.col("indicator").alias("d")).distinct()
    alike = rows.join(lookalikes.filter(F.col("score") >= ALIKE).join(passed, F.col("domain") == F.col("d"), "left_anti").select(F.col("domain").alias("d"), "score"), F.col("sender_domain") == F.col("d"))
    sure = F.when(F.col("score") >= VERY_ALIKE, 0.80).otherwise(0.70)
    mimic = alike.select(of_sender(sure, sure * 0.8).alias("i"), F.lit("domain_impersonation").alias("attack"))
    odd = rows.filter((F.col("nonsense_confidence") >= SURE) & (F.col("nonsense_rank") >= CRITICAL))
    likely = F.col("nonsense_confidence")
    nonsense = odd.select(of_sender(likely, likely).alias("i"), F.lit("nonsensical_spam").alias("attack"))
    kept = mimic.unionByName(nonsense).select("i.*", "attack").join(allowed.select("ioc_type", "indicator").distinct(), ["ioc_type", "indicator"], "left_anti")
    kept = kept.unionByName(spoofed.select("i.*", "attack"))
    return kept.groupBy("indicator", "ioc_type", "attack").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("hits"))
