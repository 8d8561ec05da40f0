"""The default verdict's context: which cluster a finding belongs to, scenario flags, scaling, floors and caps.

Findings are rows (session_id, module, rank, score, weight, confidence,
categories); rank is 0 for a safe one. The rules are tables of conditions over
one row per session, with a column for each cluster's score and each flag, so
Spark evaluates all of them in one projection, and a rule is added as a line.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.operators.verdicts import CLUSTERS, cluster_verdict, clusters
from courierlens.shared import written

#: Column of a session row -> the cluster whose score it holds.
SHORT = dict(zip(("inherited", "delivery", "identity", "link", "payload", "external", "social", "business"), CLUSTERS, strict=True))

#: The family and the scale of each category, by the cluster that it is evidence of.
FAMILIES: dict[str, dict[str, str]] = {
    "delivery": {
        "auth_chain": "auth_spf_dmarc_fail auth_spf_fail auth_dmarc_fail no_auth_results",
        "date_integrity": "future_date stale_date missing_date",
        "header_integrity": "missing_message_id header_injection",
        "received_chain": "no_received excessive_hops",
        "mailer_identity": "suspicious_mailer",
    },
    "social": {
        "credential_theft_intent": "phishing phishing_subject account_security_phishing image_only_phishing targeted_credential_phishing",
        "bec_intent": "bec nlp_bec",
        "financial_fraud_intent": "subsidy_fraud invoice_spam nlp_scam",
        "extortion_intent": "sextortion extortion_threat",
        "bulk_spam_intent": "nlp_spam nonsensical_spam mass_mailing spam_cannon",
        "language_context": "foreign_to_cn_corp japanese_to_cn_corp japanese_unexpected",
        "contact_urgency": "phone_in_subject phone_in_body",
        "language_anomaly": "lang_inconsistency multilingual_gibberish",
        "social_other": "nlp_phishing",
    },
    "business": {
        "banking_identifier": "iban_detected swift_code_detected bank_account_detected",
        "payment_rail": "wire_transfer crypto_wallet",
        "payment_change": "payment_change",
        "financial_urgency": "urgency_financial_combo",
        "financial_density": "multi_financial_entities",
    },
    "link": {
        "targeted_link": "recipient_in_url targeted_credential_phishing",
        "link_impersonation": "at_sign_obfuscation idn_homograph org_domain_mimicry url_typo",
        "link_obfuscation": "dga_random_domain hex_subdomain long_url double_encoding encoded_separator multiple_redirects unusual_port",
        "fragment_obfuscation": "deep_fragment_route suspicious_fragment mobile_redirect",
        "credential_pathing": "suspicious_path suspicious_params",
    },
    "reputation": {
        "redirect_chain": "redirect_target redirect_url",
        "brand_impersonation": "brand_impersonation www_impersonation",
        "domain_shape": "suspicious_tld free_hosting long_domain deep_subdomain random_domain numeric_domain embedded_ip",
    },
    "external": {
        "malicious_intel": "intel_malicious url_intel_malicious",
        "suspicious_intel": "intel_suspicious url_intel_suspicious",
        "blacklist": "blacklisted_domain blacklisted_parent_domain",
        "sender_domain_reputation": "suspicious_sender_domain",
    },
}
SCALES: dict[str, dict[str, float]] = {
    "delivery": {"auth_spf_dmarc_fail": 0.72, "auth_spf_fail": 0.65, "auth_dmarc_fail": 0.65, "no_auth_results": 0.50, "no_received": 0.50, "header_injection": 0.75, "": 0.55},
    "social": {
        "account_security_phishing": 0.88, "phishing": 0.76, "phishing_subject": 0.76, "nlp_phishing": 0.76, "bec": 0.72, "nlp_bec": 0.72,
        "subsidy_fraud": 0.66, "invoice_spam": 0.66, "nlp_scam": 0.66, "sextortion": 0.82, "extortion_threat": 0.82, "gateway_pre_classified": 0.30,
        "foreign_to_cn_corp": 0.42, "japanese_to_cn_corp": 0.42, "japanese_unexpected": 0.42, "nlp_spam": 0.46, "nonsensical_spam": 0.46, "": 0.56,
    },
    "business": {"payment_change": 0.76, "wire_transfer": 0.70, "crypto_wallet": 0.70, "multi_financial_entities": 0.52, "urgency_financial_combo": 0.60, "": 0.62},
    "link": {"targeted_credential_phishing": 0.92, "recipient_in_url": 0.82, "at_sign_obfuscation": 0.82, "idn_homograph": 0.82, "org_domain_mimicry": 0.82, "dga_random_domain": 0.72, "mobile_redirect": 0.60, "": 0.66},
    "reputation": {"brand_impersonation": 0.78, "redirect_target": 0.68, "redirect_url": 0.68, "random_domain": 0.72, "embedded_ip": 0.72, "": 0.62},
    "external": {
        "intel_malicious": 0.86, "url_intel_malicious": 0.86, "blacklisted_domain": 0.82, "blacklisted_parent_domain": 0.82,
        "intel_suspicious": 0.70, "url_intel_suspicious": 0.70, "": 0.64,
    },
}
OTHER = {"delivery": "delivery_other", "social": "social_other", "business": "business_other", "link": "link_content_other", "reputation": "link_reputation_other"}
#: Fixed values: (modules, categories or none for all others, cluster, family, scale); a family given as a group is looked up above.
SIGNALS: tuple[tuple[str, str, str, str, float | None], ...] = (
    ("content_scan", "gateway_pre_classified", "inherited", "gateway_banner", 0.18),
    ("content_scan", "external_impersonation", "identity", "external_impersonation", 0.78),
    ("content_scan", "phishing bec phishing_subject phone_in_subject image_only_phishing account_security_phishing subsidy_fraud invoice_spam phone_in_body lang_inconsistency", "social", "=social", None),
    ("attach_content", "attachment_phishing_url", "link", "attachment_embedded_url", 0.74),
    ("attach_content", "phishing bec", "social", "=social", 0.74),
    ("attach_content", "weak_phishing", "social", "attachment_weak_phishing", 0.42),
    ("attach_scan", "", "payload", "attachment_anomaly", 0.72),
    ("attach_hash", "hash_intel_malicious hash_intel_suspicious", "external", "hash_reputation", 0.82),
    ("attach_hash", "", "payload", "malware_signature", 0.92),
    ("av_eml_scan av_attach_scan sandbox_scan yara_scan", "", "payload", "malware_signature", 0.95),
    ("header_scan", "sender_ip_malicious", "external", "sender_ip_reputation", 0.88),
    ("header_scan", "ioc_ip_hit sender_ip_suspicious", "external", "sender_ip_reputation", 0.72),
    ("header_scan", "domain_mismatch brand_spoof_reply_to envelope_spoofing protected_domain_spoof", "identity", "header_identity", 0.80),
    ("header_scan", " ".join(FAMILIES["delivery"].values()), "delivery", "=delivery", None),
    ("mime_scan", "", "delivery", "mime_integrity", 0.58),
    ("identity_anomaly", "display_name_spoof", "identity", "display_name", 0.82),
    ("identity_anomaly", "reply_chain_anomaly suspicious_client envelope_mismatch", "identity", "mail_client_envelope", 0.64),
    ("identity_anomaly", "first_contact", "identity", "sender_novelty", 0.42),
    ("identity_anomaly", "random_domain random_sender", "identity", "sender_randomness", 0.66),
    ("html_scan html_pixel_art", "", "link", "html_obfuscation", 0.74),
    ("link_scan", "", "link", "link_structure", 0.78),
    ("link_content", " ".join(FAMILIES["link"].values()), "link", "=link", None),
    ("link_content", "", "link", "=link", None),
    ("link_reputation", " ".join(FAMILIES["external"].values()), "external", "=external", None),
    ("link_reputation", " ".join(FAMILIES["reputation"].values()), "link", "=reputation", None),
    ("link_reputation", "", "link", "=reputation", None),
    ("semantic_scan", " ".join([*FAMILIES["social"].values(), "gateway_pre_classified"]), "social", "=social", None),
    ("semantic_scan", "", "social", "=social", None),
    ("anomaly_detect", "no_recipients", "delivery", "recipient_integrity", 0.55),
    ("anomaly_detect", "", "social", "behavioral_pattern", 0.52),
    ("transaction_correlation", " ".join(FAMILIES["business"].values()), "business", "=business", None),
    ("transaction_correlation", "", "business", "=business", None),
)
#: Modules with entries of their own, or none at all; findings of others count only with these categories.
UNMAPPED = ("domain_verify",)
FALLBACK = ("nlp_phishing", "nlp_scam", "nlp_bec", "nlp_spam")


def mapping() -> list[tuple[str, str, str, str, float]]:
    """(module, category, cluster, family, scale) of every rule; an empty category stands for all others, an empty module for modules without rules."""
    of = {g: {c: family for family, names in families.items() for c in names.split()} for g, families in FAMILIES.items()}
    out: dict[tuple[str, str], tuple[str, str, float]] = {}
    for modules, categories, cluster, family, scale in SIGNALS:
        for m, c in product(modules.split(), categories.split() or [""]):
            g = family[1:] if family.startswith("=") else None
            name = of[g].get(c, OTHER.get(g, "")) if g else family
            out.setdefault((m, c), (SHORT[cluster], name, scale if scale is not None else SCALES[g].get(c, SCALES[g][""])))
    for c in FALLBACK:
        out["", c] = (SHORT["social"], of["social"][c], SCALES["social"].get(c, SCALES["social"][""]))
    return [(*k, *v) for k, v in out.items()]


def signals(results: DataFrame) -> DataFrame:
    """One row (session_id, cluster, family, module, score, weight, confidence) for each category of a finding that counts as evidence."""
    spark: SparkSession = results.sparkSession
    rules = spark.createDataFrame(mapping(), "rm string, rc string, cluster string, family string, scale double")
    own = [*sorted({m for ms, *_ in SIGNALS for m in ms.split()}), *UNMAPPED]
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    each = results.filter("rank > 0").select(
        "session_id", "module", F.explode("categories").alias("category"), unit(F.col("score") * F.col("weight")).alias("score"), unit(F.col("confidence")).alias("confidence")
    )
    rm = F.when(F.col("module").isin(own), F.col("module")).otherwise("")
    exact = F.broadcast(rules.filter("rc <> ''"))  # the rules are a fixed table
    rest = F.broadcast(rules.filter("rc = ''").select(F.col("rm").alias("rm2"), *(F.col(c).alias(f"{c}2") for c in ("cluster", "family", "scale"))))
    met = each.withColumn("m", rm).join(exact, (F.col("m") == F.col("rm")) & (F.col("category") == F.col("rc")), "left").join(rest, F.col("m") == F.col("rm2"), "left")
    picked = {c: F.coalesce(c, f"{c}2") for c in ("cluster", "family", "scale")}
    return met.select("session_id", picked["cluster"].alias("cluster"), picked["family"].alias("family"), "module", "score", picked["scale"].alias("weight"), "confidence").filter("cluster is not null")


#: Flag -> the categories any of which sets it.
FLAG_CATEGORIES: dict[str, tuple[str, ...]] = {
    "payment_change_signal": ("payment_change", "wire_transfer", "bank_account_detected", "iban_detected", "swift_code_detected", "crypto_wallet"),
    "account_security_signal": ("account_security_phishing", "targeted_credential_phishing"),
    "credential_link_signal": ("suspicious_params", "recipient_in_url", "at_sign_obfuscation", "targeted_credential_phishing", "attachment_phishing_url", "redirect_target", "redirect_url", "href_text_mismatch"),
    "malicious_ioc_signal": ("ioc_ip_hit", "sender_ip_malicious", "intel_malicious", "url_intel_malicious", "hash_intel_malicious"),
    "header_spoof_signal": ("brand_spoof_reply_to", "protected_domain_spoof", "envelope_spoofing", "display_name_spoof", "external_impersonation", "domain_mismatch"),
    "subsidy_fraud_signal": ("subsidy_fraud",),
    "invoice_spam_signal": ("invoice_spam",),
    "crypto_wallet_signal": ("crypto_wallet", "ransomware_indicator"),
    "structural_threat_signal": ("dga_random_domain", "external_impersonation", "domain_mismatch", "suspicious_tld", "lang_inconsistency", "type_mismatch", "idn_homograph", "mixed_script_domain", "attachment_phishing_url"),
    "cross_locale_lure": ("japanese_to_cn_corp", "foreign_to_cn_corp", "japanese_unexpected", "multilingual_gibberish"),
}
ATTACHMENT_CATEGORIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "attachment_phishing_signal": ("attach_content", ("phishing", "bec", "weak_phishing", "attachment_phishing_url")),
    "attachment_sensitive_data_signal": ("attach_content", ("dlp_credit_card", "dlp_id_number")),
    "encrypted_attachment_signal": ("attach_scan", ("encrypted_attachment", "encrypted_archive", "encrypted_pdf")),
}
NLP_ECHO = ("nlp_phishing", "nlp_scam", "nlp_bec", "nlp_spam", "nonsensical_spam")
SEMANTIC_ONLY = (*NLP_ECHO, "foreign_to_cn_corp", "japanese_to_cn_corp", "japanese_unexpected")
SYSTEM_SENDERS = ("mailer-daemon", "postmaster", "mail delivery system")
#: Threat rank from which an attachment's content counts as high.
HIGH_RANK = 3
ALIGNED = 0.55
FLAGS = (
    "gateway_banner_polluted", "notice_banner_polluted", "dsn_like_system_mail", "auto_reply_like", "semantic_nlp_only_signal",
    "transcript_like_structure", "sender_alignment_verified", *FLAG_CATEGORIES, *ATTACHMENT_CATEGORIES, "high_risk_attachment_content",
)


def transcript_like(body: Column) -> Column:
    """Whether a text is laid out as a chat: short lines, with speakers or times of day."""
    lines = F.filter(F.transform(F.split(body, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")

    def shape(x: Column) -> Column:
        count = lambda f: F.size(F.filter(x, f))
        speaker = lambda s: s.rlike("^[^:\\uFF1A]{1,24}[:\\uFF1A] *[^ ].{0,119}$") & ~s.rlike("^[0-9 ]*[:\\uFF1A]")
        turns, times = count(speaker), count(lambda s: s.rlike("[0-9]{2}:[0-9]{2}"))
        return (F.size(x) >= 4) & (2 * count(lambda s: F.length(s) <= 48) >= F.size(x)) & ((turns >= 2) | (times >= 2))

    return F.transform(F.array(lines), shape)[0]


def scenario_flags(sessions: DataFrame, results: DataFrame, patterns: dict[str, Sequence[str]]) -> DataFrame:
    """(session_id, alignment, flags): what kind of mail a session is.

    sessions: (session_id, subject, body, sender, auto_submitted, alignment).
    patterns: lower-case phrases under gateway_banner, notice_banner, dsn and
    auto_reply, as an administrator keeps them.
    """
    had = lambda m: F.collect_set(F.when(F.col("module") == m, F.col("category")))
    flagged = results.filter("rank > 0")
    each = flagged.select("session_id", "module", "rank", F.explode_outer("categories").alias("category"))
    per = each.groupBy("session_id").agg(
        F.collect_set("category").alias("categories"), had("attach_content").alias("attach_content"), had("attach_scan").alias("attach_scan"),
        F.max(F.when(F.col("module") == "attach_content", F.col("rank"))).alias("content_rank"), F.bool_and(F.col("module") == "semantic_scan").alias("semantic"),
    )
    none = F.array().cast("array<string>")
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "body", "sender")}
    rows = sessions.join(per, "session_id", "left").select(
        "session_id", "auto_submitted", *(v.alias(c) for c, v in low.items()),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("alignment", F.lit(0.0)))).alias("alignment"), "content_rank", F.coalesce("semantic", F.lit(False)).alias("semantic"),
        *(F.coalesce(c, none).alias(c) for c in ("categories", "attach_content", "attach_scan")),
    )
    overlaps = lambda c, names: F.arrays_overlap(c, F.array(*map(F.lit, names)))

    def mentions(names: Sequence[str], *columns: str) -> Column:
        out = F.lit(False)
        for column, name in product(columns, names):
            out |= F.col(column).contains(name)
        return out

    automatic = F.coalesce("auto_submitted", F.lit(False))
    rows = rows.withColumns({
        "gateway_banner_polluted": F.array_contains("categories", "gateway_pre_classified") & mentions(patterns["gateway_banner"], "subject", "body"),
        "notice_banner_polluted": overlaps("categories", NLP_ECHO) & mentions(patterns["notice_banner"], "subject", "body"),
        "dsn_like_system_mail": automatic | mentions(SYSTEM_SENDERS, "sender") | mentions(patterns["dsn"], "subject"),
        "auto_reply_like": automatic | mentions(patterns["auto_reply"], "subject"),
        "semantic_nlp_only_signal": F.col("semantic") & (F.size(F.array_except("categories", F.array(*map(F.lit, SEMANTIC_ONLY)))) == 0),
        "sender_alignment_verified": F.col("alignment") >= ALIGNED,
        **{flag: overlaps("categories", names) for flag, names in FLAG_CATEGORIES.items()},
        **{flag: overlaps(module, names) for flag, (module, names) in ATTACHMENT_CATEGORIES.items()},
        "high_risk_attachment_content": F.coalesce(F.col("content_rank") >= HIGH_RANK, F.lit(False)),
    })
    rows = rows.withColumn("transcript_like_structure", F.col("semantic_nlp_only_signal") & transcript_like(F.col("body")))
    return rows.select("session_id", "alignment", *FLAGS)


#: Names of conditions, over the scores and flags of one session.
TERMS = {
    "strong_identity": "identity >= 0.55", "strong_link": "link >= 0.55", "strong_payload": "payload >= 0.55", "strong_external": "external >= 0.65",
    "corroborated": "(payload >= 0.45 OR link >= 0.45 OR identity >= 0.55 OR external >= 0.65 OR (identity >= 0.10 AND link >= 0.08 AND external >= 0.12) OR (social >= 0.55 AND (link >= 0.10 OR external >= 0.25 OR identity >= 0.35)))",
    "independent": "(account_security_signal OR credential_link_signal OR malicious_ioc_signal OR header_spoof_signal OR payment_change_signal OR subsidy_fraud_signal OR invoice_spam_signal OR crypto_wallet_signal OR attachment_phishing_signal OR high_risk_attachment_content OR encrypted_attachment_signal OR payload >= 0.45 OR external >= 0.35 OR identity >= 0.45)",
    "fraud_mail": "(subsidy_fraud_signal OR invoice_spam_signal)",
    "technical_signal": "(account_security_signal OR credential_link_signal OR malicious_ioc_signal)",
    "bad_link": "(credential_link_signal AND malicious_ioc_signal)",
    "machine_mail": "(dsn_like_system_mail OR auto_reply_like)",
    "credential_phish": "(identity >= 0.10 AND link >= 0.08 AND external >= 0.12 AND credential_link_signal AND malicious_ioc_signal)",
    "payment_redirect": "(payment_change_signal AND credential_link_signal AND (malicious_ioc_signal OR structural_threat_signal))",
    "semantic_alone": "(social > 0 AND identity < 0.20 AND link < 0.20 AND payload < 0.20 AND external < 0.20 AND business < 0.20 AND inherited < 0.20 AND delivery < 0.20)",
}
#: Fixed values: (condition over the scores before scaling, cluster -> factor).
SCALINGS: tuple[tuple[str, dict[str, str]], ...] = (
    ("alignment > 0 AND NOT {corroborated}", {"delivery": "1 - 0.50 * alignment"}),
    ("alignment > 0 AND NOT {corroborated} AND NOT {strong_identity}", {"identity": "1 - 0.22 * alignment"}),
    ("gateway_banner_polluted", {"inherited": "0.35"}),
    ("gateway_banner_polluted AND NOT ({strong_identity} OR {strong_link} OR {strong_payload})", {"social": "CASE WHEN {independent} THEN 0.88 WHEN structural_threat_signal THEN 0.52 ELSE 0.40 END"}),
    ("gateway_banner_polluted AND NOT {independent} AND link < 0.45 AND payload < 0.45", {"link": "0.72", "business": "0.78"}),
    ("notice_banner_polluted AND NOT ({strong_identity} OR {strong_link} OR {strong_payload} OR {strong_external})", {"social": "0.28", "inherited": "0.25"}),
    ("dsn_like_system_mail AND payload < 0.45 AND link < 0.45", {"delivery": "0.40", "identity": "0.55"}),
    ("dsn_like_system_mail AND payload < 0.45 AND link < 0.45 AND NOT {strong_external}", {"social": "0.45"}),
    ("auto_reply_like AND payload < 0.45 AND link < 0.45 AND external < 0.45", {"social": "0.35", "identity": "0.60"}),
    ("semantic_nlp_only_signal AND NOT {technical_signal} AND link < 0.20 AND payload < 0.20 AND identity < 0.25 AND external < 0.25", {"social": "0.58"}),
    ("NOT ({strong_link} OR {strong_payload} OR {strong_identity} OR {strong_external}) AND social < 0.45", {"inherited": "0.80", "business": "0.85"}),
)
#: Fixed values: (condition over the scaled scores, least risk).
FLOORS: tuple[tuple[str, str], ...] = (
    ("payload >= 0.75", "LEAST(payload, 0.90)"),
    ("identity >= 0.40 AND link >= 0.45", "GREATEST((identity + link) / 2, 0.65)"),
    ("payload >= 0.45 AND external >= 0.45", "0.70"),
    ("social >= 0.55 AND link >= 0.10 AND external >= 0.20 AND account_security_signal AND {bad_link}", "0.68"),
    ("social >= 0.30 AND link >= 0.08 AND external >= 0.12 AND {bad_link}", "CASE WHEN account_security_signal THEN 0.68 ELSE 0.56 END"),
    ("{credential_phish}", "CASE WHEN account_security_signal THEN 0.68 ELSE 0.48 END"),
    ("account_security_signal AND credential_link_signal AND social >= 0.24 AND link >= 0.08", "CASE WHEN identity >= 0.15 OR external >= 0.15 OR structural_threat_signal THEN 0.56 ELSE 0.48 END"),
    ("identity >= 0.35 AND social >= 0.40 AND business >= 0.35 AND payment_change_signal", "0.60"),
    ("account_security_signal AND payment_change_signal AND cross_locale_lure AND social >= 0.18", "0.68"),
    ("social >= 0.40 AND link >= 0.28 AND external >= 0.35 AND {bad_link}", "CASE WHEN account_security_signal THEN 0.78 ELSE 0.70 END"),
    ("subsidy_fraud_signal", "CASE WHEN link >= 0.20 AND (structural_threat_signal OR credential_link_signal OR external >= 0.20) THEN 0.74 ELSE 0.48 END"),
    ("invoice_spam_signal", "CASE WHEN link >= 0.15 OR identity >= 0.20 OR external >= 0.20 THEN 0.56 ELSE 0.48 END"),
    ("attachment_phishing_signal AND payload >= 0.24 AND (link >= 0.16 OR high_risk_attachment_content) AND NOT {machine_mail}", "CASE WHEN high_risk_attachment_content OR payload >= 0.40 THEN 0.68 ELSE 0.56 END"),
    ("{payment_redirect} AND (external >= 0.20 OR link >= 0.18) AND (link >= 0.18 OR social >= 0.20 OR business >= 0.18)", "0.72"),
    ("high_risk_attachment_content AND attachment_phishing_signal AND attachment_sensitive_data_signal", "0.68"),
    ("crypto_wallet_signal AND business >= 0.24", "CASE WHEN social >= 0.30 OR external >= 0.20 OR payload >= 0.25 THEN 0.64 ELSE 0.40 END"),
    ("header_spoof_signal AND identity >= 0.35 AND business >= 0.18 AND NOT {machine_mail}", "CASE WHEN payment_change_signal THEN 0.62 ELSE 0.44 END"),
    ("encrypted_attachment_signal AND payload >= 0.12 AND (social >= 0.28 OR identity >= 0.30 OR link >= 0.16 OR external >= 0.18) AND NOT {machine_mail}", "0.56"),
)
#: Fixed values: (condition over the scaled scores, greatest risk); caps come after every floor and breaker.
CAPS: tuple[tuple[str, str], ...] = (
    ("inherited > 0 AND link < 0.30 AND payload < 0.30 AND external < 0.40 AND identity < 0.35 AND social < 0.40 AND NOT ({credential_phish} OR {payment_redirect} OR {fraud_mail})", "0.35"),
    ("external > 0 AND identity < 0.25 AND link < 0.30 AND payload < 0.30 AND social < 0.30 AND NOT ({credential_phish} OR {payment_redirect})", "0.55"),
    ("gateway_banner_polluted AND link < 0.45 AND payload < 0.45 AND identity < 0.45 AND external < 0.35 AND NOT ({independent} OR {fraud_mail})", "0.35"),
    ("gateway_banner_polluted AND inherited > 0 AND social < 0.08 AND identity < 0.20 AND link < 0.20 AND payload < 0.20 AND external < 0.20 AND business < 0.20 AND delivery < 0.20 AND NOT ({independent} OR {fraud_mail})", "0.12"),
    ("semantic_nlp_only_signal AND {semantic_alone} AND NOT {technical_signal}", "0.14"),
    ("(notice_banner_polluted OR {machine_mail}) AND social > 0 AND identity < 0.25 AND link < 0.25 AND payload < 0.25 AND external < 0.25 AND NOT ({technical_signal} OR {fraud_mail})", "0.12"),
    ("dsn_like_system_mail AND payload < 0.45 AND link < 0.45 AND external < 0.55 AND NOT {fraud_mail}", "GREATEST(0.30, delivery)"),
    ("dsn_like_system_mail AND identity > 0 AND social < 0.20 AND link < 0.20 AND payload < 0.20 AND external < 0.20 AND business < 0.20 AND NOT {fraud_mail}", "0.12"),
)


def spelled(rule: str) -> str:
    """A rule with the conditions that it names written out."""
    return rule.format(**{k: f"({v})" for k, v in TERMS.items()})


def _wide(per: DataFrame) -> DataFrame:
    """One row per session, the score of each cluster in the column of its short name, 0 where there is none."""
    scores = (F.coalesce(F.max(F.when(F.col("cluster") == c, F.col("score"))), F.lit(0.0)).alias(short) for short, c in SHORT.items())
    return per.groupBy("session_id").agg(*scores)


def scaled_clusters(per: DataFrame, flags: DataFrame) -> DataFrame:
    """(session_id, cluster, score, confidence) with the scores scaled by the scenario, within each cluster's cap."""
    row = _wide(per).join(flags, "session_id")
    factors = {short: [] for short in SHORT}
    for condition, changed in SCALINGS:
        for short, factor in changed.items():
            factors[short].append(f"CASE WHEN {spelled(condition)} THEN {spelled(factor)} ELSE 1 END")
    of = F.create_map(*(x for short, c in SHORT.items() for x in (F.lit(c), F.expr(" * ".join(["CAST(1 AS DOUBLE)", *factors[short]])))))
    cap = F.create_map(*(F.lit(x) for c, values in CLUSTERS.items() for x in (c, values[0])))
    both = per.join(row.select("session_id", of.alias("factor")), "session_id")
    score = F.greatest(F.lit(0.0), F.least(F.col("score") * F.col("factor")[F.col("cluster")], cap[F.col("cluster")]))
    return both.select("session_id", "cluster", score.alias("score"), "confidence")


def scaled(sessions: DataFrame, results: DataFrame, patterns: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """The scaled clusters and the flags of sessions; each is made once and kept in the shared folder, since several steps read it."""
    flags = written(scenario_flags(sessions, results, patterns), "flags")
    return written(scaled_clusters(written(clusters(signals(results)), "clusters"), flags), "scaled"), flags


def floors_and_caps(fused: DataFrame, per: DataFrame, flags: DataFrame) -> DataFrame:
    """(session_id, floor, cap, risk): fused (session_id, risk) after the floors and then the caps of its scenario.

    per holds the scaled clusters. fused has the breakers in it, which are floors too.
    """
    row = fused.join(_wide(per), "session_id").join(flags, "session_id")
    pick = lambda rules, join, end: F.expr(f"{join}({end}, " + ", ".join(f"CASE WHEN {spelled(c)} THEN CAST({v} AS DOUBLE) ELSE {end} END" for c, v in rules) + ")")
    row = row.withColumn("floor", pick(FLOORS, "GREATEST", "CAST(0 AS DOUBLE)")).withColumn("cap", pick(CAPS, "LEAST", "CAST(1 AS DOUBLE)"))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(0.99), "cap", F.greatest("risk", "floor")))
    return row.select("session_id", "floor", "cap", risk.alias("risk"))


def clustered_verdict(sessions: DataFrame, results: DataFrame, patterns: dict[str, Sequence[str]]) -> DataFrame:
    """(session_id, risk, confidence, n_clusters): the default verdict of every session with findings.

    Sessions without evidence, or with too little after scaling, are safe: risk 0, confidence 1.
    """
    per, flags = scaled(sessions, results, patterns)
    fused = cluster_verdict(per)
    final = floors_and_caps(fused.select("session_id", "risk"), per, flags).select("session_id", "risk")
    known = results.select("session_id").distinct()
    rows = known.join(fused.drop("risk"), "session_id", "left").join(final, "session_id", "left")
    return rows.select("session_id", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("n_clusters", F.lit(0)).cast("long").alias("n_clusters"))
