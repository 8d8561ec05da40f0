"""The default verdict on sessions made for one rule each."""

import pytest

from courierlens.operators import scenarios as sc
from courierlens.operators import verdicts
from courierlens.plans.fusion import engine_lists

PATTERNS = {"gateway_banner": ["[spam]"], "notice_banner": ["external mail"], "dsn": ["undeliverable"], "auto_reply": ["automatic reply"]}


def verdict(spark, findings, subject="Hello", sender="a@b.example", auto=False, alignment=None, body=""):
    mail = spark.createDataFrame([(1, subject, body, sender, auto, alignment)], "session_id long, subject string, body string, sender string, auto_submitted boolean, alignment double")
    rows = spark.createDataFrame([(1, m, r, s, 1.0, c, cs) for m, r, s, c, cs in findings], "session_id long, module string, rank int, score double, weight double, confidence double, categories array<string>")
    (got,) = sc.clustered_verdict(mail, rows, PATTERNS).collect()
    return got


@pytest.mark.parametrize(
    ("findings", "mail", "low", "high"),
    [
        ([("header_scan", 0, 0.0, 1.0, [])], {}, 0.0, 0.0),
        ([("yara_scan", 4, 1.0, 0.95, ["rule"])], {}, 0.90, 0.99),
        ([("domain_verify", 4, 1.0, 0.95, ["aligned"])], {}, 0.0, 0.0),
        ([("semantic_scan", 3, 0.9, 0.9, ["nlp_phishing"])], {}, 0.0, 0.14),
        ([("content_scan", 2, 0.5, 0.7, ["subsidy_fraud"])], {}, 0.48, 0.99),
        ([("content_scan", 2, 0.5, 0.7, ["dlp_credit_card"])], {}, 0.0, 0.0),
        ([("identity_anomaly", 2, 0.6, 0.8, ["first_contact"])], {"subject": "Undeliverable: x"}, 0.0, 0.12),
        ([("identity_anomaly", 3, 0.9, 0.9, ["display_name_spoof"])], {}, 0.55, 0.99),
        ([("header_scan", 3, 0.6, 0.8, ["ioc_ip_hit"])], {}, 0.0, 0.55),
        (
            [("header_scan", 2, 0.4, 0.6, ["auth_spf_fail"]), ("link_scan", 2, 0.45, 0.6, ["href_text_mismatch"]), ("transaction_correlation", 2, 0.4, 0.6, ["iban_detected"]), ("content_scan", 2, 0.6, 0.6, ["phone_in_body"])],
            {},
            0.449,
            0.99,
        ),
        (
            [("semantic_scan", 3, 0.9, 0.9, ["nlp_spam"]), ("content_scan", 2, 0.9, 0.9, ["gateway_pre_classified"])],
            {"subject": "[SPAM] offer"},
            0.0,
            0.35,
        ),
        (
            [("header_scan", 3, 0.6, 0.8, ["ioc_ip_hit"]), ("link_content", 2, 0.5, 0.7, ["suspicious_params"]), ("identity_anomaly", 2, 0.5, 0.7, ["first_contact"])],
            {},
            0.48,
            0.99,
        ),
    ],
)
def test_rules(spark, findings, mail, low, high):
    assert low <= verdict(spark, findings, **mail).risk <= high


def test_chat_logs_are_no_threat(spark):
    chat = "Ann: are you there\nBob: yes\n10:15 see you\nbye"
    mail = spark.createDataFrame([(1, None, chat, None, None, 0.7), (2, None, None, None, None, None)], "session_id long, subject string, body string, sender string, auto_submitted boolean, alignment double")
    rows = spark.createDataFrame([(1, "semantic_scan", 2, 0.9, 1.0, 0.9, ["nlp_scam"])], "session_id long, module string, rank int, score double, weight double, confidence double, categories array<string>")
    flags = {r.session_id: r for r in sc.scenario_flags(mail, rows, PATTERNS).collect()}
    assert flags[1].transcript_like_structure and flags[1].semantic_nlp_only_signal and flags[1].sender_alignment_verified
    assert not any(flags[2][f] for f in sc.FLAGS)
    assert sc.clustered_verdict(mail, rows, PATTERNS).first().risk <= 0.14


def test_every_rule_has_a_place():
    rules = sc.mapping()
    assert len({r[:2] for r in rules}) == len(rules)
    assert ("semantic_scan", "", "social_engineering_intent", "social_other", 0.56) in rules
    assert ("link_reputation", "intel_malicious", "external_reputation_ioc", "malicious_intel", 0.86) in rules
    assert all("{" not in sc.spelled(c) for c, _ in (*sc.FLOORS, *sc.CAPS, *sc.SCALINGS))


def test_engines_and_sessions_share_a_shuffle(spark):
    found = spark.createDataFrame([(1, 1, 1, 1, 0.5, 0.5)], "session_id long, module_n int, part_n long, supp_n long, score double, confidence double")
    assert engine_lists(found)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_findings_are_grouped_once_for_a_verdict(spark):
    mail = spark.createDataFrame([(1, "", "", "", False, 0.5)], "session_id long, subject string, body string, sender string, auto_submitted boolean, alignment double")
    found = spark.createDataFrame([(1, "link_scan", ["href_text_mismatch"], 3, 0.9, 1.0, 0.9)], "session_id long, module string, categories array<string>, rank int, score double, weight double, confidence double")
    per, flags = sc.scaled(mail, found, PATTERNS)
    plan = sc.floors_and_caps(verdicts.cluster_verdict(per).select("session_id", "risk"), per, flags)._jdf.queryExecution().optimizedPlan().toString()
    assert "family" not in plan and "categories" not in plan
