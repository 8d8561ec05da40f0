"""Message checks and special indicators: expected rows written by hand."""

from datetime import datetime, timedelta

from courierlens.operators import signals
from courierlens.operators.relational import PRIVATE

AT = datetime(2024, 5, 6, 12)
SCHEMA = (
    "message_id long, sent_at timestamp, received_at timestamp, sent_offset int, subject string, from_header string, envelope_from string, reply_to string, display_name string, recipients array<string>, "
    "in_reply_to string, auth_results string, n_received int, id_header string, content_type string, attachments array<struct<name:string,declared:string,detected:string,size:bigint>>"
)
CLEAN = {
    "sent_at": AT, "received_at": AT, "sent_offset": 0, "subject": "hello there", "from_header": "ann@firm.example", "envelope_from": "<ann@firm.example>", "reply_to": None, "display_name": "Ann", "recipients": ["a@b.example"],
    "in_reply_to": None, "auth_results": "spf=pass", "n_received": 2, "id_header": "<1@x>", "content_type": "text/plain", "attachments": None,
}


def sender(address):
    return {"from_header": address, "envelope_from": address}


def file(name, size=10):
    return {"attachments": [(name, "text", "text", size)]}


CASES = [
    ({}, []), ({"recipients": ["r@x.example"] * 60}, ["mass_mailing", "spam_cannon"]), ({"recipients": ["r@x.example"] * 50, "n_received": 0}, ["mass_mailing", "no_received"]), ({"recipients": None}, ["no_recipients"]),
    ({"n_received": 12}, []), ({"n_received": 15}, []), ({"n_received": 16}, ["excessive_hops"]),
    ({"subject": "GOAIDC资产管理通知"}, []), ({"subject": "KYC审核通知"}, []), ({"subject": "URGENT ACTION REQUIRED NOW PLEASE"}, ["all_caps_subject"]), ({"subject": "IMG_7619.HEIC"}, []), ({"subject": "ABCDE"}, ["all_caps_subject"]), ({"subject": "ABCDE12345678"}, []),
    ({"subject": "Hi привет 你好"}, ["multilingual_gibberish"]), ({"subject": "привет こんにちは hi"}, []),
    ({"subject": " "}, ["empty_subject"]), ({"subject": "", **file("a.txt")}, []), ({"subject": "", **file("a.exe")}, ["dangerous_extension", "empty_subject_with_attachment"]), ({"subject": "", "attachments": [("a.txt", "t", "t", 1), ("b.txt", "t", "t", 1)]}, ["empty_subject_with_attachment"]),
    ({"sent_at": AT - timedelta(hours=9)}, []), ({"sent_at": AT - timedelta(hours=9), "subject": "please VERIFY"}, ["off_hours_send"]), ({"sent_at": AT - timedelta(hours=9), **file("a.pdf")}, ["off_hours_send"]),
    ({"sent_at": AT - timedelta(hours=9), "sent_offset": 120, "subject": "urgent"}, []), ({"sent_offset": -480, "subject": "urgent"}, ["off_hours_send"]), ({"sent_at": None, "subject": "urgent", "received_at": AT - timedelta(hours=9)}, ["missing_date"]),
    ({"sent_at": AT - timedelta(days=7, seconds=1)}, []), ({"sent_at": AT - timedelta(days=8)}, ["stale_date"]), ({"sent_at": AT + timedelta(hours=1)}, []), ({"sent_at": AT + timedelta(hours=1, seconds=1)}, ["future_date"]),
    (sender("info@bncgj.com"), ["random_domain"]), (sender("info@hzbankwealth.com"), []), (sender("info@8t5om.com"), ["random_domain"]), (sender("info@2fkje0.com"), ["random_domain"]), (sender("info@163.com"), []), (sender("info@safe.snajgc.org"), []), (sender("info@snajgc.known.example"), []),
    (sender("pvzpfvq@hleg.com"), ["random_sender"]), (sender("pvzp7vq@hleg.com"), []), (sender("Ktipfnl@udcoraqhs.com"), ["random_sender"]), (sender("strng@hleg.com"), []), (sender("anna@hleg.com"), []), (sender("pvzpfvq@known.example"), []), (sender("u12345678@hleg.com"), []),
    ({"auth_results": "spf=FAIL dmarc=fail"}, ["auth_spf_dmarc_fail"]), ({"auth_results": None}, ["no_auth_results"]), ({"reply_to": "x@other.example"}, ["domain_mismatch"]), ({"subject": "Re: hello"}, ["reply_chain_anomaly"]), ({"subject": "Re: hello", "in_reply_to": "<2@x>"}, []),
    ({"display_name": "boss@bank.example"}, ["display_name_spoof"]), ({"envelope_from": "<x@other.example>"}, ["envelope_mismatch"]), ({"id_header": None, "content_type": ""}, ["empty_content_type", "missing_message_id"]), (file("Invoice.pdf.JS", 0), ["dangerous_extension", "double_extension", "zero_byte"]),
]


def test_checks_by_hand(spark):
    rows = [(i, *(CLEAN | case).values()) for i, (case, _) in enumerate(CASES)]
    found = {}
    for r in signals.message_findings(spark.createDataFrame(rows, SCHEMA), known_domains=("known.example",), known_names=("strng",)).collect():
        found.setdefault(r.message_id, []).append(r.category)
    assert {i: sorted(found.get(i, [])) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_special_indicators_by_hand(spark):
    schema = "session_id long, mail_from string, recipients array<string>, origin_ip string, rank int, nonsense_rank int, nonsense_confidence double"
    rows = [
        (1, "Boss@Ours.example", ["me@ours.example"], "10.0.0.1", 4, 1, 0.0), (2, "it@ours.example", ["me@ours.example"], "8.8.1.1", 4, 1, 0.0), (3, "it@ours.example", ["me@else.example"], "8.8.1.2", 4, 1, 0.0), (4, "it@ours.example", ["me@ours.example"], "8.8.1.3", 3, 1, 0.0),
        (5, "a@0urs.example", [], "8.8.2.1", 2, 1, 0.0), (6, "b@ours.test", [], None, 2, 1, 0.0), (7, "c@passed.example", [], "8.8.2.2", 2, 1, 0.0), (8, "d@odd.example", [], "8.8.3.1", 2, 4, 0.75), (9, "e@odd.example", [], "8.8.3.2", 2, 4, 0.65),
    ]
    ours = spark.createDataFrame([("ours.example",)], "domain string")
    alike = spark.createDataFrame([("0urs.example", 0.45), ("ours.test", 0.35), ("passed.example", 0.45)], "domain string, score double")
    allowed = spark.createDataFrame([("domain", "passed.example"), ("email", "d@odd.example")], "ioc_type string, indicator string")
    found = {(r.attack, r.ioc_type, r.indicator): (round(r.confidence, 9), r.hits) for r in signals.special_iocs(spark.createDataFrame(rows, schema), ours, alike, allowed, PRIVATE).collect()}
    assert found == {
        ("spoofing", "domain", "ours.example"): (0.6, 2), ("spoofing", "email", "boss@ours.example"): (0.6, 1), ("spoofing", "email", "it@ours.example"): (0.6, 1), ("spoofing", "ip", "8.8.1.1"): (0.6, 1),
        ("domain_impersonation", "domain", "0urs.example"): (0.8, 1), ("domain_impersonation", "email", "a@0urs.example"): (0.8, 1), ("domain_impersonation", "ip", "8.8.2.1"): (0.64, 1),
        ("domain_impersonation", "domain", "ours.test"): (0.7, 1), ("domain_impersonation", "email", "b@ours.test"): (0.7, 1), ("nonsensical_spam", "domain", "odd.example"): (0.75, 1), ("nonsensical_spam", "ip", "8.8.3.1"): (0.75, 1),
    }
