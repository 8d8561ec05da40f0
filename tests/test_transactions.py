"""Payment signals: expected rows written by hand."""

from courierlens.operators import transactions

CASES = [
    ("Please pay to DE89370400440532013000", ["iban_detected"], 0.15), ("Reference: XX99ABCD12345678", [], 0.0), ("IBAN us12 3456 7890 1234", [], 0.0), ("GB29 NWBK 6016 1331 9268 19", ["iban_detected"], 0.15),
    ("SWIFT: DEUTDEFF500", ["swift_code_detected"], 0.15), ("swift reply", [], 0.0), ("account: 12345678", ["bank_account_detected"], 0.15), ("costs $ 12.50", [], 0.10), ("12 dollars", [], 0.10), ("invoice INV-12", [], 0.075),
    ("Invoice 12345 over 100 euros, please use a bank transfer", ["wire_transfer", "multi_financial_entities"], 0.14), ("Invoice 12345 over 100 euros, new details: bank transfer", ["wire_transfer", "payment_change", "multi_financial_entities"], 0.875),
    ("0x" + "ab" * 20, [], 0.0), ("wallet 0x" + "ab" * 20, ["crypto_wallet"], 0.35), ("usdt T" + "x" * 33 + " T" + "y" * 33, ["crypto_wallet", "multi_financial_entities"], 0.55), ("monero 4A" + "z" * 93, ["crypto_wallet", "ransomware_indicator"], 0.45),
    ("wallet 0x" + "ab" * 20 + " now", ["crypto_wallet", "urgency_financial_combo"], 0.60), ("pay now", [], 0.0), (None, [], 0.0), ("", [], 0.0),
]


def test_entities_by_hand(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    found = {r.doc_id: (r.categories, round(r.score, 9)) for r in transactions.financial_entities(rows, ("new details",), (" now",)).collect()}
    assert found == {i: (categories, score) for i, (_, categories, score) in enumerate(CASES)}
