"""Payment signals of a text: accounts, amounts, references, wallets, and words that change or press a payment.

A text is cut once into its runs of letters and digits, and each kind of wallet
is a test of such runs; wallets count only in a text that speaks of coins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.operators.dlp import IBAN_LENGTHS

_BASE58 = "[1-9A-HJ-NP-Za-km-z]"
LEAD, END = "(?:^|[^0-9A-Za-z_])", "(?:[^0-9A-Za-z_]|$)"
#: What each kind looks like; an IBAN may be written in groups of four.
IBAN = f"(?i){LEAD}([A-Z]{{2}}[0-9]{{2}}\\s?[0-9A-Z]{{4}}\\s?(?:[0-9A-Z]{{4}}\\s?){{1,7}}[0-9A-Z]{{1,4}}){END}"
SWIFT = f"(?i){LEAD}(?:SWIFT|BIC)[:\\s]*[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{END}"
ACCOUNT = "(?i)((?:account|acct|a/c|routing|sort[\\s-]?code)[:\\s#]*[0-9][0-9\\s-]{4,18}[0-9])"
AMOUNT = f"(?i)(?:[$€£¥₹]|USD|EUR|GBP|CNY|RMB)\\s*[0-9,]+|[0-9][0-9,]*(?:[.][0-9]{{1,2}})?\\s*(?:dollars?|euros?|pounds?|yuan|rmb){END}"
INVOICE = f"(?i)((?:invoice|inv|purchase[\\s-]?order|po|receipt)[\\s#:-]*[A-Z0-9]{{3,20}}){END}"
WIRE = f"(?i){LEAD}(?:wire[\\s-]?transfer|bank[\\s-]?transfer|remittance|beneficiary|intermediary[\\s-]?bank){END}"
#: Wallets by kind, as (pattern of the whole run, score).
WALLETS = {
    "btc": (f"[13]{_BASE58}{{25,34}}|bc1[a-zA-HJ-NP-Z0-9]{{25,62}}", 0.40), "eth": ("0x[0-9a-fA-F]{40}", 0.35), "tron": (f"T{_BASE58}{{33}}", 0.40),
    "sol": (f"{_BASE58}{{43,44}}", 0.30), "xmr": (f"4[0-9AB]{_BASE58}{{93}}", 0.45), "ltc": (f"[LM]{_BASE58}{{25,34}}|ltc1[a-z0-9]{{25,62}}", 0.30),
}
#: Words of a text that speaks of coins.
COINS = (
    "bitcoin", "btc", "wallet", "crypto", "cryptocurrency", "ethereum", "blockchain", "usdt", "usdc", "tether", "trc20", "trc-20", "erc20", "erc-20", "bep20", "bep-20", "tron", "binance", "bnb", "polygon", "matic", "solana", "phantom",
    "metamask", "trustwallet", "trust wallet", "monero", "xmr", "litecoin", "ltc", "nft", "opensea", "rarible", "airdrop", "seed phrase", "mnemonic", "private key",
    "比特币", "以太坊", "钱包", "加密货币", "数字货币", "虚拟货币", "区块链", "泰达币", "波场", "门罗币", "莱特币", "助记词", "私钥", "空投",
)


def financial_entities(docs: DataFrame, changes: Sequence[str], urgency: Sequence[str], id_: str = "doc_id", text: str = "text", countries: Sequence[str] = tuple(IBAN_LENGTHS)) -> DataFrame:
    """(id, ibans, accounts, invoices, wallets, swift, amount, wire, change, urgent, n_actionable, categories, score) of each text.

    changes and urgency are words of changed payment details and of pressure.
    Signals of a payment add up; a plain reminder (a transfer, an amount and an
    invoice, with nothing changed and no coins) stays under 0.15.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(id_, t.alias("_t"), F.lower(t).alias("_low"), F.regexp_extract_all(t, F.lit("([0-9A-Za-z_]+)"), 1).alias("_runs"))
    any_of = lambda words: reduce(Column.__or__, (F.col("_low").contains(w) for w in words), F.lit(False))
    found = lambda pattern: F.regexp_extract_all("_t", F.lit(pattern), 1)
    ibans = F.filter(found(IBAN), lambda v: F.upper(F.substr(v, F.lit(1), F.lit(2))).isin(*countries))
    coins = any_of(COINS)
    whole = lambda pattern: lambda r: r.rlike(f"^(?:{pattern})$")
    of_kind = {k: F.when(coins, F.size(F.filter("_runs", whole(pattern)))).otherwise(0) for k, (pattern, _) in WALLETS.items()}
    rows = rows.select(
        id_, F.size(ibans).alias("ibans"), F.size(found(ACCOUNT)).alias("accounts"), F.size(found(INVOICE)).alias("invoices"), F.struct(*(n.alias(k) for k, n in of_kind.items())).alias("_w"), coins.alias("_coins"),
        F.col("_t").rlike(SWIFT).alias("swift"), F.col("_t").rlike(AMOUNT).alias("amount"), F.col("_t").rlike(WIRE).alias("wire"), any_of(changes).alias("change"), any_of(urgency).alias("_urgent"),
    )
    one = lambda c: F.col(c).cast("int")
    wallets = reduce(Column.__add__, (F.col(f"_w.{k}") for k in WALLETS))
    rows = rows.withColumn("wallets", wallets).withColumn("n_actionable", F.col("ibans") + F.col("accounts") + F.col("wallets") + one("swift") + one("wire") + one("change"))
    references = (F.col("invoices") > 0).cast("int") + one("amount")
    rows = rows.withColumn("urgent", F.col("_urgent") & (F.col("n_actionable") > 0)).withColumn("_several", (F.col("n_actionable") >= 2) | ((F.col("n_actionable") >= 1) & (references >= 2)))
    weights = (
        (F.col("ibans") > 0, 0.15), (F.col("swift"), 0.15), (F.col("accounts") > 0, 0.15), (F.col("amount"), 0.10), (F.col("invoices") > 0, 0.075), (F.col("wire"), 0.20), (F.col("change"), 0.35), (F.col("urgent"), 0.25),
        (F.col("_several"), 0.15), *((F.col(f"_w.{k}") > 0, score) for k, (_, score) in WALLETS.items()),
    )
    total = reduce(Column.__add__, (F.when(c, w).otherwise(0.0) for c, w in weights))
    routine = ~F.col("change") & ~F.col("_coins") & F.col("wire") & F.col("amount") & (F.col("invoices") > 0) & (F.col("n_actionable") <= 3)
    names = {
        "iban_detected": F.col("ibans") > 0, "swift_code_detected": F.col("swift"), "bank_account_detected": F.col("accounts") > 0, "wire_transfer": F.col("wire"), "crypto_wallet": F.col("wallets") > 0,
        "ransomware_indicator": F.col("_w.xmr") > 0, "payment_change": F.col("change"), "urgency_financial_combo": F.col("urgent"), "multi_financial_entities": F.col("_several"),
    }
    categories = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in names.items())))
    score = F.least(F.lit(1.0), F.when(routine, F.least(total, F.lit(0.14))).otherwise(total))
    return rows.select(id_, "ibans", "accounts", "invoices", "wallets", "swift", "amount", "wire", "change", "urgent", "n_actionable", categories.alias("categories"), score.alias("score"))
