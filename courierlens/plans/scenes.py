"""Scene, gate and impersonation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import scenes as op
from courierlens.operators import text as text_op
from courierlens.operators import transactions
from courierlens.plans.registry import query
from courierlens.plans.text import HOST_SQL, lookalikes_sql

SCENE_SQL = """SELECT sender_domain AS actor, CASE WHEN COUNT(*) % 2 = 0 THEN 'bulk' ELSE 'bounce' END AS scene_type, CASE WHEN COUNT(*) >= 130 THEN 'critical' WHEN COUNT(*) >= 110 THEN 'high' ELSE 'medium' END AS severity,
  MIN(started_at) AS first_seen, MAX(started_at) AS last_seen, COUNT(*) AS mails FROM fx_sessions"""


def _scenes(s):
    n = F.col("mails")
    rows = s.groupBy(F.col("sender_domain").alias("actor")).agg(F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.count(F.lit(1)).alias("mails"))
    return rows.select("actor", F.when(n % 2 == 0, "bulk").otherwise("bounce").alias("scene_type"), F.when(n >= 130, "critical").when(n >= 110, "high").otherwise("medium").alias("severity"), "first_seen", "last_seen", "mails")


@query(
    "scene_lifecycle", "fx_sessions",
    sql=f"""WITH m AS (SELECT MAX(started_at) AS now FROM fx_sessions), o AS (SELECT *, 'active' AS status FROM ({SCENE_SQL} WHERE started_at < (SELECT now - INTERVAL 400 DAYS FROM m) GROUP BY 1)), n AS ({SCENE_SQL} WHERE started_at >= (SELECT now - INTERVAL 20 DAYS FROM m) GROUP BY 1),
      j AS (SELECT COALESCE(o.scene_type, n.scene_type) AS scene_type, COALESCE(o.actor, n.actor) AS actor, o.severity AS os, n.severity AS ns, o.first_seen AS f1, n.first_seen AS f2, o.last_seen AS l1, n.last_seen AS l2, o.mails AS m1, n.mails AS m2 FROM o FULL JOIN n ON o.scene_type = n.scene_type AND o.actor = n.actor),
      k AS (SELECT *, CASE WHEN list_position(['medium', 'high', 'critical'], COALESCE(ns, '')) >= list_position(['medium', 'high', 'critical'], COALESCE(os, '')) OR os IS NULL THEN ns ELSE os END AS sev FROM j)
      SELECT COALESCE(sev, os) AS severity, CASE WHEN l2 IS NULL AND l1 < (SELECT now - INTERVAL 24 HOURS FROM m) THEN 'resolved' WHEN COALESCE(sev, os) = 'critical' THEN 'blocked' WHEN l2 IS NOT NULL THEN 'active' ELSE 'active' END AS status, scene_type, COUNT(*) AS n, CAST(SUM(COALESCE(m2, m1)) AS BIGINT) AS mails FROM k GROUP BY 1, 2, 3""",
)
def _lifecycle(s):
    now = s.agg(F.max("started_at").alias("t")).scalar()
    old = _scenes(s.filter(F.col("started_at") < now - F.expr("INTERVAL 400 DAYS"))).withColumn("status", F.lit("active"))
    new = _scenes(s.filter(F.col("started_at") >= now - F.expr("INTERVAL 20 DAYS")))
    return op.lifecycle(old, new, now).groupBy("severity", "status", "scene_type").agg(F.count(F.lit(1)).alias("n"), F.sum("mails").alias("mails"))


@query(
    "scene_stats", "fx_sessions",
    sql=f"SELECT scene_type, COUNT(*) FILTER (WHERE severity = 'medium') AS medium, COUNT(*) FILTER (WHERE severity = 'high') AS high, COUNT(*) FILTER (WHERE severity = 'critical') AS critical, COUNT(*) FILTER (WHERE last_seen >= (SELECT MAX(started_at) - INTERVAL 24 HOURS FROM fx_sessions)) AS last_24h FROM ({SCENE_SQL} GROUP BY 1) GROUP BY 1",
)
def _scene_stats(s):
    now = s.agg(F.max("started_at").alias("t")).scalar()
    return op.scene_counts(_scenes(s).withColumnRenamed("severity", "status"), now, ("medium", "high", "critical"))


IMPERSONATED = ("the.example.com", "thther.example.net", "www.ththhe.example.net")


@query(
    "internal_impersonation", "pages",
    sql=f"""SELECT domain AS actor, protected, kind, mails, recipients, CASE WHEN kind IN ('homoglyph', 'tld_swap') THEN CASE WHEN mails >= 10 THEN 'critical' ELSE 'high' END WHEN mails >= 10 THEN 'high' ELSE 'medium' END AS severity
      FROM ({lookalikes_sql(IMPERSONATED)}) l JOIN (SELECT {HOST_SQL} AS host, COUNT(*) AS mails, COUNT(DISTINCT page_id) AS recipients FROM pages GROUP BY 1) h ON h.host = l.domain""",
)
def _impersonation(p):
    hosts = p.select(text_op.host_of(F.col("url")).alias("sender_domain"), "page_id")
    senders = hosts.groupBy("sender_domain").agg(F.count(F.lit(1)).alias("mails"), F.count_distinct("page_id").alias("recipients"))
    protected = p.sparkSession.createDataFrame([(x,) for x in IMPERSONATED], "domain string")
    return op.impersonation(senders, text_op.lookalikes(senders.select(F.col("sender_domain").alias("domain")), protected), 1)


@query(
    "admission_filter", "fx_sessions", "fx_recipients",
    sql="""WITH h AS (SELECT session_id, COUNT(*) AS headers, MIN(rcpt_domain) AS server FROM fx_recipients GROUP BY 1)
      SELECT s.session_id, s.sender_domain FROM fx_sessions s JOIN h ON h.session_id = s.session_id WHERE h.server IN ('n1.example', 'n10.example', 'n11.example') AND NOT (s.sender_domain LIKE 'b%' AND s.sender_local IN (SELECT DISTINCT sender_local FROM fx_sessions WHERE sender_local LIKE '%7'))""",
)
def _admission(s, r):
    h = r.groupBy("session_id").agg(F.collect_list("recipient").alias("headers"), F.min("rcpt_domain").alias("server_ip"))
    rows = s.join(h, "session_id").withColumnRenamed("sender_local", "client_ip")
    trusted = s.filter("sender_domain LIKE 'b%'").select(F.col("sender_domain").alias("domain")), s.filter("sender_local LIKE '%7'").select(F.col("sender_local").alias("ip"))
    return op.admitted(rows, ("n1.example", "n10.example", "n11.example"), *trusted).select("session_id", "sender_domain")


@query(
    "reanalysis_gate", "fx_incidents",
    sql="""WITH RECURSIVE o AS (SELECT user_id, incident_id AS id, epoch_us(ts) / 1e6 AS t, severity = 'critical' AS done, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), incident_id) AS k FROM fx_incidents),
      p AS (SELECT user_id, k, id, t AS last, done, true AS took FROM o WHERE k = 1 UNION ALL
            SELECT o.user_id, o.k, o.id, CASE WHEN o.t - p.last >= 86400 OR (o.done AND NOT p.done) THEN o.t ELSE p.last END, p.done OR o.done, o.t - p.last >= 86400 OR (o.done AND NOT p.done) FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1)
      SELECT user_id AS session_id, id AS seq FROM p WHERE took""",
)
def _reanalysis(i):
    rows = i.select(F.col("user_id").alias("session_id"), "ts", F.col("incident_id").alias("seq"), F.when(F.col("severity") == "critical", "Completed").otherwise("Active").alias("status"))
    return op.reanalysis(rows, seconds=86_400)


@query(
    "url_typos", "pages",
    sql="WITH w AS (SELECT DISTINCT unnest(string_split(regexp_extract(url, '://([^/]+)', 1), '.')) AS word FROM pages), d AS (SELECT word, b AS brand, levenshtein(word, b) AS distance FROM w, (SELECT unnest(['thonth', 'blogs', 'exemple', 'shopp']) AS b) WHERE length(word) >= 4) SELECT word, arg_min(brand, (distance, brand)) AS brand, CAST(MIN(distance) AS INT) AS distance FROM d WHERE distance BETWEEN 1 AND 2 GROUP BY 1",
)
def _typos(p):
    words = p.select(F.explode(F.split(F.regexp_extract("url", "://([^/]+)", 1), "[.]")).alias("word"))
    brands = p.sparkSession.createDataFrame([(b,) for b in ("thonth", "blogs", "exemple", "shopp")], "brand string")
    return op.typos(words, brands)


CHANGES, URGENCY = ("new bank details", "changed our account"), ("immediately", "within 24 hours")


@query(
    "financial_entities", "fx_pay",
    sql="""WITH t AS (SELECT doc_id, COALESCE(text, '') AS t, lower(COALESCE(text, '')) AS low, regexp_extract_all(COALESCE(text, ''), '[0-9A-Za-z_]+') AS runs FROM fx_pay),
      c AS (SELECT *, regexp_matches(low, 'bitcoin|btc|wallet|crypto|ethereum|blockchain|usd[tc]|tether|[tb]?rc-?20|erc-?20|bep-?20|tron|binance|bnb|polygon|matic|solana|phantom|metamask|trust ?wallet|monero|xmr|litecoin|ltc|nft|opensea|rarible|airdrop|seed phrase|mnemonic|private key') AS coins FROM t),
      k AS (SELECT *, len(list_filter(regexp_extract_all(t, '(?i)(?:^|[^0-9A-Za-z_])([A-Z]{2}[0-9]{2}\\s?[0-9A-Z]{4}\\s?(?:[0-9A-Z]{4}\\s?){1,7}[0-9A-Z]{1,4})(?:[^0-9A-Za-z_]|$)', 1), lambda v: upper(v[1:2]) IN ('DE', 'GB'))) AS ibans,
        len(regexp_extract_all(t, '(?i)(?:account|acct|a/c|routing|sort[\\s-]?code)[:\\s#]*[0-9][0-9\\s-]{4,18}[0-9]')) AS accounts, len(regexp_extract_all(t, '(?i)(?:invoice|inv|purchase[\\s-]?order|po|receipt)[\\s#:-]*[A-Z0-9]{3,20}(?:[^0-9A-Za-z_]|$)')) AS invoices,
        regexp_matches(t, '(?i)(?:^|[^0-9A-Za-z_])(?:SWIFT|BIC)[:\\s]*[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?:[^0-9A-Za-z_]|$)') AS swift, regexp_matches(t, '(?i)(?:[$€£¥₹]|USD|EUR|GBP|CNY|RMB)\\s*[0-9,]+|[0-9][0-9,]*(?:[.][0-9]{1,2})?\\s*(?:dollars?|euros?|pounds?|yuan|rmb)(?:[^0-9A-Za-z_]|$)') AS amount,
        regexp_matches(t, '(?i)(?:^|[^0-9A-Za-z_])(?:wire[\\s-]?transfer|bank[\\s-]?transfer|remittance|beneficiary|intermediary[\\s-]?bank)(?:[^0-9A-Za-z_]|$)') AS wire, regexp_matches(low, 'new bank details|changed our account') AS change, regexp_matches(low, 'immediately|within 24 hours') AS pressed,
        CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, '[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[a-zA-HJ-NP-Z0-9]{25,62}'))) ELSE 0 END AS btc, CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, '0x[0-9a-fA-F]{40}'))) ELSE 0 END AS eth,
        CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, 'T[1-9A-HJ-NP-Za-km-z]{33}'))) ELSE 0 END AS tron, CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, '[1-9A-HJ-NP-Za-km-z]{43,44}'))) ELSE 0 END AS sol,
        CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, '4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}'))) ELSE 0 END AS xmr, CASE WHEN coins THEN len(list_filter(runs, lambda r: regexp_full_match(r, '[LM][1-9A-HJ-NP-Za-km-z]{25,34}|ltc1[a-z0-9]{25,62}'))) ELSE 0 END AS ltc FROM c),
      n AS (SELECT *, btc + eth + tron + sol + xmr + ltc AS wallets, ibans + accounts + btc + eth + tron + sol + xmr + ltc + CAST(swift AS INT) + CAST(wire AS INT) + CAST(change AS INT) AS n FROM k),
      m AS (SELECT *, n >= 2 OR n = 1 AND invoices > 0 AND amount AS several, pressed AND n > 0 AS urgent FROM n),
      s AS (SELECT *, 0.15 * (CAST(ibans > 0 AS INT) + CAST(swift AS INT) + CAST(accounts > 0 AS INT) + CAST(several AS INT)) + 0.1 * CAST(amount AS INT) + 0.075 * CAST(invoices > 0 AS INT) + 0.2 * CAST(wire AS INT) + 0.35 * CAST(change AS INT) + 0.25 * CAST(urgent AS INT)
        + 0.4 * CAST(btc > 0 AS INT) + 0.35 * CAST(eth > 0 AS INT) + 0.4 * CAST(tron > 0 AS INT) + 0.3 * CAST(sol > 0 AS INT) + 0.45 * CAST(xmr > 0 AS INT) + 0.3 * CAST(ltc > 0 AS INT) AS total FROM m)
      SELECT doc_id, CAST(ibans AS INT) AS ibans, CAST(accounts AS INT) AS accounts, CAST(invoices AS INT) AS invoices, CAST(wallets AS INT) AS wallets, swift, amount, wire, change, urgent, CAST(n AS INT) AS n_actionable,
        array_to_string(list_filter([CASE WHEN ibans > 0 THEN 'iban_detected' END, CASE WHEN swift THEN 'swift_code_detected' END, CASE WHEN accounts > 0 THEN 'bank_account_detected' END, CASE WHEN wire THEN 'wire_transfer' END, CASE WHEN wallets > 0 THEN 'crypto_wallet' END,
          CASE WHEN xmr > 0 THEN 'ransomware_indicator' END, CASE WHEN change THEN 'payment_change' END, CASE WHEN urgent THEN 'urgency_financial_combo' END, CASE WHEN several THEN 'multi_financial_entities' END], lambda x: x IS NOT NULL), ',') AS categories,
        R6(least(1.0, CASE WHEN NOT change AND NOT coins AND wire AND amount AND invoices > 0 AND n <= 3 THEN least(total, 0.14) ELSE total END), 6) AS score FROM s""",
)
def _financial(d):
    return transactions.financial_entities(d, CHANGES, URGENCY, countries=("DE", "GB")).withColumns({"categories": F.array_join("categories", ","), "score": round6("score")})
