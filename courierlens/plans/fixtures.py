"""Mail-security tables as projections of the star-schema tables.

The texts are plain SELECTs that Spark SQL and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Findings (module:category) that lines of orders are dealt.
SIGNALS = (
    "header_scan:domain_mismatch,header_scan:auth_spf_dmarc_fail,header_scan:ioc_ip_hit,header_scan:sender_ip_malicious,header_scan:no_received,header_scan:stale_date,"
    "identity_anomaly:display_name_spoof,identity_anomaly:first_contact,identity_anomaly:random_sender,content_scan:gateway_pre_classified,content_scan:phishing,content_scan:bec,"
    "content_scan:account_security_phishing,content_scan:subsidy_fraud,content_scan:invoice_spam,content_scan:dlp_credit_card,content_scan:external_impersonation,content_scan:phone_in_body,"
    "attach_content:phishing,attach_content:attachment_phishing_url,attach_content:dlp_id_number,attach_content:weak_phishing,attach_scan:encrypted_archive,attach_scan:type_mismatch,"
    "attach_hash:hash_intel_malicious,attach_hash:known_bad,yara_scan:rule_hit,mime_scan:boundary,html_scan:hidden_text,link_scan:href_text_mismatch,link_content:suspicious_params,"
    "link_content:idn_homograph,link_content:other_link,link_content:targeted_credential_phishing,link_reputation:intel_malicious,link_reputation:redirect_url,link_reputation:suspicious_tld,"
    "link_reputation:odd_host,semantic_scan:nlp_phishing,semantic_scan:nlp_spam,semantic_scan:japanese_to_cn_corp,semantic_scan:nlp_scam,semantic_scan:odd_tone,anomaly_detect:no_recipients,"
    "anomaly_detect:volume,transaction_correlation:payment_change,transaction_correlation:crypto_wallet,transaction_correlation:iban_detected,domain_verify:aligned,plugin:nlp_bec"
)

#: Sensitive values that documents are dealt, by the remainder of their id.
SENSITIVE = (
    "card 4111-1111-1111-1111, &#53;105-1051-0510-5100 and 5105 1051 0510 5100, not 4111-1111-1111-1112", "id 11010519491231002X, 11010519491231002X; not 110105194912310021", "13800138000, 13900139000;15012345678 13800138000", "bank 6212345678901234569 4111111111111111",
    "住在福建省福州市鼓楼区软件园路 ok", "a-b@my-host.example.com, c.d@x.example;noreply@x.example E_F+1@Y.example", "passport E12345678 e1234567", "code 91350100M000100W0L 91350100M000100W0M",
    "раssword: hunter22 token=abcdef key: monkey secret = true", "SWIFT: DEUTDEFF500 BIC COBADEFFXXX", "CVV: 123 and otp 123456", "tax 110105ABCDEFGH1", "iban GB82WEST12345698765432 GB82WEST12345698765433", "USD 1,200,000 and 35,000 EUR, 12 RMB",
    "account: 12345678901", "contract no AB12345678, contract 123456, server 10.20.30.40 up", "fingerprint and iris scans, Fingerprint", "病历 处方 病史", "京A12345 LSVAU2180N2183294", "房产证号：A1234567", "工资：12,000", "longitude: 116.4074 and 39.9042, 116.4074",
    "OTP 998877", "贷款余额：5000", "受益人：张三 保费：200", "紧急联系人：李四", "工号：E1001 部门：风控", "判决书 开庭公告", "学历：本科", "营业执照号：110105012345678",
)

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_risk": (("events",), "SELECT user_id AS entity_key, event_id AS seq, ts, LEAST(1.0, value / 250.0) AS risk, CAST(0.30 AS DOUBLE) AS u_final, CAST(0.0 AS DOUBLE) AS k_conflict FROM events"),
    "fx_incidents": (("events",), "SELECT event_id AS incident_id, ts, user_id, user_id % 40 AS client_ip_n, event_type AS incident_type, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS severity, CAST(FLOOR(value) AS INT) AS item_count FROM events"),
    "fx_sessions": (("orders", "customer"), "SELECT o_orderkey AS session_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Active' ELSE 'Timeout' END AS status, CONCAT('c', CAST(o_custkey AS STRING)) AS sender_local, CONCAT(LOWER(c_mktsegment), CAST(c_nationkey AS STRING), '.example') AS sender_domain, o_orderpriority AS subject, CAST(FLOOR(o_totalprice) AS BIGINT) AS total_bytes FROM orders JOIN customer ON o_custkey = c_custkey"),
    "fx_recipients": (("lineitem", "supplier"), "SELECT DISTINCT l_orderkey AS session_id, CONCAT('s', CAST(l_suppkey AS STRING), '@n', CAST(s_nationkey AS STRING), '.example') AS recipient, CONCAT('n', CAST(s_nationkey AS STRING), '.example') AS rcpt_domain FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "fx_module_results": (("lineitem",), "SELECT l_orderkey AS session_id, l_linenumber AS module_n, l_partkey AS part_n, l_suppkey AS supp_n, l_linenumber % 5 AS pillar_n, LEAST(1.0, l_discount * 10.0) AS score, 1.0 - 5.0 * l_tax AS confidence, CAST(l_quantity AS BIGINT) AS duration_ms FROM lineitem"),
    "fx_signals": (("lineitem",), f"SELECT session_id, SPLIT_PART(signal, ':', 1) AS module, SPLIT_PART(signal, ':', 2) AS category, threat, score, weight, confidence FROM (SELECT l_orderkey AS session_id, SPLIT_PART('{SIGNALS}', ',', CASE WHEN l_orderkey % 9 = 0 THEN 39 + CAST(l_partkey % 3 AS INT) WHEN l_orderkey % 7 = 0 THEN 29 + CAST(l_partkey % 10 AS INT) ELSE CAST((l_partkey + l_suppkey) % {SIGNALS.count(',') + 1} AS INT) + 1 END) AS signal, CAST(l_suppkey % 5 AS INT) AS threat, LEAST(1.0, l_discount * 10.0 + l_tax) AS score, 0.5 + CAST(l_partkey % 6 AS DOUBLE) / 10.0 AS weight, 1.0 - 3.0 * l_tax AS confidence FROM lineitem) lines"),
    "fx_mail": (("orders",), "SELECT o_orderkey AS session_id, CONCAT(CASE o_custkey % 8 WHEN 0 THEN 'Automatic reply: ' WHEN 1 THEN 'Undeliverable: ' WHEN 2 THEN '[Suspected spam] ' WHEN 3 THEN 'CAUTION external mail: ' ELSE '' END, o_orderpriority) AS subject, CASE o_custkey % 5 WHEN 0 THEN CONCAT('Ann: are you there', CHR(10), 'Bob: yes', CHR(10), '10:15 Ann: good', CHR(10), 'bye') WHEN 1 THEN 'This mail came from outside, take care. Please pay the invoice.' WHEN 2 THEN CONCAT('09:10 call', CHR(10), CHR(10), '10:20 lunch', CHR(10), 'x', CHR(10), 'y') WHEN 3 THEN 'a: b' ELSE NULL END AS body, CASE o_custkey % 11 WHEN 0 THEN 'MAILER-DAEMON@n1.example' ELSE CONCAT('c', CAST(o_custkey AS STRING), '@n2.example') END AS sender, o_custkey % 13 = 0 AS auto_submitted, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE LEAST(1.2, o_totalprice / 200000.0) END AS alignment FROM orders"),
    "fx_web": (("events",), "SELECT event_id AS session_id, ts, CONCAT('10.0.0.', CAST(user_id % 4 AS STRING)) AS client_ip, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, CONCAT('/m/', event_type, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN CONCAT('?offset=', CAST(event_id AS STRING)) ELSE CONCAT('?sid=7&offset=', CAST(event_id AS STRING), '&attachmentId=2') END) AS uri, CASE WHEN user_id % 2 = 0 THEN 'a.txt' ELSE NULL END AS filename FROM events"),
    "fx_chunks": (("events",), "SELECT event_id AS chunk_id, ts, CONCAT('10.0.0.', CAST(user_id % 2 AS STRING)) AS client_ip, CONCAT('/up?composeId=c%3A', CAST(user_id % 2 AS STRING), '&attachmentId=', CASE WHEN event_type = 'view' THEN '' ELSE '1' END, '&offset=', CAST(event_id % 20 AS STRING)) AS uri, CASE WHEN event_type = 'click' THEN '' ELSE CONCAT('<', CAST(event_id AS STRING), '>') END AS data FROM events"),
    "fx_dlp": (("documents",), "SELECT doc_id, CONCAT(COALESCE(text, ''), ' ', CASE doc_id % " + str(len(SENSITIVE)) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(SENSITIVE)) + " END) AS text FROM documents"),
    "fx_flow": (("orders", "customer"), "SELECT o_orderkey AS mail_id, CONCAT(LOWER(c_mktsegment), CAST(c_nationkey AS STRING), '.example') AS sender, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(o_custkey % 1440 AS INT) AS sent_at FROM orders JOIN customer ON o_custkey = c_custkey"),
    "fx_html": (("pages",), "SELECT page_id, CONCAT(REPLACE(COALESCE(html, ''), 'href=\"/', CASE page_id % 4 WHEN 0 THEN 'class=x HREF=\"http://10.0.0.1:80/' WHEN 1 THEN 'href=\"https://google.com/login/' WHEN 2 THEN 'href=\"http://shop.example/my-account/' ELSE 'href=\"/' END), CASE page_id % 3 WHEN 0 THEN '<A id=1 HREF=''https://a.pay.example/q''>www.bank.co.uk  <b>log in</b></A><img src=\"http://img.example/p.png\"><a href=\"http://img.example/p.png\">picture</a>' WHEN 1 THEN '<a href=\"https://www.pay.example/\"> Pay.example </a><a href=\"http://256.1.1.1/x\">' ELSE '<link href=''http://c.example/a.css''><article><a>none</a>' END) AS html FROM pages"),
    "fx_signs": (("documents",), "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN TRANSLATE(LOWER(COALESCE(text, '')), 'etaoinshrdlcum', '的一是在不了有和人这中大为上') WHEN 1 THEN TRANSLATE(SUBSTR(COALESCE(text, ''), 1, 400), 'etaoinsh', '的㐀是㐁不豈有和') WHEN 2 THEN TRANSLATE(SUBSTR(COALESCE(text, ''), 1, 200), 'eta', '的的的') ELSE text END AS text FROM documents"),
    "fx_pay": (("documents",), "SELECT doc_id, CONCAT(COALESCE(text, ''), ' ', CASE doc_id % 12 WHEN 0 THEN 'Pay to DE89 3704 0044 0532 0130 00 or XX99ABCD12345678' WHEN 1 THEN 'SWIFT: DEUTDEFF500, account # 12-34-56 7890' WHEN 2 THEN 'invoice INV-2024 over $1,200.50 by bank transfer' WHEN 3 THEN 'We have new bank details, pay 500 euros immediately' WHEN 4 THEN CONCAT('send bitcoin to 1', SUBSTR('A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa', 1, 30), ' or 0x', REPEAT('aB', 20)) WHEN 5 THEN CONCAT('0x', REPEAT('12', 20), ' T', REPEAT('x', 33)) WHEN 6 THEN CONCAT('monero 4A', REPEAT('z', 93), ' within 24 hours') WHEN 7 THEN CONCAT('usdt T', REPEAT('x', 33), ' T', REPEAT('y', 33)) WHEN 8 THEN CONCAT('ltc1', REPEAT('q', 30), ' ', REPEAT('5', 44)) WHEN 9 THEN 'remittance, beneficiary, immediately' ELSE '' END) AS text FROM documents"),
    "fx_urls": (("pages",), "SELECT page_id, CONCAT(CASE page_id % 9 WHEN 0 THEN 'https://www-secure.' WHEN 1 THEN 'http://www2.' WHEN 2 THEN 'http://user@' WHEN 3 THEN 'http://192-168-1-1.' WHEN 4 THEN 'https://a.b.c.' WHEN 5 THEN 'https://mail.google.com/login?token=1&u=' ELSE 'https://' END, CASE page_id % 7 WHEN 0 THEN 'bncgjwl.top' WHEN 1 THEN '55555.com' WHEN 2 THEN 'my.pages.example' WHEN 3 THEN 'fdtujh.co.uk' WHEN 4 THEN 'shop.example' WHEN 5 THEN CONCAT('s', REPEAT('ea', 20), '.xyz') ELSE 'thonth.org' END, '/', CASE page_id % 8 WHEN 0 THEN 'login/verify?token=2&amp;redirect=x' WHEN 1 THEN 'a%252f' WHEN 2 THEN CONCAT('x', REPEAT('y', 400)) WHEN 3 THEN 'p#account/login/verify' WHEN 4 THEN 'Account%2Fq?tokens=1' ELSE CAST(page_id % 50 AS STRING) END) AS url FROM pages"),
    "fx_seen": (("orders",), "SELECT o_orderkey AS session_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, LEAST(1.0, o_totalprice / 450000.0) AS risk, 0.5 + CAST(o_custkey % 5 AS DOUBLE) / 10.0 AS confidence, CASE o_custkey % 4 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN CONCAT('8.8.', CAST(o_custkey % 7 AS STRING), '.9') ELSE '' END AS ip, CASE o_custkey % 9 WHEN 0 THEN NULL ELSE CONCAT(' C', CAST(o_custkey % 20 AS STRING), '@N', CAST(o_custkey % 6 AS STRING), '.example') END AS mail_from, CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('AB', CAST(o_custkey % 11 AS STRING)) ELSE NULL END AS file_hash, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('http://n', CAST(o_custkey % 8 AS STRING), '.example/x#y') ELSE NULL END AS link, CASE o_orderkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'nlp_phishing' WHEN 2 THEN 'NLP_BEC' WHEN 3 THEN 'mass_mailing' ELSE 'dlp_x' END AS category FROM orders"),
    "fx_known": (("supplier",), "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'email' WHEN 2 THEN 'domain' WHEN 3 THEN 'hash' ELSE 'url' END AS ioc_type, CASE s_suppkey % 5 WHEN 0 THEN CONCAT('8.8.', CAST(s_suppkey % 7 AS STRING), '.9') WHEN 1 THEN CONCAT('c', CAST(s_suppkey % 20 AS STRING), '@n', CAST(s_suppkey % 6 AS STRING), '.example') WHEN 2 THEN CONCAT('n', CAST(s_nationkey % 6 AS STRING), '.example') WHEN 3 THEN CONCAT('ab', CAST(s_suppkey % 11 AS STRING)) ELSE CONCAT('http://n', CAST(s_suppkey % 8 AS STRING), '.example/x') END AS indicator, CASE WHEN s_acctbal < 0 THEN 'malicious' WHEN s_acctbal < 6000 THEN 'suspicious' ELSE 'clean' END AS verdict, CAST(s_suppkey % 10 AS DOUBLE) / 10.0 AS confidence FROM supplier"),
    "fx_prose": (("documents",), "SELECT doc_id, CONCAT(CASE doc_id % 6 WHEN 0 THEN 'I hope this email finds you well. I am writing to inform you. ' WHEN 1 THEN 'Furthermore, moreover. Additionally! ' WHEN 2 THEN '此外，因此，鉴于此。 ' WHEN 3 THEN 'do not do not cannot we are. ' WHEN 4 THEN 'As previously mentioned, furthermore, moreover, consequently we are, you are, I am, do not go. 此外然而因此 ' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '' ELSE COALESCE(text, '') END) AS text FROM documents"),
    "fx_messages": (("orders",), "SELECT o_orderkey AS message_id, CAST(o_orderdate AS TIMESTAMP) AS received_at, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' HOUR WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL '9' DAY ELSE CAST(o_orderdate AS TIMESTAMP) END AS sent_at, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN UPPER(o_orderpriority) WHEN 2 THEN CONCAT('Re: ', o_orderpriority) WHEN 3 THEN 'Hi привет 你好' WHEN 4 THEN CASE o_custkey % 3 WHEN 0 THEN 'GOAIDC资产管理通知' WHEN 1 THEN 'IMG_7619.HEIC' ELSE 'AB12345678901' END ELSE o_orderpriority END AS subject, CASE o_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'a@x.example, b@y.example' WHEN 2 THEN CONCAT('u12345678', CAST(o_custkey % 10 AS STRING), '@wqzxkvbt.example') WHEN 3 THEN 'Pvzpfvq@8t5om.example' WHEN 4 THEN 'sales@snajgc.n3.example' WHEN 5 THEN 'ktipfnl@N0.example' ELSE CONCAT('c', CAST(o_custkey AS STRING), '@N', CAST(o_custkey % 5 AS STRING), '.example') END AS from_header, CASE WHEN o_custkey % 9 BETWEEN 2 AND 5 THEN NULL ELSE CONCAT('<c@n', CAST(o_custkey % 3 AS STRING), '.example>') END AS envelope_from, CAST(o_custkey % 4 AS INT) * 60 - 60 AS sent_offset, CASE WHEN o_orderkey % 4 = 0 THEN 'r@n1.example' ELSE NULL END AS reply_to, CASE WHEN o_orderkey % 5 = 0 THEN 'boss@n0.example' ELSE 'Boss' END AS display_name, o_orderkey % 14 * 5 AS n_to, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE NULL END AS in_reply_to, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'spf=fail dmarc=pass' WHEN 2 THEN 'spf=fail dmarc=FAIL' WHEN 3 THEN 'spf=pass dmarc=fail' ELSE 'spf=pass' END AS auth_results, o_custkey % 19 AS n_received, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'id' END AS id_header, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'text/plain' END AS content_type, CASE o_orderkey % 8 WHEN 0 THEN 'a.exe' WHEN 1 THEN 'Invoice.pdf.JS' WHEN 2 THEN 'a.txt' ELSE NULL END AS file_name, CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE 'binary' END AS declared, CASE WHEN o_custkey % 2 = 0 THEN 'text' ELSE 'binary' END AS detected, CAST(o_custkey % 3 AS BIGINT) * 20000000 AS file_size FROM orders"),
    "fx_lures": (("orders",), "SELECT o_orderkey AS message_id, CONCAT('n', CAST(o_custkey % 4 AS STRING), '.Example') AS sender_domain, CASE o_orderkey % 6 WHEN 0 THEN 'Account suspended: verify now' WHEN 1 THEN '13800138000 call me' WHEN 2 THEN '聊天记录 13800138000' WHEN 3 THEN 'Subsidy and tax refund' WHEN 4 THEN '[spam] hello' ELSE NULL END AS subject, CASE o_orderkey % 11 WHEN 0 THEN 'Your account is locked. Click here to restore.' WHEN 1 THEN 'subsidy refund, hurry' WHEN 2 THEN 'invoice for you, call 13900139000, wechat abc' WHEN 3 THEN 'invoice, wechat or qq, please' WHEN 4 THEN 'From the finance department and the board office of the firm' WHEN 5 THEN '您好，请查收附件，谢谢您的配合，此致敬礼，祝好，期待回复。Finance Dept' WHEN 6 THEN 'x' WHEN 7 THEN '13800138000 13900139000 15000150000' ELSE NULL END AS body, o_custkey % 2 AS n_images FROM orders"),
    "fx_verdicts": (("orders",), "SELECT o_orderkey AS session_id, o_orderdate AS created_at, LEAST(1.0, o_totalprice / 500000.0) AS risk FROM orders WHERE o_orderstatus <> 'P'"),
    "fx_iocs": (("supplier",), "SELECT CONCAT('n', CAST(s_nationkey AS STRING), '.example') AS indicator, 'domain' AS ioc_type, CONCAT('src', CAST(s_suppkey % 3 AS STRING)) AS source, CASE WHEN s_acctbal < 0 THEN 'malicious' WHEN s_acctbal < 3000 THEN 'suspicious' ELSE 'clean' END AS verdict, CAST(s_suppkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, s_suppkey AS seq FROM supplier"),
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture over the tables of a folder; a name without the prefix is a table itself."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, text = FIXTURES[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
