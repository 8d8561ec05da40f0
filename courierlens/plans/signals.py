"""Message checks, content lures and special indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import signals as op
from courierlens.operators.relational import PRIVATE
from courierlens.plans.registry import query


def _messages(m):
    file = F.struct(F.col("file_name").alias("name"), "declared", "detected", F.col("file_size").alias("size"))
    none = F.array().cast("array<struct<name:string,declared:string,detected:string,size:bigint>>")
    recipients = F.transform(F.sequence(F.lit(0), F.col("n_to").cast("int")), lambda i: F.concat(F.lit("r"), i.cast("string")))
    return m.withColumns({"attachments": F.when(F.col("file_name").isNotNull(), F.array(file)).otherwise(none), "recipients": F.slice(recipients, F.lit(1), F.col("n_to").cast("int"))})


_domain = lambda c: f"lower(COALESCE(regexp_extract({c}, '@([^@> ]+)>? *$', 1), ''))"
KNOWN_DOMAINS, KNOWN_NAMES = ("n0.example", "n1.example"), ("sales",)
#: The checks written out for DuckDB, apart from the operator's table.
FOUND_SQL = f"""m AS (SELECT *, COALESCE(subject, '') AS s, lower(COALESCE(file_name, '')) AS f, lower(COALESCE(auth_results, '')) AS a, trim(replace(replace(COALESCE(envelope_from, from_header, ''), '<', ''), '>', '')) AS addr FROM fx_messages),
  x AS (SELECT *, CAST(received_at AS DATE) AS day, {_domain('from_header')} AS from_domain, {_domain('envelope_from')} AS ed, {_domain('reply_to')} AS rd, {_domain('display_name')} AS dd, {_domain('addr')} AS ad, split_part(addr, '@', 1) AS who,
    length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS nl, length(regexp_replace(s, '[^0-9]', '', 'g')) AS nd, epoch(received_at) - epoch(sent_at) AS late, hour(sent_at + INTERVAL '1' MINUTE * sent_offset) AS h FROM m),
  y AS (SELECT *, split_part(ad, '.', 1) AS label, regexp_matches(ad, '(^|[.])n[01][.]example$') AS known, regexp_matches(f, '[.](exe|scr|bat|cmd|com|pif|vbs|vbe|js|jse|wsf|hta|ps1|msi|jar|lnk|iso|img)$') AS program FROM x),
  found AS (SELECT message_id, day, from_domain, unnest(list_filter([
    CASE WHEN n_to > 10 THEN 'subject:mass_mailing' END, CASE WHEN n_to = 0 THEN 'subject:no_recipients' END, CASE WHEN n_to >= 51 THEN 'subject:spam_cannon' END,
    CASE WHEN nl >= 5 AND s = upper(s) AND nl / (nl + nd) >= 0.4 AND NOT regexp_matches(s, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]') AND NOT regexp_full_match(trim(s), '[A-Za-z0-9._ ()-]+[.][A-Za-z0-9]{{2,5}}') THEN 'subject:all_caps_subject' END,
    CASE WHEN regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[\\x{{4E00}}-\\x{{9FFF}}]') AND regexp_matches(s, '[\\x{{0400}}-\\x{{04FF}}]') THEN 'subject:multilingual_gibberish' END,
    CASE WHEN trim(s) = '' AND f = '' THEN 'subject:empty_subject' END, CASE WHEN trim(s) = '' AND program THEN 'subject:empty_subject_with_attachment' END,
    CASE WHEN h IN (0, 1, 2, 3, 4) AND (f <> '' OR contains(lower(s), 'urgent')) THEN 'subject:off_hours_send' END,
    CASE WHEN dd <> '' AND dd <> from_domain THEN 'identity:display_name_spoof' END, CASE WHEN ed <> '' AND ed <> from_domain THEN 'identity:envelope_mismatch' END, CASE WHEN lower(s) LIKE 're:%' AND in_reply_to IS NULL THEN 'identity:reply_chain_anomaly' END,
    CASE WHEN NOT known AND who <> 'sales' AND regexp_full_match(who, '[A-Za-z]{{5,}}') AND regexp_matches(lower(who), '[b-df-hj-np-tv-z]{{4}}') THEN 'identity:random_sender' END,
    CASE WHEN NOT known AND length(label) >= 4 AND (regexp_matches(label, '[b-df-hj-np-tv-z]{{5}}') OR length(label) <= 8 AND regexp_matches(label, '[0-9]') AND length(regexp_replace(label, '[^a-z]', '', 'g')) IN (1, 2, 3, 4, 5)) THEN 'identity:random_domain' END,
    CASE WHEN rd <> '' AND rd <> from_domain THEN 'header:domain_mismatch' END, CASE WHEN a LIKE '%spf=fail%' AND a LIKE '%dmarc=fail%' THEN 'header:auth_spf_dmarc_fail' WHEN a LIKE '%spf=fail%' THEN 'header:auth_spf_fail' WHEN a LIKE '%dmarc=fail%' THEN 'header:auth_dmarc_fail' WHEN a = '' THEN 'header:no_auth_results' END,
    CASE WHEN sent_at IS NULL THEN 'header:missing_date' WHEN late < -3600 THEN 'header:future_date' WHEN late >= 8 * 86400 THEN 'header:stale_date' END, CASE WHEN id_header IS NULL THEN 'header:missing_message_id' END,
    CASE WHEN n_received = 0 THEN 'header:no_received' WHEN n_received >= 16 THEN 'header:excessive_hops' END,
    CASE WHEN from_domain = '' THEN 'mime:missing_from' END, CASE WHEN content_type = '' THEN 'mime:empty_content_type' END, CASE WHEN from_header LIKE '%@%@%' THEN 'mime:multi_address_from' END,
    CASE WHEN program THEN 'attachment:dangerous_extension' END, CASE WHEN program AND f LIKE '%.%.%' THEN 'attachment:double_extension' END, CASE WHEN f <> '' AND declared <> detected THEN 'attachment:mime_mismatch' END,
    CASE WHEN f <> '' AND file_size = 0 THEN 'attachment:zero_byte' END, CASE WHEN f <> '' AND file_size > 26214400 THEN 'attachment:oversized' END], lambda c: c IS NOT NULL)) AS c FROM y)"""


@query("message_signals", "fx_messages", sql=f"WITH {FOUND_SQL} SELECT message_id, day, from_domain, split_part(c, ':', 1) AS family, split_part(c, ':', 2) AS category FROM found")
def _findings(m):
    return op.message_findings(_messages(m), known_domains=KNOWN_DOMAINS, known_names=KNOWN_NAMES)


@query("message_signal_counts", "fx_messages", sql=f"WITH {FOUND_SQL} SELECT from_domain, day, split_part(c, ':', 2) AS category, COUNT(*) AS n FROM found GROUP BY 1, 2, 3")
def _finding_counts(m):
    return op.finding_counts(op.message_findings(_messages(m), known_domains=KNOWN_DOMAINS, known_names=KNOWN_NAMES))


WORDS = {
    "gateway": ("[spam]",), "phishing": ("verify", "suspended"), "threat": ("locked", "suspended"), "action": ("click here", "restore"), "subsidy": ("subsidy", "tax", "refund"), "urgency": ("hurry", "today"),
    "invoice": ("invoice",), "contact": ("wechat", "qq"), "authority": ("finance department", "board office"), "signature": ("finance dept",), "chat": ("聊天记录",),
}
INTERNAL, WELL_KNOWN = ("n0.example",), ("n1.example",)
_hits = lambda c, names: "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in names) + ")"
_phones = lambda c: f"len(list_distinct(regexp_extract_all({c}, '{op.PHONE}', 1)))"
LURE_SQL = f"""l AS (SELECT message_id, n_images, lower(sender_domain) AS d, lower(COALESCE(subject, '')) AS s, lower(COALESCE(body, '')) AS b FROM fx_lures),
  c AS (SELECT message_id, n_images, {', '.join(f'{_hits(c, WORDS[k])} AS {c}_{k}' for c, kinds in op.LISTS.items() for k in kinds)}, {_phones('s')} AS s_phones, {_phones('b')} AS b_phones, d <> 'n0.example' AS external, d = 'n1.example' AS well_known,
    length(regexp_replace(b, '\\s', '', 'g')) AS body_length, length(regexp_replace(b, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS n_han FROM l),
  y AS ({' UNION ALL '.join(f"SELECT message_id, '{k}' AS lure, CAST({s} AS DOUBLE) AS score FROM c WHERE {cond}" for k, (cond, s) in op.LURES.items())})"""


@query(
    "content_lures", "fx_lures",
    sql=f"WITH {LURE_SQL} SELECT message_id, lure, R6(score, 6) AS score FROM (SELECT * FROM y UNION ALL SELECT message_id, 'phone_in_body', CAST(LEAST(0.12, 0.04 * b_phones) AS DOUBLE) FROM c WHERE {op.PHONES_ALONE} AND message_id IN (SELECT message_id FROM y))",
)
def _lures(m):
    return op.content_lures(m, WORDS, INTERNAL, WELL_KNOWN).withColumn("score", round6("score"))


SPECIAL_SQL = """s AS (SELECT o.o_orderkey AS session_id, 'C' || o.o_custkey % 50 || '@' || c.c_mktsegment || '.example' AS mail_from, lower(c.c_mktsegment) || '.example' AS d, CASE WHEN o.o_custkey % 3 = 0 THEN '10.0.0.1' WHEN o.o_custkey % 7 = 0 THEN '' ELSE '8.8.' || o.o_custkey % 5 || '.1' END AS ip,
    CASE WHEN o.o_totalprice > 250000 THEN 4 ELSE 2 END AS rank, 'x@' || CASE WHEN o.o_orderkey % 2 = 0 THEN 'building' ELSE 'other' END || '.example' AS r, CASE WHEN o.o_orderkey % 5 = 0 THEN 4 ELSE 1 END AS nr, CAST(o.o_custkey % 10 AS DOUBLE) / 10 AS nc FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
  p AS (SELECT *, ip LIKE '8.%' AS outside FROM s), ours AS (SELECT * FROM p WHERE rank >= 4 AND d = 'building.example' AND r = 'x@building.example'), alike AS (SELECT *, CASE WHEN d = 'machinery.example' THEN 0.8 ELSE 0.7 END AS c FROM p WHERE d IN ('machinery.example', 'household.example')),
  e AS (SELECT 'ip' AS ioc_type, ip AS indicator, 'spoofing' AS attack, CAST(0.6 AS DOUBLE) AS confidence FROM ours WHERE outside UNION ALL SELECT 'domain', d, 'spoofing', 0.6 FROM ours UNION ALL SELECT 'email', lower(mail_from), 'spoofing', 0.6 FROM ours
    UNION ALL SELECT 'domain', d, 'domain_impersonation', c FROM alike UNION ALL SELECT 'email', lower(mail_from), 'domain_impersonation', c FROM alike UNION ALL SELECT 'ip', ip, 'domain_impersonation', 0.8 * c FROM alike WHERE outside
    UNION ALL SELECT 'ip', ip, 'nonsensical_spam', nc FROM s WHERE nc >= 0.7 AND nr >= 4 AND ip LIKE '8.%'
    UNION ALL SELECT 'email', lower(mail_from), 'nonsensical_spam', nc FROM s WHERE nc >= 0.7 AND nr >= 4 UNION ALL SELECT 'domain', d, 'nonsensical_spam', nc FROM s WHERE nc >= 0.7 AND nr >= 4)"""


@query(
    "auto_iocs_special", "orders", "customer",
    sql=f"WITH {SPECIAL_SQL} SELECT indicator, ioc_type, attack, R6(MAX(confidence), 6) AS confidence, COUNT(*) AS hits FROM e WHERE attack = 'spoofing' OR NOT (ioc_type = 'domain' AND indicator IN ('furniture.example', 'building.example')) AND NOT (ioc_type = 'ip' AND indicator = '8.8.4.1') GROUP BY 1, 2, 3",
)
def _special(o, c):
    k, cust, spark = F.col("o_orderkey"), F.col("o_custkey"), o.sparkSession
    ip = F.when(cust % 3 == 0, "10.0.0.1").when(cust % 7 == 0, "").otherwise(F.concat(F.lit("8.8."), (cust % 5).cast("string"), F.lit(".1")))
    sessions = o.join(c, cust == F.col("c_custkey")).select(
        k.alias("session_id"), F.concat(F.lit("C"), (cust % 50).cast("string"), F.lit("@"), "c_mktsegment", F.lit(".example")).alias("mail_from"), F.array(F.when(k % 2 == 0, "x@building.example").otherwise("x@other.example")).alias("recipients"),
        ip.alias("origin_ip"), F.when(F.col("o_totalprice") > 250_000, 4).otherwise(2).alias("rank"), F.when(k % 5 == 0, 4).otherwise(1).alias("nonsense_rank"), ((cust % 10).cast("double") / 10).alias("nonsense_confidence"),
    )
    internal = spark.createDataFrame([("Building.example",)], "domain string")
    alike = spark.createDataFrame([("machinery.example", 0.9), ("household.example", 0.35), ("automobile.example", 0.2)], "domain string, score double")
    allowed = spark.createDataFrame([("domain", "furniture.example"), ("domain", "building.example"), ("ip", "8.8.4.1")], "ioc_type string, indicator string")
    return op.special_iocs(sessions, internal, alike, allowed, PRIVATE).withColumn("confidence", round6("confidence"))
