"""Filter and join queries over the fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierlens.operators import indicators as ioc_op
from courierlens.operators import relational as op
from courierlens.operators import retention as keep
from courierlens.plans.registry import query
from courierlens.schemas import LEVEL_RANK, rank, threat_level
from courierlens.sources import indicators, sessions

LEVEL_SQL = "CASE WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.65 THEN 'high' WHEN risk >= 0.40 THEN 'medium' WHEN risk >= 0.15 THEN 'low' ELSE 'safe' END"


@query(
    "threat_level", "fx_verdicts",
    sql=f"SELECT level, CASE WHEN level IN ('high', 'critical') THEN 'reject' WHEN level = 'medium' THEN 'quarantine' ELSE 'accept' END AS action, COUNT(*) AS n FROM (SELECT {LEVEL_SQL} AS level FROM fx_verdicts) GROUP BY 1, 2",
)
def _threat_level(v):
    level = threat_level(F.col("risk"))
    place = rank(F.col("level"), LEVEL_RANK)
    action = F.when(place >= LEVEL_RANK["high"], "reject").when(place >= LEVEL_RANK["medium"], "quarantine").otherwise("accept")
    return v.select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("action", action)


@query(
    "list_sessions", "fx_sessions", "fx_verdicts",
    sql=f"SELECT s.session_id, s.started_at, s.status, s.sender_domain, s.subject, s.total_bytes, v.level FROM fx_sessions s LEFT JOIN (SELECT session_id, {LEVEL_SQL} AS level FROM fx_verdicts) v ON s.session_id = v.session_id WHERE s.status IN ('Completed', 'Timeout') AND (s.subject LIKE '%URGENT%' OR s.sender_domain LIKE '%URGENT%') ORDER BY s.started_at DESC, s.session_id DESC LIMIT 50 OFFSET 50",
)
def _list_sessions(s, v):
    found = op.search(s, within={"status": ["Completed", "Timeout"]}, like=(["subject", "sender_domain"], "URGENT"))
    top = op.page(found, [F.desc("started_at"), F.desc("session_id")], 50, 50)
    return op.with_verdict(top, v).select("session_id", "started_at", "status", "sender_domain", "subject", "total_bytes", "level")


@query(
    "list_events", "fx_incidents",
    sql="SELECT incident_id, ts, user_id, incident_type, severity FROM fx_incidents WHERE severity = 'critical' AND incident_type LIKE '%c%' ORDER BY ts DESC, incident_id DESC LIMIT 100",
)
def _list_events(i):
    return op.page(op.search(i, equal={"severity": "critical"}, like=(["incident_type"], "c")), [F.desc("ts"), F.desc("incident_id")], 100).select("incident_id", "ts", "user_id", "incident_type", "severity")


@query(
    "list_iocs_with_total", "fx_iocs",
    sql="SELECT seq, indicator, source, verdict, confidence, COUNT(*) OVER () AS total FROM fx_iocs WHERE verdict <> 'clean' ORDER BY confidence DESC, seq LIMIT 20",
)
def _list_iocs(i):
    found = i.filter("verdict <> 'clean'")
    return op.with_total(op.page(found, [F.desc("confidence"), F.asc("seq")], 20), found).select("seq", "indicator", "source", "verdict", "confidence", "total")


@query(
    "analyzable_sessions", "fx_sessions", "fx_recipients",
    sql="SELECT s.status, COUNT(*) AS n, CAST(SUM(s.total_bytes) AS BIGINT) AS bytes FROM fx_sessions s WHERE s.total_bytes > 0 AND EXISTS (SELECT 1 FROM fx_recipients r WHERE r.session_id = s.session_id) GROUP BY 1",
)
def _analyzable(s, r):
    return s.filter("total_bytes > 0").join(r.select("session_id"), "session_id", "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"))


@query(
    "mail_direction", "fx_sessions", "fx_recipients",
    sql="""SELECT direction, COUNT(*) AS n FROM (
      SELECT s.session_id, CASE WHEN s.sender_domain NOT IN ('building3.example', 'machinery7.example', 'furniture1.example') THEN 'inbound'
             WHEN bool_or(r.rcpt_domain NOT IN ('n3.example', 'n7.example', 'building3.example')) THEN 'outbound' ELSE 'internal' END AS direction
      FROM fx_sessions s JOIN fx_recipients r ON s.session_id = r.session_id GROUP BY s.session_id, s.sender_domain) GROUP BY 1""",
)
def _mail_direction(s, r):
    own = ["building3.example", "machinery7.example", "furniture1.example", "n3.example", "n7.example"]
    rcpt = r.groupBy("session_id").agg(F.collect_set("rcpt_domain").alias("rcpts"))
    return s.join(rcpt, "session_id").select(op.direction(F.col("sender_domain"), F.col("rcpts"), own).alias("direction")).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "off_hours_severity", "fx_incidents",
    sql="""SELECT severity, raised, off_hours, COUNT(*) AS n FROM (
      SELECT severity, off AS off_hours, CASE WHEN NOT off THEN severity WHEN severity = 'low' THEN 'medium' WHEN severity = 'medium' THEN 'high' ELSE 'critical' END AS raised
      FROM (SELECT severity, dayofweek(l) IN (0, 6) OR hour(l) < 9 OR hour(l) >= 18 AS off FROM (SELECT severity, ts + INTERVAL 8 HOURS AS l FROM fx_incidents)))
      GROUP BY 1, 2, 3""",
)
def _off_hours(i):
    return op.off_hours(i).groupBy("severity", "raised", "off_hours").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sessions_with_verdict", "fx_sessions", "fx_verdicts",
    sql=f"SELECT s.session_id, s.status, v.level FROM fx_sessions s LEFT JOIN (SELECT session_id, {LEVEL_SQL} AS level FROM fx_verdicts) v ON s.session_id = v.session_id",
)
def _sessions_with_verdict(s, v):
    return op.with_verdict(s.select("session_id", "status"), v)


@query(
    "recent_verdicts", "fx_verdicts", "fx_sessions",
    sql=f"SELECT v.session_id, v.created_at, v.level, s.sender_domain, s.subject, COUNT(*) OVER () AS total FROM (SELECT *, {LEVEL_SQL} AS level FROM fx_verdicts) v JOIN fx_sessions s ON v.session_id = s.session_id WHERE v.level <> 'safe' ORDER BY v.created_at DESC, v.session_id DESC LIMIT 100",
)
def _recent_verdicts(v, s):
    rows = v.withColumn("level", threat_level(F.col("risk"))).filter("level <> 'safe'").join(s.select("session_id", "sender_domain", "subject"), "session_id")
    return op.with_total(op.page(rows, [F.desc("created_at"), F.desc("session_id")], 100), rows).select("session_id", "created_at", "level", "sender_domain", "subject", "total")


@query(
    "unanalyzed_sessions", "fx_sessions", "fx_verdicts",
    sql="SELECT session_id, started_at, sender_domain FROM fx_sessions s WHERE status = 'Completed' AND NOT EXISTS (SELECT 1 FROM fx_verdicts v WHERE v.session_id = s.session_id)",
)
def _unanalyzed(s, v):
    return op.without_verdict(s, v).select("session_id", "started_at", "sender_domain")


@query(
    "first_contact", "fx_sessions",
    sql="""SELECT sender_domain, session_id, started_at, senders FROM (
      SELECT *, row_number() OVER (PARTITION BY sender_domain ORDER BY started_at, session_id) AS k FROM fx_sessions s
      JOIN (SELECT sender_domain AS d, COUNT(DISTINCT sender_local) AS senders FROM fx_sessions GROUP BY 1) c ON c.d = s.sender_domain)
      WHERE k = 1 AND senders < 14 AND sender_domain NOT IN ('building3.example')""",
)
def _first_contact(s):
    return op.first_contacts(s, internal=["building3.example"], max_senders=14)


@query(
    "related_sessions", "conversations",
    sql="SELECT a.conv_id AS key, a.turn AS id, b.turn AS other_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn",
)
def _related(c):
    return op.related(c.select(F.col("conv_id").alias("key"), "turn"), "key", "turn")


@query(
    "user_by_ip_asof", "fx_incidents",
    sql="""WITH i AS (SELECT incident_id, ts, client_ip_n, CASE WHEN incident_id % 3 <> 0 THEN user_id END AS u FROM fx_incidents),
      k AS (SELECT a.incident_id, arg_max(b.u, (epoch_us(b.ts), b.incident_id)) AS u FROM i a JOIN i b ON a.client_ip_n = b.client_ip_n AND b.u IS NOT NULL AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 HOURS WHERE a.u IS NULL GROUP BY 1)
      SELECT i.incident_id, COALESCE(i.u, k.u) AS known_user FROM i LEFT JOIN k ON i.incident_id = k.incident_id""",
)
def _asof(i):
    rows = i.withColumn("u", F.when(F.col("incident_id") % 3 != 0, F.col("user_id")))
    return op.last_known(rows, "client_ip_n", "u", "ts", "incident_id", 7200).select("incident_id", F.col("known").alias("known_user"))


SEEN_SQL = """seen AS (SELECT DISTINCT session_id, ioc_type, indicator FROM (
    SELECT session_id, 'ip' AS ioc_type, ip AS indicator FROM fx_seen WHERE ip LIKE '8.%' UNION ALL SELECT session_id, 'email', lower(trim(mail_from)) FROM fx_seen WHERE mail_from IS NOT NULL
    UNION ALL SELECT session_id, 'domain', lower(split_part(mail_from, '@', 2)) FROM fx_seen WHERE mail_from IS NOT NULL UNION ALL SELECT session_id, 'hash', lower(file_hash) FROM fx_seen WHERE file_hash IS NOT NULL
    UNION ALL SELECT session_id, 'url', split_part(link, '#', 1) FROM fx_seen WHERE link IS NOT NULL)),
  allowed AS (SELECT * FROM (VALUES ('domain', 'n1.example'), ('ip', '8.8.2.9'), ('url', 'http://n4.example/x')) t(ioc_type, indicator))"""


def _seen(rows):
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return ioc_op.observables(rows.select("session_id", "ip", "mail_from", listed("file_hash").alias("hashes"), listed("link").alias("urls")), op.PRIVATE)


def _allowed(spark):
    return spark.createDataFrame([("domain", "n1.example"), ("ip", "8.8.2.9"), ("url", "http://n4.example/x")], "ioc_type string, indicator string")


@query(
    "ioc_enrich", "fx_seen", "fx_known",
    sql=f"""WITH {SEEN_SQL}, k AS (SELECT ioc_type, indicator, COUNT(*) AS hits, MAX(confidence) AS confidence, MIN(verdict) AS verdict FROM fx_known WHERE verdict <> 'clean' AND (ioc_type, indicator) NOT IN (SELECT (ioc_type, indicator) FROM allowed) GROUP BY 1, 2)
      SELECT seen.session_id, k.* FROM seen JOIN k ON k.ioc_type = seen.ioc_type AND k.indicator = seen.indicator""",
)
def _ioc_enrich(s, known):
    return ioc_op.enriched(_seen(s), known, _allowed(s.sparkSession))


@query(
    "auto_iocs_from_verdicts", "fx_seen",
    sql=f"""WITH {SEEN_SQL}, v AS (SELECT *, CASE category WHEN 'nlp_phishing' THEN 'phishing' WHEN 'NLP_BEC' THEN 'bec' WHEN 'mass_mailing' THEN 'spam' WHEN 'dlp_x' THEN 'data_leak' ELSE 'unknown' END AS attack FROM fx_seen WHERE risk >= 0.85)
      SELECT seen.ioc_type, seen.indicator, MIN(attack) AS attack_type, COUNT(*) AS hit_count, MAX(confidence) AS confidence, MAX(created_at) + INTERVAL 30 DAYS AS expires_at FROM v JOIN seen ON seen.session_id = v.session_id
      WHERE (seen.ioc_type, seen.indicator) NOT IN (SELECT (ioc_type, indicator) FROM allowed) GROUP BY 1, 2""",
)
def _auto_iocs(s):
    return ioc_op.from_verdicts(s.withColumn("categories", F.array("category")), _seen(s), _allowed(s.sparkSession))


@query(
    "domain_policy_match", "fx_sessions",
    sql="SELECT DISTINCT s.sender_domain AS host, r.rule FROM fx_sessions s JOIN (SELECT unnest(['building3.example', '*.example', 'example', '*.building3.example']) AS rule) r ON (r.rule LIKE '*.%' AND s.sender_domain LIKE '%' || substr(r.rule, 2)) OR s.sender_domain = r.rule",
)
def _policy(s):
    rules = s.sparkSession.createDataFrame([("building3.example",), ("*.example",), ("example",), ("*.building3.example",)], "rule string")
    return op.policy_matches(s.select(F.col("sender_domain").alias("host")).distinct(), rules)


@query(
    "scene_emails", "fx_sessions", "fx_verdicts",
    sql=f"""WITH scenes AS (SELECT sender_domain AS actor, MIN(started_at) AS lo, MIN(started_at) + INTERVAL 300 DAYS AS hi FROM fx_sessions GROUP BY 1 HAVING COUNT(*) % 3 = 0)
      SELECT c.actor, s.session_id, s.started_at, v.level FROM scenes c JOIN fx_sessions s ON s.sender_domain = c.actor AND s.started_at BETWEEN c.lo AND c.hi LEFT JOIN (SELECT session_id, {LEVEL_SQL} AS level FROM fx_verdicts) v ON v.session_id = s.session_id""",
)
def _scene_emails(s, v):
    scenes = s.groupBy(F.col("sender_domain").alias("actor")).agg(F.min("started_at").alias("lo"), F.count(F.lit(1)).alias("n")).filter("n % 3 = 0").select("actor", "lo", (F.col("lo") + F.expr("INTERVAL 300 DAYS")).alias("hi"))
    inside = s.join(scenes, (F.col("sender_domain") == F.col("actor")) & F.col("started_at").between(F.col("lo"), F.col("hi")))
    return op.with_verdict(inside.select("actor", "session_id", "started_at"), v)


@query(
    "sender_false_positives", "fx_sessions", "labels",
    sql="SELECT s.sender_domain, COUNT(*) AS n FROM labels l JOIN fx_sessions s ON s.session_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0 GROUP BY 1",
)
def _false_positives(s, labels):
    return labels.filter("quality = 1 AND toxic = 0").join(s.select("session_id", "sender_domain"), F.col("doc_id") == F.col("session_id")).groupBy("sender_domain").agg(F.count(F.lit(1)).alias("n"))


#: A text of which upper() makes the same capitals everywhere, also where one letter has several, as the German sharp s.
CAPITALS_SQL = reduce(lambda text, c: f"replace({text}, '{c}', '{c.upper()}')", [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1], "text")


@query(
    "message_dedup", "conversations",
    sql=f"""WITH m AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN ' <' || text || '>' WHEN 1 THEN upper({CAPITALS_SQL}) WHEN 2 THEN NULL ELSE text || '> ' END AS id FROM conversations), k AS (SELECT *, lower(trim(regexp_replace(regexp_replace(trim(id), '^<', ''), '>$', ''))) AS key FROM m)
      SELECT role, COUNT(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id, turn) AS n FROM k) WHERE n = 1 OR key IS NULL OR key = '' GROUP BY 1""",
)
def _message_dedup(c):
    turn = F.col("turn") % 4
    ids = F.when(turn == 0, F.concat(F.lit(" <"), "text", F.lit(">"))).when(turn == 1, F.upper("text")).when(turn == 3, F.concat("text", F.lit("> ")))
    return op.first_of_message(c.withColumn("message_id", ids), "message_id", "conv_id", "turn").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


IOC_ROWS = "SELECT indicator, CASE WHEN seq % 3 = 0 THEN 'url' ELSE ioc_type END AS ioc_type, CASE WHEN seq % 7 = 0 THEN 'admin_clean' ELSE source END AS source, verdict, confidence, CASE WHEN seq % 4 = 0 THEN '' ELSE 'a' || seq % 5 END AS attack_type, seq FROM fx_iocs"


@query(
    "upsert_iocs", "fx_iocs",
    sql=f"""WITH r AS ({IOC_ROWS}), b AS (SELECT *, seq % 2 AS fresh, CAST(source = 'admin_clean' AS INT) AS owner FROM r)
      SELECT ioc_type, indicator, SUM(1 + seq % 3) AS hit_count, arg_max(verdict, (owner, fresh, seq)) AS verdict, arg_max(confidence, (owner, fresh, seq)) AS confidence, arg_max(source, (owner, fresh, seq)) AS source,
        arg_max(attack_type, (fresh, seq)) FILTER (WHERE attack_type <> '') AS attack_type FROM b GROUP BY 1, 2""",
)
def _upsert_iocs(i):
    seq = F.col("seq")
    kind, source = F.when(seq % 3 == 0, "url").otherwise(F.col("ioc_type")), F.when(seq % 7 == 0, "admin_clean").otherwise(F.col("source"))
    attack = F.when(seq % 4 == 0, "").otherwise(F.concat(F.lit("a"), (seq % 5).cast("string")))
    rows = i.select(
        "indicator", kind.alias("ioc_type"), source.alias("source"), "verdict", "confidence", attack.alias("attack_type"), (1 + seq % 3).alias("hit_count"),
        *(seq.alias(c) for c in ("first_seen", "last_seen", "expires_at")),
    )
    merged = indicators.upserted(rows.filter("last_seen % 2 = 0"), rows.filter("last_seen % 2 = 1"))
    return merged.select("ioc_type", "indicator", "hit_count", "verdict", "confidence", "source", "attack_type")


@query(
    "upsert_sessions", "fx_incidents",
    sql="""SELECT user_id, arg_max(severity, incident_id) AS status, arg_max(incident_type, incident_id) FILTER (WHERE severity <> 'low') AS subject,
      arg_max('b' || incident_id, incident_id) FILTER (WHERE incident_id % 3 = 0) AS body, COUNT(*) AS versions FROM fx_incidents GROUP BY 1""",
)
def _upsert_sessions(i):
    body = F.when(F.col("incident_id") % 3 == 0, F.concat(F.lit("b"), F.col("incident_id"))).when(F.col("incident_id") % 3 == 1, "")
    versions = i.select("user_id", "incident_id", F.col("severity").alias("status"), F.when(F.col("severity") != "low", F.col("incident_type")).alias("subject"), body.alias("body"))
    return sessions.merged(versions, ("status",), ("subject",), ("body",), "user_id", ("incident_id",))


@query(
    "derive_session_columns", "fx_recipients",
    sql="SELECT session_id, recipient, lower(split_part(recipient, '@', 2)) AS sender_domain, CASE WHEN session_id % 2 = 0 THEN 'm' || session_id ELSE 'h' || session_id END AS message_id FROM fx_recipients",
)
def _derive(r):
    header = F.struct(F.lit("Message-ID").alias("name"), F.concat(F.lit("h"), F.col("session_id")).alias("value"))
    rows = r.select("session_id", F.col("recipient").alias("mail_from"), F.lit("s\x00").alias("subject"), F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("m"), F.col("session_id"))).alias("message_id"), F.struct(F.array(header).alias("headers")).alias("content"))
    return sessions.derived(rows).filter("subject = 's'").select("session_id", F.col("mail_from").alias("recipient"), "sender_domain", "message_id")


@query(
    "retention", "fx_sessions", "fx_verdicts", "fx_iocs", "fx_risk",
    sql="""WITH n AS (SELECT MAX(started_at) AS now FROM fx_sessions), kept AS (SELECT session_id FROM fx_sessions, n WHERE started_at >= now - INTERVAL 365 DAYS),
      i AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE now + (seq % 9 - 4) * INTERVAL 1 DAY END AS e, now FROM fx_iocs, n),
      x AS (SELECT seq, now, CASE WHEN seq % 5 = 0 THEN greatest(COALESCE(e, now), now) + INTERVAL 30 DAYS ELSE e END AS e FROM i),
      st AS (SELECT entity_key, MAX(ts) AS last_seen, MAX(risk) AS level FROM fx_risk GROUP BY 1), sn AS (SELECT MAX(ts) AS now FROM fx_risk)
      SELECT 'sessions' AS kind, COUNT(*) AS n FROM kept UNION ALL SELECT 'verdicts', COUNT(*) FROM fx_verdicts WHERE session_id IN (SELECT session_id FROM kept)
      UNION ALL SELECT 'indicators', COUNT(*) FROM x WHERE e IS NULL OR e > now UNION ALL SELECT 'extended', COUNT(*) FROM x WHERE e >= now + INTERVAL 30 DAYS
      UNION ALL SELECT 'state', COUNT(*) FROM st, sn WHERE last_seen >= now - INTERVAL 1 DAYS OR level > 0.9
      UNION ALL SELECT 'quarantine', COUNT(*) FROM (SELECT started_at, session_id, now FROM fx_sessions, n) WHERE session_id % 3 = 0 OR started_at >= now - INTERVAL 30 DAYS""",
)
def _retention(s, v, i, r):
    now = s.agg(F.max("started_at").alias("t")).scalar()
    kept = keep.recent(s, "started_at", now, 365)
    seq = F.col("seq")
    shift = F.make_dt_interval((seq % 9 - 4).cast("int"))
    iocs = keep.extended(i.select("seq", F.when(seq % 3 != 0, now + shift).alias("expires_at")), seq % 5 == 0, now, 30)
    state = r.groupBy("entity_key").agg(F.max("ts").alias("last_seen"), F.max("risk").alias("level"))
    quarantine = s.select(F.when(F.col("session_id") % 3 == 0, "held").otherwise("released").alias("status"), F.col("started_at").alias("settled_at"))
    parts = {
        "sessions": kept, "verdicts": keep.of_kept(v, kept, "session_id"), "indicators": keep.live_indicators(iocs, now), "extended": iocs.filter(F.col("expires_at") >= now + F.make_dt_interval(F.lit(30))),
        "state": keep.live_state(state, r.agg(F.max("ts").alias("t")).scalar(), 1, 0.9), "quarantine": keep.held(quarantine, now, 30),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, counts)
