"""Intake, relay and rule queries, over rows that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.operators import relational as op
from courierlens.plans.registry import query
from courierlens.plans.relational import LEVEL_SQL
from courierlens.schemas import LEVEL_RANK, rank, threat_level
from courierlens.sources import indicators, sessions


@query(
    "ingest_sessions", "fx_sessions",
    sql="SELECT CASE WHEN session_id % 10 = 0 OR session_id % 7 = 0 THEN 'dead' ELSE sender_domain END AS kind, COUNT(*) AS n, CAST(SUM(CASE WHEN session_id % 10 = 0 OR session_id % 7 = 0 THEN 0 ELSE total_bytes END) AS BIGINT) AS bytes FROM fx_sessions GROUP BY 1",
)
def _ingest(s):
    whole = F.to_json(F.struct(F.when(F.col("session_id") % 7 != 0, F.col("session_id").cast("string")).alias("id"), "status", "total_bytes", F.concat("sender_local", F.lit("@"), F.upper("sender_domain")).alias("mail_from"), "subject"))
    raw = s.select(F.when(F.col("session_id") % 10 == 0, F.substr(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole).alias("value"))
    good, dead = sessions.decoded(raw)
    kinds = sessions.derived(good).select(F.col("sender_domain").alias("kind"), "total_bytes").unionByName(dead.select(F.lit("dead").alias("kind"), F.lit(0).cast("long").alias("total_bytes")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"))


@query(
    "import_iocs_csv", "fx_iocs",
    sql="SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN seq % 9 = 0 THEN 'no indicator' WHEN seq % 5 = 0 THEN 'unknown type' WHEN seq % 4 = 0 THEN 'confidence outside 0 to 1' ELSE 'imported' END AS outcome FROM fx_iocs) GROUP BY 1",
)
def _import(i):
    rows = i.select(F.when(F.col("seq") % 9 != 0, F.col("indicator")).alias("indicator"), F.when(F.col("seq") % 5 != 0, F.col("ioc_type")).alias("ioc_type"), "verdict", F.when(F.col("seq") % 4 == 0, "1.5").otherwise(F.col("confidence").cast("string")).alias("confidence"), "source", F.lit(None).cast("string").alias("attack_type"))
    good, bad = indicators.validated(rows)
    return good.select(F.lit("imported").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_iocs_csv", "fx_iocs",
    sql="""SELECT seq, '"' || indicator || '","' || ioc_type || '","' || replace(CASE WHEN seq % 3 = 0 THEN 'a "b", c' ELSE source END, '"', '""') || '","' || verdict || '","' || seq || '"' AS line FROM fx_iocs WHERE verdict IN ('malicious', 'suspicious')""",
)
def _export(i):
    rows = i.select("indicator", "ioc_type", F.when(F.col("seq") % 3 == 0, 'a "b", c').otherwise(F.col("source")).alias("source"), "verdict", "seq")
    return indicators.exported(rows, ("malicious", "suspicious")).select("seq", "line")


def _relays(e):
    """Events as relay hops: from one of 40 addresses to another."""
    return e.select(F.col("event_id").alias("session_id"), (F.col("user_id") % 40).alias("client_ip"), (F.col("event_id") % 40).alias("server_ip"), F.col("event_type").alias("mail_from"), F.array((F.col("user_id") % 3).cast("string")).alias("recipients"), F.col("ts").alias("started_at"))


RELAY_SQL = "SELECT event_id AS session_id, user_id % 40 AS client_ip, event_id % 40 AS server_ip, event_type AS mail_from, user_id % 3 AS r, ts AS t FROM events"


@query("downstream_hops", "events", sql=f"WITH h AS ({RELAY_SQL}) SELECT a.session_id, b.session_id AS next_id FROM h a JOIN h b ON a.server_ip = b.client_ip AND a.mail_from = b.mail_from AND a.r = b.r AND b.t >= a.t AND b.t <= a.t + INTERVAL 3600 SECONDS AND a.session_id <> b.session_id")
def _hops(e):
    return op.hops(_relays(e), 3600).select("session_id", "next_id")


@query(
    "relay_gap_report", "events",
    sql="""WITH f AS (SELECT event_id % 500 AS m, event_type AS mail_from, user_id % 3 AS r, ts AS t FROM events WHERE event_id % 2 = 0), s AS (SELECT event_id AS session_id, event_id % 500 AS m, event_type AS mail_from, user_id % 3 AS r, ts AS t FROM events WHERE event_id % 2 = 1),
      g AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.m = s.m AND f.t BETWEEN s.t - INTERVAL 600 SECONDS AND s.t + INTERVAL 600 SECONDS))
      SELECT gap, COUNT(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.mail_from = g.mail_from AND f.r = g.r AND f.t BETWEEN g.t - INTERVAL 600 SECONDS AND g.t + INTERVAL 600 SECONDS) THEN 'same_envelope_other_id' ELSE 'none' END AS gap FROM g) GROUP BY 1""",
)
def _gaps(e):
    rows = _relays(e).withColumn("message_id", (F.col("session_id") % 500).cast("string"))
    return op.relay_gaps(rows.filter("session_id % 2 = 1"), rows.filter("session_id % 2 = 0"), 600).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query(
    "disposition_matches", "fx_verdicts",
    sql=f"""WITH v AS (SELECT session_id, {LEVEL_SQL} AS level, session_id % 3 AS c, session_id % 2 AS d FROM fx_verdicts) SELECT action, COUNT(*) AS n FROM (
      SELECT 'quarantine' AS action FROM v WHERE level IN ('high', 'critical') AND c = 1 UNION ALL SELECT 'log' FROM v WHERE d = 0 UNION ALL SELECT 'block' FROM v WHERE level = 'critical') GROUP BY 1""",
)
def _disposition(v):
    level = rank(threat_level(F.col("risk")), LEVEL_RANK)
    rows = v.select("session_id", level.alias("level_rank"), F.array(F.concat(F.lit("c"), (F.col("session_id") % 3).cast("string"))).alias("categories"), F.array(F.lit("m")).alias("modules"), F.when(F.col("session_id") % 2 == 0, "outbound").otherwise("inbound").alias("direction"))
    rules = v.sparkSession.createDataFrame([(1, 10, 3, ["c1"], [], [], "quarantine"), (2, 20, 0, [], ["m"], ["outbound"], "log"), (3, 30, 4, [], [], [], "block"), (4, 40, 0, [], ["other"], [], "never")], "rule_id int, priority int, min_rank int, categories array<string>, modules array<string>, directions array<string>, action string")
    return op.disposition(rows, rules).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "terminal_hop", "events",
    sql=f"""WITH RECURSIVE h AS ({RELAY_SQL}),
      n AS (SELECT a.session_id, first(b.session_id ORDER BY b.t, b.session_id) AS next_id FROM h a JOIN h b ON a.server_ip = b.client_ip AND a.mail_from = b.mail_from AND a.r = b.r
        AND b.t >= a.t AND b.t <= a.t + INTERVAL 3600 SECONDS AND (b.t > a.t OR b.session_id > a.session_id) GROUP BY 1),
      walk AS (SELECT session_id, session_id AS place FROM h UNION ALL SELECT walk.session_id, n.next_id FROM walk JOIN n ON n.session_id = walk.place)
      SELECT session_id, place AS terminal_id FROM walk WHERE place NOT IN (SELECT session_id FROM n)""",
)
def _terminal(e):
    return op.terminal_hop(_relays(e), 3600)


@query("external_ip", "documents", sql="SELECT doc_id, ip FROM (SELECT doc_id, list_filter(regexp_extract_all(COALESCE(text, ''), '(?:^|[^0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})(?:[^0-9.]|$)', 1), lambda x: NOT regexp_matches(x, '^(10[.]|127[.]|192[.]168[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|0[.])'))[1] AS ip FROM documents) WHERE ip IS NOT NULL")
def _external_ip(d):
    headers = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?:^|[^0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})(?:[^0-9.]|$)"), 1), lambda x: F.concat(F.lit("from ["), x, F.lit("]")))
    return d.select("doc_id", op.external_ip(headers).alias("ip")).filter("ip is not null")
