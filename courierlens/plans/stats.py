"""Aggregate queries over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.operators import campaigns
from courierlens.plans.registry import query
from courierlens.plans.relational import LEVEL_SQL
from courierlens.schemas import threat_level


@query(
    "traffic_stats", "fx_sessions",
    sql="SELECT COUNT(*) AS sessions, COUNT(*) FILTER (WHERE status = 'Active') AS active, CAST(SUM(total_bytes) AS BIGINT) AS bytes, COUNT(*) FILTER (WHERE subject LIKE '1%') AS urgent, COUNT(*) FILTER (WHERE subject LIKE '5%') AS low FROM fx_sessions",
)
def _traffic(s):
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("status") == "Active").alias("active"), F.sum("total_bytes").alias("bytes"), F.count_if(F.col("subject").startswith("1")).alias("urgent"), F.count_if(F.col("subject").startswith("5")).alias("low"))


@query(
    "login_hourly", "fx_incidents",
    sql="SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"COUNT(*) FILTER (WHERE incident_type = '{t}') AS {t}" for t in ("click", "purchase", "view")) + ", COUNT(*) AS total FROM fx_incidents WHERE ts >= (SELECT MAX(ts) - INTERVAL 24 HOURS FROM fx_incidents) GROUP BY 1",
)
def _login_hourly(i):
    since = i.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("t")).scalar()
    kinds = ("click", "purchase", "view")  # given, so that no job is needed to find them
    return i.filter(F.col("ts") >= since).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*(F.count_if(F.col("incident_type") == t).alias(t) for t in kinds), F.count(F.lit(1)).alias("total"))


@query(
    "login_totals", "fx_incidents",
    sql="SELECT COUNT(DISTINCT client_ip_n) AS ips, COUNT(*) FILTER (WHERE severity <> 'critical') AS ok, COUNT(*) FILTER (WHERE severity = 'critical') AS failed FROM fx_incidents",
)
def _login_totals(i):
    return i.agg(F.count_distinct("client_ip_n").alias("ips"), F.count_if(F.col("severity") != "critical").alias("ok"), F.count_if(F.col("severity") == "critical").alias("failed"))


@query(
    "security_stats", "fx_verdicts", "fx_iocs",
    sql=f"WITH v AS (SELECT *, {LEVEL_SQL} AS level FROM fx_verdicts) SELECT level, COUNT(*) AS n, COUNT(*) FILTER (WHERE level IN ('high', 'critical') AND created_at >= (SELECT MAX(created_at) - INTERVAL 24 HOURS FROM v)) AS high_24h, (SELECT COUNT(*) FROM fx_iocs) AS iocs FROM v GROUP BY 1",
)
def _security_stats(v, i):
    since = v.agg((F.max("created_at") - F.expr("INTERVAL 24 HOURS")).alias("t")).scalar()
    iocs = i.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = v.withColumn("level", threat_level(F.col("risk")))
    recent = F.col("level").isin("high", "critical") & (F.col("created_at") >= since)
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("high_24h")).withColumn("iocs", iocs)


@query(
    "data_security_stats", "fx_incidents",
    sql="SELECT incident_type, COUNT(*) AS n, " + ", ".join(f"COUNT(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("low", "medium", "high", "critical")) + ", COUNT(*) FILTER (WHERE severity IN ('high', 'critical') AND ts >= (SELECT MAX(ts) - INTERVAL 24 HOURS FROM fx_incidents)) AS high_24h FROM fx_incidents GROUP BY 1",
)
def _data_security_stats(i):
    since = i.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("t")).scalar()
    by = [F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")]
    return i.groupBy("incident_type").agg(F.count(F.lit(1)).alias("n"), *by, F.count_if(F.col("severity").isin("high", "critical") & (F.col("ts") >= since)).alias("high_24h"))


@query(
    "hourly_buckets", "fx_incidents",
    sql="SELECT strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:00') AS hour, COUNT(*) AS incidents, COUNT(DISTINCT user_id) AS users FROM fx_incidents GROUP BY 1",
)
def _hourly(i):
    return i.groupBy(F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:00").alias("hour")).agg(F.count(F.lit(1)).alias("incidents"), F.count_distinct("user_id").alias("users"))


@query(
    "feedback_stats", "fx_module_results",
    sql="SELECT CASE WHEN module_n = 7 THEN 'overall' ELSE CAST(module_n AS VARCHAR) END AS module, COUNT(*) AS total, COUNT(*) FILTER (WHERE score < 0.3) AS false_positives FROM fx_module_results GROUP BY 1",
)
def _feedback(m):
    module = F.coalesce(F.when(F.col("module_n") != 7, F.col("module_n").cast("string")), F.lit("overall"))
    return m.groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") < 0.3).alias("false_positives"))


@query(
    "training_label_counts", "labels",
    sql="SELECT quality + 2 * toxic AS label, COUNT(*) AS n, (SELECT COUNT(*) FROM labels) AS total, (SELECT COUNT(*) FROM labels) >= 30 AS trainable FROM labels GROUP BY 1",
)
def _label_counts(x):
    total = x.agg(F.count(F.lit(1)).alias("n")).scalar()
    return x.groupBy((F.col("quality") + 2 * F.col("toxic")).alias("label")).agg(F.count(F.lit(1)).alias("n")).select("label", "n", total.alias("total"), (total >= 30).alias("trainable"))


@query(
    "internal_domains", "fx_sessions", "fx_recipients",
    sql="WITH d AS (SELECT r.rcpt_domain, COUNT(DISTINCT s.sender_domain) AS senders FROM fx_recipients r JOIN fx_sessions s ON r.session_id = s.session_id WHERE s.started_at >= (SELECT MAX(started_at) - INTERVAL 30 DAYS FROM fx_sessions) GROUP BY 1) SELECT * FROM d WHERE senders >= 5 AND rcpt_domain <> 'n5.example' ORDER BY senders DESC, rcpt_domain LIMIT 20",
)
def _internal_domains(s, r):
    since = s.agg((F.max("started_at") - F.expr("INTERVAL 30 DAYS")).alias("t")).scalar()
    pairs = s.filter(F.col("started_at") >= since).join(r, "session_id")
    counts = pairs.filter("rcpt_domain <> 'n5.example'").groupBy("rcpt_domain").agg(F.count_distinct("sender_domain").alias("senders"))
    return counts.filter("senders >= 5").orderBy(F.desc("senders"), "rcpt_domain").limit(20)


@query(
    "module_metrics", "fx_module_results",
    sql="SELECT module_n, COUNT(*) AS runs, AVG(duration_ms) AS avg_ms, MIN(duration_ms) AS min_ms, MAX(duration_ms) AS max_ms, AVG(CASE WHEN score < 0.9 THEN 1.0 ELSE 0.0 END) AS success_rate, COUNT(*) FILTER (WHERE duration_ms >= 45) AS timeouts FROM fx_module_results GROUP BY 1",
)
def _module_metrics(m):
    return m.groupBy("module_n").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.avg(F.when(F.col("score") < 0.9, 1.0).otherwise(0.0)).alias("success_rate"), F.count_if(F.col("duration_ms") >= 45).alias("timeouts"))


@query(
    "bulk_mailing", "fx_sessions", "fx_recipients",
    sql="""SELECT s.sender_domain, COUNT(DISTINCT s.session_id) AS mails, COUNT(DISTINCT r.recipient) AS recipients, COUNT(DISTINCT s.started_at) AS distinct_starts, list_slice(list_sort(list(DISTINCT s.subject)), 1, 3) AS subjects,
      CASE WHEN COUNT(DISTINCT s.session_id) >= 50 THEN 'critical' WHEN COUNT(DISTINCT s.session_id) >= 20 THEN 'high' WHEN COUNT(DISTINCT s.session_id) >= 10 THEN 'medium' ELSE 'low' END AS severity
      FROM fx_sessions s JOIN fx_recipients r ON s.session_id = r.session_id WHERE s.started_at >= (SELECT MAX(started_at) - INTERVAL 90 DAYS FROM fx_sessions) GROUP BY 1 HAVING COUNT(DISTINCT s.session_id) >= 5 AND COUNT(DISTINCT r.recipient) >= 3""",
)
def _bulk(s, r):
    since = s.agg((F.max("started_at") - F.expr("INTERVAL 90 DAYS")).alias("t")).scalar()
    return campaigns.bulk_mailing(s.filter(F.col("started_at") >= since), r)


@query(
    "bounce_harvest", "fx_sessions", "fx_recipients",
    sql="""SELECT r.rcpt_domain, COUNT(DISTINCT s.session_id) AS bounces, COUNT(DISTINCT r.recipient) AS targets, list_slice(list_sort(list(DISTINCT r.recipient)), 1, 10) AS samples
      FROM fx_sessions s JOIN fx_recipients r ON s.session_id = r.session_id WHERE s.status = 'Timeout' OR s.subject LIKE '5%' GROUP BY 1 HAVING COUNT(DISTINCT s.session_id) >= 10 AND COUNT(DISTINCT r.recipient) >= 3""",
)
def _bounce(s, r):
    return campaigns.bounce_harvest(s.filter((F.col("status") == "Timeout") | F.col("subject").startswith("5")), r)


@query(
    "external_sender_stats", "fx_sessions", "fx_recipients",
    sql="""SELECT s.sender_domain, COUNT(DISTINCT s.session_id) AS mails, COUNT(DISTINCT r.recipient) AS recipients, MIN(s.started_at) AS first_seen, MAX(s.started_at) AS last_seen, list_slice(list_sort(list(DISTINCT s.subject)), 1, 5) AS subjects, list_slice(list_sort(list(DISTINCT r.recipient)), 1, 5) AS recipient_samples
      FROM fx_sessions s LEFT JOIN fx_recipients r ON s.session_id = r.session_id WHERE s.sender_domain <> 'building3.example' GROUP BY 1 HAVING COUNT(DISTINCT s.session_id) >= 3""",
)
def _external(s, r):
    return campaigns.external_senders(s, r, s.sparkSession.createDataFrame([("building3.example",)], "domain string"))


WORST_SQL = "CASE verdict WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END"


@query(
    "ioc_intel_fusion", "fx_iocs",
    sql=f"SELECT indicator, arg_max(verdict, {WORST_SQL}) AS verdict, SUM(confidence * CASE WHEN verdict = 'malicious' THEN 2 ELSE 1 END) / SUM(CASE WHEN verdict = 'malicious' THEN 2 ELSE 1 END) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM fx_iocs GROUP BY 1",
)
def _fusion(i):
    worst = F.when(F.col("verdict") == "malicious", 2).when(F.col("verdict") == "suspicious", 1).otherwise(0)
    weight = F.when(F.col("verdict") == "malicious", 2).otherwise(1)
    return i.groupBy("indicator").agg(F.max_by("verdict", worst).alias("verdict"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(
    "feedback_ioc_decay", "fx_iocs", "fx_recipients", "labels",
    sql="""WITH f AS (SELECT r.rcpt_domain, COUNT(DISTINCT l.doc_id) AS n FROM labels l JOIN fx_recipients r ON r.session_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0 GROUP BY 1)
      SELECT i.seq, i.indicator, GREATEST(0.0, i.confidence - 0.2 * COALESCE(f.n, 0)) AS confidence FROM fx_iocs i LEFT JOIN f ON f.rcpt_domain = i.indicator""",
)
def _decay(i, r, labels):
    legitimate = labels.filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("session_id"))
    hits = r.join(legitimate, "session_id").groupBy(F.col("rcpt_domain").alias("indicator")).agg(F.count_distinct("session_id").alias("hits"))
    return i.join(hits, "indicator", "left").select("seq", "indicator", F.greatest(F.lit(0.0), F.col("confidence") - 0.2 * F.coalesce("hits", F.lit(0))).alias("confidence"))
