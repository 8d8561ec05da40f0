"""Webmail queries: documents stand for the bodies of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.operators import dlp, webmail
from courierlens.plans.registry import query
from courierlens.plans.text import DLP_SQL, LEVEL_SQL

SESSIONS_SQL = "w AS (SELECT doc_id AS session_id, 'u' || doc_id % 3 || '+t@A.example' AS sender, 'U' || doc_id % 2 || '@a.example' AS r1, 'x@n' || doc_id % 4 || '.example' AS r2, CASE WHEN doc_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE doc_id % 3 WHEN 0 THEN '/Draft/1' WHEN 1 THEN '/compose?save=1' ELSE '/send' END AS uri FROM fx_dlp)"
FOUND_SQL = f"{DLP_SQL}, {SESSIONS_SQL}, c2 AS (SELECT doc_id, class, {LEVEL_SQL} AS level FROM f WHERE len(v) >= least), p AS (SELECT doc_id, COUNT(DISTINCT class) AS n, COUNT(DISTINCT class) FILTER (WHERE class <> 'email_address') AS others, MAX(level) AS level FROM c2 GROUP BY 1), j AS (SELECT w.*, COALESCE(p.n, 0) AS n, COALESCE(p.others, 0) AS others, COALESCE(p.level, 0) AS level FROM w LEFT JOIN p ON p.doc_id = w.session_id)"


def _found(d):
    i = F.col("doc_id")
    text_of = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    sessions = d.select(
        i.alias("session_id"), text_of("u", (i % 3).cast("string"), "+t@A.example").alias("sender"),
        F.array(text_of("U", (i % 2).cast("string"), "@a.example"), text_of("x@n", (i % 4).cast("string"), ".example")).alias("recipients"),
        F.when(i % 2 == 0, "POST").otherwise("GET").alias("method"), F.when(i % 3 == 0, "/Draft/1").when(i % 3 == 1, "/compose?save=1").otherwise("/send").alias("uri"),
    )
    return webmail.with_findings(sessions, dlp.dlp_findings(d).withColumnRenamed("doc_id", "session_id"))


@query("draft_abuse", "fx_dlp", sql=f"{FOUND_SQL} SELECT session_id, uri, CAST(n AS INT) AS n_classes FROM j WHERE method = 'POST' AND uri <> '/send' AND others > 0")
def _draft(d):
    return webmail.draft_abuse(_found(d)).select("session_id", "uri", F.size("classes").alias("n_classes"))


@query("self_send", "fx_dlp", sql=f"{FOUND_SQL} SELECT session_id, CAST(n AS INT) AS n_classes FROM j WHERE n > 0 AND replace(lower(sender), '+t', '') = lower(r1)")
def _self_send(d):
    return webmail.self_send(_found(d)).select("session_id", F.size("classes").alias("n_classes"))


@query("outbound_dlp", "fx_dlp", sql=f"{FOUND_SQL} SELECT CASE WHEN level >= 4 THEN 'block' WHEN level >= 3 THEN 'quarantine' ELSE 'allow' END AS action, COUNT(*) AS n FROM j WHERE r2 NOT LIKE '%@n1.example' GROUP BY 1")
def _outbound(d):
    return webmail.outbound(_found(d), ("a.example", "n1.example")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_transit", "part",
    sql="""WITH u AS (SELECT p_partkey, ([ 'exe', 'txt', 'sql', 'zip'])[p_partkey % 4 + 1] AS ext, CASE WHEN p_partkey % 5 = 0 THEN 'executable' WHEN p_partkey % 7 = 0 THEN 'zip_encrypted' ELSE 'text' END AS det, CASE WHEN p_partkey % 3 = 0 THEN 'text' END AS dec FROM part),
      f AS (SELECT ext = 'exe' OR det = 'executable' AS e, COALESCE(det <> dec, false) AS m, det = 'zip_encrypted' AS c, ext = 'sql' AS s FROM u)
      SELECT severity, COUNT(*) AS n FROM (SELECT CASE WHEN e AND m THEN 'critical' WHEN e OR c THEN 'high' WHEN s OR m THEN 'medium' END AS severity FROM f) WHERE severity IS NOT NULL GROUP BY 1""",
)
def _file_transit(p):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, ("exe", "txt", "sql", "zip"))), (k % 4 + 1).cast("int"))
    uploads = p.select(F.concat(F.lit("file."), ext).alias("filename"), F.when(k % 3 == 0, "text").alias("declared_type"), F.when(k % 5 == 0, "executable").when(k % 7 == 0, "zip_encrypted").otherwise("text").alias("detected_type"))
    return webmail.file_transit(uploads).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
