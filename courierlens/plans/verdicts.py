"""Composed verdicts over the module findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import fusion as fusion_op
from courierlens.operators import scenarios as sc
from courierlens.operators import verdicts as op
from courierlens.plans.fusion import engine_lists, _reduce_sql
from courierlens.plans.registry import query

PATTERNS = {
    "gateway_banner": ("[suspected spam]", "caution external"),
    "notice_banner": ("came from outside", "caution external"),
    "dsn": ("undeliverable", "delivery status"),
    "auto_reply": ("automatic reply", "out of office"),
}


def _results(m):
    return m.withColumn("categories", F.array("category")).withColumnRenamed("threat", "rank")


CAP_SQL, SCALE_SQL, THREAT_SQL = ("CASE cluster " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in op.CLUSTERS.items()) + " END" for i in range(3))
MAPPING_SQL = ", ".join(str(r) for r in sc.mapping())
OWN_SQL = ", ".join(repr(m) for m in sorted({r[0] for r in sc.mapping() if r[0]} | set(sc.UNMAPPED)))
CLUSTER_SQL = f"""WITH rules AS (SELECT * FROM (VALUES {MAPPING_SQL}) t(module, category, cluster, family, scale)),
  f AS (SELECT s.session_id, COALESCE(x.cluster, y.cluster) AS cluster, COALESCE(x.family, y.family) AS family, s.module, LEAST(1.0, LEAST(1.0, s.score * s.weight) * COALESCE(x.scale, y.scale)) AS s, LEAST(1.0, s.confidence) AS confidence
    FROM (SELECT *, CASE WHEN module IN ({OWN_SQL}) THEN module ELSE '' END AS m FROM fx_signals WHERE threat > 0) s
    LEFT JOIN rules x ON x.module = s.m AND x.category = s.category AND x.category <> '' LEFT JOIN rules y ON y.module = s.m AND y.category = '' WHERE COALESCE(x.cluster, y.cluster) IS NOT NULL),
  a AS (SELECT session_id, cluster, family, MAX(s) AS s FROM f GROUP BY 1, 2, 3), b AS (SELECT session_id, cluster, 1 - product(1 - s) AS s, COUNT(*) AS families FROM a GROUP BY 1, 2),
  c AS (SELECT session_id, cluster, MAX(confidence) AS c, COUNT(DISTINCT module) AS modules FROM f GROUP BY 1, 2),
  d AS (SELECT b.session_id, b.cluster, CAST(LEAST(s + 0.04 * LEAST(3, families - 1), {CAP_SQL.replace('cluster', 'b.cluster', 1)}) AS DOUBLE) AS score, CAST(LEAST(0.95, GREATEST(0.20, c * {SCALE_SQL.replace('cluster', 'b.cluster', 1)} + 0.03 * LEAST(3, modules - 1))) AS DOUBLE) AS confidence FROM b JOIN c ON b.session_id = c.session_id AND b.cluster = c.cluster)"""
_has = lambda column, names: f"list_has_any({column}, [{', '.join(map(repr, names))}])"
_says = lambda kind, *columns: "(" + " OR ".join(f"contains({c}, '{p}')" for c in columns for p in PATTERNS[kind]) + ")"
FLAGS_SQL = f"""cats AS (SELECT session_id, list(DISTINCT category) AS categories, COALESCE(list(DISTINCT category) FILTER (WHERE module = 'attach_content'), []) AS attach_content, COALESCE(list(DISTINCT category) FILTER (WHERE module = 'attach_scan'), []) AS attach_scan,
    MAX(threat) FILTER (WHERE module = 'attach_content') AS content_rank, bool_and(module = 'semantic_scan') AS semantic FROM fx_signals WHERE threat > 0 GROUP BY 1),
  m AS (SELECT mail.session_id, lower(COALESCE(subject, '')) AS subject, lower(COALESCE(body, '')) AS body, lower(COALESCE(sender, '')) AS sender, auto_submitted, LEAST(1.0, GREATEST(0.0, COALESCE(alignment, 0.0))) AS alignment,
    COALESCE(categories, []) AS categories, COALESCE(attach_content, []) AS attach_content, COALESCE(attach_scan, []) AS attach_scan, COALESCE(content_rank, 0) AS content_rank, COALESCE(semantic, false) AS semantic,
    list_filter(list_transform(string_split(lower(COALESCE(body, '')), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM fx_mail mail LEFT JOIN cats ON cats.session_id = mail.session_id),
  n AS (SELECT *, semantic AND list_bool_and(list_transform(categories, lambda x: x IN ({', '.join(map(repr, sc.SEMANTIC_ONLY))}))) AS semantic_nlp_only_signal,
    len(lines) >= 4 AND 2 * len(list_filter(lines, lambda x: length(x) <= 48)) >= len(lines) AND (
      len(list_filter(lines, lambda x: contains(x, ':') AND length(trim(split_part(x, ':', 1))) BETWEEN 1 AND 24 AND length(trim(substr(x, instr(x, ':') + 1))) BETWEEN 1 AND 120 AND NOT regexp_full_match(trim(split_part(x, ':', 1)), '[0-9]*'))) >= 2
      OR len(list_filter(lines, lambda x: regexp_matches(x, '[0-9][0-9]:[0-9][0-9]'))) >= 2) AS chat FROM m),
  flags AS (SELECT session_id, alignment, {_has('categories', ('gateway_pre_classified',))} AND {_says('gateway_banner', 'subject', 'body')} AS gateway_banner_polluted, {_has('categories', sc.NLP_ECHO)} AND {_says('notice_banner', 'subject', 'body')} AS notice_banner_polluted,
    auto_submitted OR regexp_matches(sender, '{'|'.join(sc.SYSTEM_SENDERS)}') OR {_says('dsn', 'subject')} AS dsn_like_system_mail, auto_submitted OR {_says('auto_reply', 'subject')} AS auto_reply_like, semantic_nlp_only_signal, semantic_nlp_only_signal AND chat AS transcript_like_structure,
    alignment >= 0.55 AS sender_alignment_verified, {', '.join(f"{_has('categories', v)} AS {k}" for k, v in sc.FLAG_CATEGORIES.items())}, {', '.join(f"{_has(m, v)} AS {k}" for k, (m, v) in sc.ATTACHMENT_CATEGORIES.items())}, content_rank >= 3 AS high_risk_attachment_content FROM n)"""
WIDE_SQL = "SELECT session_id, " + ", ".join(f"COALESCE(MAX(score) FILTER (WHERE cluster = '{c}'), 0.0) AS {k}" for k, c in sc.SHORT.items())


def _factor_sql(short: str) -> str:
    return " * ".join(["1.0", *(f"CASE WHEN {sc.spelled(c)} THEN {sc.spelled(v[short])} ELSE 1 END" for c, v in sc.SCALINGS if short in v)])


FACTORS_SQL = "CASE cluster " + " ".join(f"WHEN '{c}' THEN {_factor_sql(k)}" for k, c in sc.SHORT.items()) + " END"
SCALED_SQL = f"""w AS ({WIDE_SQL} FROM d GROUP BY 1),
  sd AS (SELECT d.session_id, d.cluster, CAST(GREATEST(0.0, LEAST(d.score * ({FACTORS_SQL}), {CAP_SQL})) AS DOUBLE) AS score, d.confidence FROM d JOIN w ON d.session_id = w.session_id JOIN flags ON flags.session_id = d.session_id)"""
FUSED_SQL = f"""e AS (SELECT *, LEAST(1.0, score * {THREAT_SQL}) AS t, GREATEST(0.05, LEAST(1.0, score * {THREAT_SQL}) * confidence) AS w FROM sd WHERE score >= 0.05),
  g AS (SELECT session_id, COUNT(*) AS n, MAX(confidence) AS c, COUNT(*) FILTER (WHERE score >= 0.15) AS agree, MAX(CASE WHEN score >= 0.55 AND confidence >= 0.70 THEN GREATEST(0.40, 0.8 * score) END) AS breaker,
    {{'b': SUM(t * confidence * w) / SUM(w), 'd': SUM((1 - t) * confidence * w) / SUM(w), 'u': SUM((1 - confidence) * w) / SUM(w), 'k': CAST(0.0 AS DOUBLE)}} AS m FROM e GROUP BY 1),
  h AS (SELECT *, {_reduce_sql("list_transform(range(n), lambda i: m)")} AS r FROM g),
  fused AS (SELECT session_id, LEAST(0.99, GREATEST(0.0, r.b + 0.3 * r.u, breaker, CASE WHEN agree >= 3 THEN LEAST(0.55, 0.35 + 0.05 * (agree - 2)) END)) AS risk, GREATEST(0.55, c) AS confidence, n AS n_clusters FROM h)"""
BOUNDS_SQL = f"""sw AS ({WIDE_SQL} FROM sd GROUP BY 1),
  fc AS (SELECT fused.session_id, fused.risk, GREATEST(0.0, {', '.join(f'CASE WHEN {sc.spelled(c)} THEN {v} ELSE 0.0 END' for c, v in sc.FLOORS)}) AS floor,
    LEAST(1.0, {', '.join(f'CASE WHEN {sc.spelled(c)} THEN {v} ELSE 1.0 END' for c, v in sc.CAPS)}) AS cap FROM fused JOIN sw ON sw.session_id = fused.session_id JOIN flags ON flags.session_id = fused.session_id),
  final AS (SELECT session_id, CAST(floor AS DOUBLE) AS floor, CAST(cap AS DOUBLE) AS cap, GREATEST(0.0, LEAST(0.99, cap, GREATEST(risk, floor))) AS risk FROM fc)"""


@query("evidence_clusters", "fx_signals", sql=f"{CLUSTER_SQL} SELECT session_id, cluster, R6(score, 6) AS score, R6(confidence, 6) AS confidence FROM d")
def _clusters(m):
    return op.clusters(sc.signals(_results(m))).select("session_id", "cluster", round6("score").alias("score"), round6("confidence").alias("confidence"))


@query("scenario_flags", "fx_mail", "fx_signals", sql=f"WITH {FLAGS_SQL} SELECT session_id, R6(alignment, 6) AS alignment, {', '.join(sc.FLAGS)} FROM flags")
def _flags(mail, m):
    return sc.scenario_flags(mail, _results(m), PATTERNS).select("session_id", round6("alignment").alias("alignment"), *sc.FLAGS)


def _scaled(mail, m):
    return sc.scaled(mail, _results(m), PATTERNS)


@query("cluster_context_scaling", "fx_mail", "fx_signals", sql=f"{CLUSTER_SQL}, {FLAGS_SQL}, {SCALED_SQL} SELECT session_id, cluster, R6(score, 6) AS score, R6(confidence, 6) AS confidence FROM sd")
def _scaling(mail, m):
    return _scaled(mail, m)[0].select("session_id", "cluster", round6("score").alias("score"), round6("confidence").alias("confidence"))


@query("cluster_floors_caps", "fx_mail", "fx_signals", sql=f"{CLUSTER_SQL}, {FLAGS_SQL}, {SCALED_SQL}, {FUSED_SQL}, {BOUNDS_SQL} SELECT session_id, R6(floor, 6) AS floor, R6(cap, 6) AS cap, R6(risk, 6) AS risk FROM final")
def _bounds(mail, m):
    per, flags = _scaled(mail, m)
    rows = sc.floors_and_caps(op.cluster_verdict(per).select("session_id", "risk"), per, flags)
    return rows.select("session_id", *(round6(c).alias(c) for c in ("floor", "cap", "risk")))


@query(
    "verdict_clustered", "fx_mail", "fx_signals",
    sql=f"""{CLUSTER_SQL}, {FLAGS_SQL}, {SCALED_SQL}, {FUSED_SQL}, {BOUNDS_SQL}
      SELECT s.session_id, R6(COALESCE(final.risk, 0.0), 6) AS risk, R6(COALESCE(fused.confidence, 1.0), 6) AS confidence, COALESCE(n_clusters, 0) AS n_clusters
      FROM (SELECT DISTINCT session_id FROM fx_signals) s LEFT JOIN fused ON fused.session_id = s.session_id LEFT JOIN final ON final.session_id = s.session_id""",
)
def _clustered(mail, m):
    return sc.clustered_verdict(mail, _results(m), PATTERNS).select("session_id", round6("risk").alias("risk"), round6("confidence").alias("confidence"), "n_clusters")


AROUND_SQL = f"""u AS (SELECT session_id, list(DISTINCT category) FILTER (WHERE threat > 0) AS c, COUNT(DISTINCT module) FILTER (WHERE threat > 0) AS n,
    COALESCE(bool_or(module IN ({', '.join(map(repr, op.HARD_MODULES))}) OR category IN ({', '.join(map(repr, op.HARD_CATEGORIES))})) FILTER (WHERE threat > 0), false) AS hard FROM fx_signals GROUP BY 1),
  around AS (SELECT u.session_id, COALESCE({' OR '.join(f"list_contains(c, '{a}') AND list_contains(c, '{b}')" for a, b in op.DANGEROUS_PAIRS)}, false) AS paired, CASE WHEN n <= 1 AND NOT hard THEN 1 - 0.4 * LEAST(1.0, GREATEST(0.0, COALESCE(m.alignment, 0.0))) ELSE 1.0 END AS discount
    FROM u LEFT JOIN fx_mail m ON m.session_id = u.session_id)"""


def _piled(m):
    return _results(m).withColumn("pillar", F.length("module") % 5)


@query(
    "verdict_noisy_or", "fx_mail", "fx_signals",
    sql=f"""WITH p AS (SELECT session_id, length(module) % 5 AS pillar, 1 - product(1 - LEAST(1.0, score * weight)) AS t FROM fx_signals GROUP BY 1, 2),
      s AS (SELECT session_id, 1 - product(1 - LEAST(1.0, t * ([1.0, 1.0, 0.8, 1.0, 0.7])[pillar + 1])) AS base, COUNT(*) FILTER (WHERE t > 0.05) / 5.0 AS diversity FROM p GROUP BY 1),
      a AS (SELECT session_id, base + (1 - base) * diversity * 0.2 AS score FROM s), {AROUND_SQL}
      SELECT a.session_id, R6((CASE WHEN paired THEN score + (1 - score) * 0.25 ELSE score END) * discount, 6) AS score FROM a JOIN around ON around.session_id = a.session_id""",
)
def _noisy_or(mail, m):
    rows = _piled(m)
    base = fusion_op.noisy_or_verdict(fusion_op.pillar_scores(rows, "session_id", "pillar", F.col("weight")), "session_id", "pillar")
    return op.with_circumstances(base, op.circumstances(rows, mail)).withColumn("score", round6("score"))


@query(
    "verdict_weighted_max", "fx_mail", "fx_signals",
    sql=f"""WITH t AS (SELECT session_id, MAX(threat / 4.0 * weight * confidence) AS top, COUNT(DISTINCT length(module) % 5) FILTER (WHERE threat > 0) AS pillars, COUNT(DISTINCT module) FILTER (WHERE threat > 0) AS modules FROM fx_signals GROUP BY 1),
      a AS (SELECT session_id, LEAST(1.0, top + CASE WHEN pillars >= 3 THEN 0.25 WHEN pillars = 2 THEN 0.15 ELSE 0 END + CASE WHEN modules >= 4 THEN 0.15 WHEN modules = 3 THEN 0.10 ELSE 0 END) AS score FROM t), {AROUND_SQL}
      SELECT a.session_id, R6((CASE WHEN paired THEN LEAST(1.0, score + 0.20) ELSE score END) * discount, 6) AS score FROM a JOIN around ON around.session_id = a.session_id""",
)
def _weighted_max(mail, m):
    rows = _piled(m)
    return op.with_circumstances(op.weighted_max(rows), op.circumstances(rows, mail), additive=True).withColumn("score", round6("score"))


@query("verdict_ds_murphy", "fx_module_results")
def _ds_murphy(m):
    modules = m.select("session_id", "confidence", fusion_op.bpa(F.col("score"), F.col("confidence"))["b"].alias("b"))
    return op.engine_verdict(engine_lists(m), modules).select("session_id", round6("risk").alias("risk"), round6("conflict").alias("conflict"))


@query("verdict_tbm", "fx_module_results")
def _tbm(m):
    return op.open_world_verdict(engine_lists(m)).select("session_id", round6("risk").alias("risk"), round6("novelty").alias("novelty"))
