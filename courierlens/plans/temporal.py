"""Temporal queries over the event fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import credibility, fusion
from courierlens.operators import temporal as op
from courierlens.plans.fusion import MURPHY_SQL
from courierlens.plans.registry import query
from courierlens.shared import written

CUSUM_SQL = """WITH a AS (SELECT *, COUNT(*) OVER w AS n, SUM(risk) OVER w AS s, SUM(risk * risk) OVER w AS q FROM fx_risk WINDOW w AS (PARTITION BY entity_key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, CASE WHEN n >= 10 THEN s / n ELSE 0.10 END AS mu, CASE WHEN n >= 10 THEN sqrt(greatest(1e-10, q / n - (s / n) * (s / n))) ELSE 0.10 END AS sigma FROM a),
 c AS (SELECT *, SUM(risk - mu - sigma / 2) OVER w AS pu, SUM(mu - risk - sigma / 2) OVER w AS pd FROM b WINDOW w AS (PARTITION BY entity_key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT *, pu - least(0, MIN(pu) OVER w) AS s_plus, pd - least(0, MIN(pd) OVER w) AS s_minus FROM c WINDOW w AS (PARTITION BY entity_key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""


@query("cusum", "fx_risk", sql=f"{CUSUM_SQL} SELECT entity_key, seq, R6(s_plus, 6) AS s_plus, R6(s_minus, 6) AS s_minus, n >= 10 AND greatest(s_plus, s_minus) > 4 * sigma AS alarm FROM d")
def _cusum(r):
    return op.cusum(r).select("entity_key", "seq", round6("s_plus").alias("s_plus"), round6("s_minus").alias("s_minus"), "alarm")


@query(
    "dual_ewma", "fx_risk",
    sql="""WITH l AS (SELECT entity_key, list_reduce(list({'n': CAST(1 AS BIGINT), 'f': risk, 's': risk} ORDER BY ts, seq), lambda a, x: {'n': a.n + 1, 'f': 0.95 * a.f + 0.05 * x.f, 's': 0.995 * a.s + 0.005 * x.s}) AS r FROM fx_risk GROUP BY 1)
      SELECT entity_key, r.n AS n, R6(r.f, 6) AS fast, R6(r.s, 6) AS slow, R6(abs(r.f - r.s) / greatest(abs(r.s), 0.01), 6) AS drift, abs(r.f - r.s) / greatest(abs(r.s), 0.01) > 1.5 AND r.n > 20 AS drifting FROM l""",
)
def _ewma(r):
    return op.dual_ewma(r).select("entity_key", "n", *(round6(c).alias(c) for c in ("fast", "slow", "drift")), "drifting")


MEMORY_SQL = "SELECT entity_key, list_reduce(list(risk ORDER BY ts, seq), lambda a, x: 0.92 * a + 0.08 * x) AS memory FROM fx_risk GROUP BY 1"


@query("entity_risk", "fx_risk", sql=f"SELECT entity_key, R6(memory, 6) AS memory, memory >= 0.30 AS watched, memory >= 0.60 AS alerted FROM ({MEMORY_SQL})")
def _entity_risk(r):
    return op.entity_risk(r).withColumn("memory", round6("memory"))


@query("hawkes", "fx_risk")
def _hawkes(r):
    return op.hawkes(r).select("entity_key", "n", *(round6(c).alias(c) for c in ("mu", "intensity", "ratio")), "burst")


@query("hmm_phase", "fx_risk")
def _hmm(r):
    return op.hmm_phase(r).select("entity_key", F.transform("posterior", round6).alias("posterior"), "phase", round6("risk").alias("risk"))


MAILS_SQL = "SELECT s.session_id AS mail_id, s.sender_domain AS sender, s.started_at AS sent_at, r.rcpt_domain AS recipient, v.risk FROM fx_sessions s JOIN (SELECT DISTINCT session_id, rcpt_domain FROM fx_recipients) r ON s.session_id = r.session_id JOIN fx_verdicts v ON v.session_id = s.session_id"


def _mails(s, r, v):
    return s.join(r.select("session_id", "rcpt_domain").distinct(), "session_id").join(v.select("session_id", "risk"), "session_id").select(F.col("session_id").alias("mail_id"), F.col("sender_domain").alias("sender"), F.col("started_at").alias("at"), F.col("rcpt_domain").alias("recipient"), "risk")


@query(
    "comm_edges", "fx_sessions", "fx_recipients", "fx_verdicts",
    sql=f"""WITH g AS (SELECT sender, recipient, COUNT(*) AS n, list(risk ORDER BY sent_at, mail_id) AS l, MIN(sent_at) AS first_at, MAX(sent_at) AS last_at FROM ({MAILS_SQL}) GROUP BY 1, 2)
      SELECT sender, recipient, n AS total_count, R6(list_reduce(l, lambda s, x: 0.85 * s + 0.15 * x), 6) AS avg_risk, R6(1 - pow(0.9, n), 6) AS frequency, first_at, last_at FROM g""",
)
def _edges(s, r, v):
    return op.comm_edges(_mails(s, r, v)).withColumns({"avg_risk": round6("avg_risk"), "frequency": round6("frequency")})


@query(
    "comm_graph_anomalies", "fx_sessions", "fx_recipients", "fx_verdicts",
    sql=f"""WITH e AS ({MAILS_SQL}), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sender, recipient ORDER BY sent_at, mail_id) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
      m AS (SELECT mail_id, sender, sent_at, risk, SUM(fresh) AS fresh FROM f GROUP BY 1, 2, 3, 4),
      p AS (SELECT *, COUNT(*) OVER w AS n, SUM(fresh) OVER w AS degree FROM m WINDOW w AS (PARTITION BY sender ORDER BY sent_at, mail_id ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT *, CASE WHEN n <= 5 AND degree >= 10 THEN least(1.0, degree / 10) ELSE 0 END AS a, CASE WHEN n > 5 AND fresh > 0 AND risk > 0.5 THEN least(1.0, risk) ELSE 0 END AS b,
             CASE WHEN degree - fresh > 3 AND fresh > 0 AND degree / (degree - fresh) > 3 THEN least(1.0, (degree / (degree - fresh) - 1) / 3) ELSE 0 END AS c FROM p)
      SELECT mail_id, sender, n, CAST(degree AS BIGINT) AS degree, CAST(fresh AS BIGINT) AS fresh, R6(greatest(a, b, c), 6) AS score,
        CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a = greatest(a, b, c) THEN 'new_sender_fan_out' WHEN b = greatest(a, b, c) THEN 'new_risky_contact' ELSE 'degree_jump' END AS pattern FROM q""",
)
def _anomalies(s, r, v):
    mails = _mails(s, r, v).groupBy("mail_id", "sender", "at", "risk").agg(F.collect_set("recipient").alias("recipients"))
    return op.comm_graph_anomalies(mails).withColumn("score", round6("score"))


FIT_SQL = """WITH w AS (SELECT risk AS x FROM fx_risk ORDER BY ts DESC, seq DESC LIMIT 2000), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, COUNT(*) OVER () AS n FROM w),
 u AS (SELECT x, n, MAX(CASE WHEN i = least(CAST(floor(0.95 * n) AS INT), n - 1) THEN x END) OVER () AS u FROM r), t AS (SELECT x - u AS y, u, n, row_number() OVER (ORDER BY x) - 1 AS j, COUNT(*) OVER () AS m FROM u WHERE x > u AND n >= 30),
 b AS (SELECT u, m, n, AVG(y) AS b0, SUM(y * (m - 1 - j) / (m * (m - 1))) AS b1 FROM t WHERE m >= 5 GROUP BY 1, 2, 3), f AS (SELECT *, b0 / (b0 - 2 * b1) - 2 AS xi, 2 * b0 * b1 / (b0 - 2 * b1) AS sigma FROM b)"""
TAIL_SQL = "CASE WHEN risk <= u THEN 1.0 WHEN 1 + xi * (risk - u) / sigma <= 0 THEN 1e18 ELSE least(1e18, 1 / (m / n * pow(1 + xi * (risk - u) / sigma, -1 / xi))) END"


@query(
    "evt_tail", "fx_risk",
    sql=f"""{FIT_SQL}, c AS (SELECT a.risk, AVG(w.x) AS beyond FROM (SELECT DISTINCT risk FROM fx_risk) a LEFT JOIN w ON w.x > a.risk GROUP BY 1)
      SELECT entity_key, seq, ROUND(log10({TAIL_SQL}), 6) AS period_log10, R6(CASE WHEN k.risk <= u THEN COALESCE(beyond, k.risk) ELSE least(1e18, k.risk + (sigma + xi * (k.risk - u)) / (1 - xi)) END, 6) AS cvar FROM (SELECT * FROM fx_risk) k JOIN c ON c.risk = k.risk, f""".replace("(risk - u)", "(k.risk - u)").replace("WHEN risk <= u", "WHEN k.risk <= u"),
)
def _evt(r):
    fit = op.evt_fit(r)
    rows = op.evt_cvar(op.evt_tail(r, fit), r, fit)
    return rows.select("entity_key", "seq", F.round(F.log10(F.least("period", F.lit(1e18))), 6).alias("period_log10"), round6(F.least("cvar", F.lit(1e18))).alias("cvar"))


def _phase_sql() -> tuple[str, str]:
    """The first and the following step of the forward filter, written out for its five phases."""
    emit = (
        "0.1 + (1 - risk) * 0.7 + (1 - u_final) * 0.15 + calm * 0.05", "0.05 + (risk * 0.3 + 0.3) * u_final * 0.5 + steady * 0.15", "0.4 + (1 - risk) * 0.2 + u_final * 0.2 + risk * 0.2",
        "0.02 + risk * 0.6 + (1 - calm) * 0.2 + (1 - u_final) * 0.03", "0.02 + risk * 0.5 + (1 - u_final) * 0.25 + (1 - steady) * 0.1",
    )
    moves = ((0.99, 0.008, 0.001, 0.001, 0.0), (0.02, 0.92, 0.05, 0.008, 0.002), (0.01, 0.01, 0.94, 0.03, 0.01), (0.005, 0.005, 0.01, 0.88, 0.1), (0.05, 0.01, 0.01, 0.03, 0.9))

    def step(before: tuple[str, ...], source: str) -> str:
        raw = ", ".join(f"({' + '.join(f'{before[i]} * CAST({moves[i][j]} AS DOUBLE)' for i in range(5))}) * ({emit[j]}) AS x{j}" for j in range(5))
        shares = ", ".join(f"x{j} / (x0 + x1 + x2 + x3 + x4) AS p{j}" for j in range(5))
        return f"SELECT sender, recipient, k, mail_id, {shares} FROM (SELECT q.sender, q.recipient, q.k, q.mail_id, {raw} FROM {source})"

    first = step(("CAST(0.95 AS DOUBLE)", "CAST(0.03 AS DOUBLE)", "CAST(0.01 AS DOUBLE)", "CAST(0.005 AS DOUBLE)", "CAST(0.005 AS DOUBLE)"), "pairs q WHERE q.k = 1")
    return first, step(tuple(f"phase.p{i}" for i in range(5)), "phase JOIN pairs q ON q.sender = phase.sender AND q.recipient = phase.recipient AND q.k = phase.k + 1")


#: Every mail with its signals, by recursion over the mails of a sender and of a pair.
SIGNALS_SQL = f"""WITH RECURSIVE mass AS (SELECT session_id AS mail_id, r.b + 0.3 * r.u AS risk, r.u AS u_final, r.k AS k_conflict FROM ({MURPHY_SQL} SELECT * FROM r)),
 mails AS (SELECT f.mail_id, f.sender, f.sent_at, risk, u_final, k_conflict FROM fx_flow f JOIN mass ON mass.mail_id = f.mail_id),
 own AS (SELECT *, row_number() OVER w AS k, COALESCE((epoch_us(sent_at) - epoch_us(lag(sent_at) OVER w)) / 3.6e9, 48.0) AS gap FROM mails WINDOW w AS (PARTITION BY sender ORDER BY sent_at, mail_id)),
 means AS (SELECT sender, k, mail_id, risk AS fast, risk AS slow, risk AS memory FROM own WHERE k = 1 UNION ALL
   SELECT o.sender, o.k, o.mail_id, 0.95 * m.fast + 0.05 * o.risk, 0.995 * m.slow + 0.005 * o.risk, 0.92 * m.memory + 0.08 * o.risk FROM means m JOIN own o ON o.sender = m.sender AND o.k = m.k + 1),
 sums1 AS (SELECT *, CASE WHEN k >= 10 THEN AVG(risk) OVER w ELSE 0.10 END AS mu, CASE WHEN k >= 10 THEN sqrt(greatest(1e-10, AVG(risk * risk) OVER w - (AVG(risk) OVER w) ** 2)) ELSE 0.10 END AS sigma FROM own WINDOW w AS (PARTITION BY sender ORDER BY k ROWS UNBOUNDED PRECEDING)),
 sums2 AS (SELECT s.sender, s.k, s.mail_id, greatest(0.0, risk - mu - sigma / 2) AS up, greatest(0.0, mu - risk - sigma / 2) AS down, sigma FROM sums1 s WHERE k = 1 UNION ALL
   SELECT s.sender, s.k, s.mail_id, greatest(0.0, b.up + s.risk - s.mu - s.sigma / 2), greatest(0.0, b.down + s.mu - s.risk - s.sigma / 2), s.sigma FROM sums2 b JOIN sums1 s ON s.sender = b.sender AND s.k = b.k + 1),
 pairs AS (SELECT own.mail_id, sender, recipient, risk, u_final, k_conflict, 1 - least(k_conflict, 0.5) * 2 AS calm, exp(-((least(gap, 720.0) - 24) ** 2) / 200) AS steady, row_number() OVER w AS k, epoch_us(sent_at) / 3.6e9 AS t,
     (epoch_us(sent_at) - epoch_us(lag(sent_at) OVER w)) / 3.6e9 AS pause, list({{'t': epoch_us(sent_at) / 3.6e9, 'r': risk}}) OVER (PARTITION BY sender, recipient ORDER BY sent_at, own.mail_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past
   FROM own JOIN (SELECT DISTINCT session_id AS mail_id, rcpt_domain AS recipient FROM fx_recipients) r ON r.mail_id = own.mail_id WINDOW w AS (PARTITION BY sender, recipient ORDER BY sent_at, own.mail_id)),
 phase AS ({_phase_sql()[0]} UNION ALL {_phase_sql()[1]}),
 base AS (SELECT sender, recipient, k, mail_id, CAST(0.5 AS DOUBLE) AS was, CAST(0.5 AS DOUBLE) AS mu FROM pairs WHERE k = 1 UNION ALL
   SELECT q.sender, q.recipient, q.k, q.mail_id, b.mu, CASE WHEN q.k > 4 THEN greatest(0.01, 0.995 * b.mu + 0.005 * least(100.0, 1 / greatest(0.001, q.pause))) ELSE b.mu END FROM base b JOIN pairs q ON q.sender = b.sender AND q.recipient = b.recipient AND q.k = b.k + 1),
 burst AS (SELECT q.mail_id, MAX((b.was + COALESCE(list_sum(list_transform(list_filter(q.past, lambda x: x.t >= q.past[-1].t - 2.5 * ln(2)), lambda x: 0.8 * pow(x.r, 1.5) * exp(-2 * (q.t - x.t)))), 0)) / greatest(b.mu, 0.01)) AS ratio
   FROM pairs q JOIN base b ON b.sender = q.sender AND b.recipient = q.recipient AND b.k = q.k GROUP BY 1),
 worst AS (SELECT mail_id, MAX(risk) AS phase_risk, arg_max(p2, (risk, recipient)) AS trust, arg_max(p3, (risk, recipient)) AS attack FROM (SELECT *, 0.3 * p1 + 0.5 * p2 + p3 + p4 AS risk FROM phase) GROUP BY 1),
 fresh AS (SELECT mail_id, sender, risk, k, COUNT(*) FILTER (WHERE first) AS fresh FROM (SELECT own.mail_id, own.sender, own.risk, own.k, pairs.k = 1 AS first FROM own JOIN pairs ON pairs.mail_id = own.mail_id) GROUP BY 1, 2, 3, 4),
 degrees AS (SELECT *, SUM(fresh) OVER (PARTITION BY sender ORDER BY k ROWS UNBOUNDED PRECEDING) AS degree FROM fresh),
 graph AS (SELECT mail_id, greatest(CASE WHEN k <= 5 AND degree >= 10 THEN least(1.0, degree / 10) ELSE 0 END, CASE WHEN k > 5 AND fresh > 0 AND risk > 0.5 THEN least(1.0, risk) ELSE 0 END,
     CASE WHEN degree - fresh > 3 AND fresh > 0 AND degree / (degree - fresh) > 3 THEN least(1.0, (degree / (degree - fresh) - 1) / 3) ELSE 0 END) AS graph_score FROM degrees),
 signals AS (SELECT own.mail_id, own.sent_at, own.risk, own.u_final, own.k_conflict, own.k >= 10 AND greatest(s.up, s.down) > 4 * s.sigma AS alarm, abs(m.fast - m.slow) / greatest(abs(m.slow), 0.01) AS drift,
     abs(m.fast - m.slow) / greatest(abs(m.slow), 0.01) > 1.5 AND own.k > 20 AS drifting, m.memory, m.memory >= 0.30 AS watched, phase_risk, trust, attack, ratio, graph_score
   FROM own JOIN means m ON m.mail_id = own.mail_id JOIN sums2 s ON s.mail_id = own.mail_id JOIN worst ON worst.mail_id = own.mail_id JOIN burst ON burst.mail_id = own.mail_id JOIN graph ON graph.mail_id = own.mail_id),
 risks AS (SELECT *, greatest(risk, temporal) AS raised FROM (SELECT *, greatest(CASE WHEN alarm THEN 0.3 ELSE 0.0 END, CASE WHEN drifting THEN least(0.3, drift / 10.0) ELSE 0.0 END, CASE WHEN watched THEN memory / 5.0 ELSE 0.0 END,
     phase_risk, graph_score * 0.3, CASE WHEN ratio > 5 THEN 0.5 WHEN ratio > 3 THEN 0.3 ELSE 0.0 END) AS temporal FROM signals))"""


def _signals(flow, recipients, modules):
    """The mails of the flow with risk, doubt and conflict from their findings, and the temporal signals of each."""
    finding = F.struct((F.col("module_n").cast("int") - 1).alias("engine"), "part_n", "supp_n", "score", "confidence")
    found = modules.groupBy(F.col("session_id").alias("mail_id")).agg(F.sort_array(F.collect_list(finding)).alias("items"))
    fused = credibility.murphy_of_engines(found, "mail_id").select("mail_id", F.struct("b", "u").alias("m"), F.col("u").alias("u_final"), F.col("k").alias("k_conflict"))
    to = recipients.groupBy(F.col("session_id").alias("mail_id")).agg(F.collect_set("rcpt_domain").alias("recipients"))
    mails = flow.join(fused, "mail_id").join(to, "mail_id").select("mail_id", "sender", F.col("sent_at").alias("at"), "recipients", fusion.risk(F.col("m")).alias("risk"), "u_final", "k_conflict")
    return op.composite_risk(op.temporal_signals(mails))


@query(
    "temporal_risk", "fx_flow", "fx_recipients", "fx_module_results",
    sql=f"{SIGNALS_SQL} SELECT mail_id, alarm, drifting, watched, R6(phase_risk, 6) AS phase_risk, R6(ratio, 6) AS burst_ratio, R6(graph_score, 6) AS graph_score, R6(temporal, 6) AS temporal, R6(raised, 6) AS raised FROM risks",
)
def _temporal_risk(f, r, m):
    rows = _signals(f, r, m).withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
    return rows.select("mail_id", "alarm", "drifting", "watched", *(round6(c).alias(c) for c in ("phase_risk", "burst_ratio", "graph_score", "temporal", "raised")))


ALERT_SQL = f"""{SIGNALS_SQL}, recent AS (SELECT raised AS x FROM risks ORDER BY sent_at DESC, mail_id DESC LIMIT 2000), places AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, COUNT(*) OVER () AS n FROM recent),
 bounds AS (SELECT x, n, MAX(CASE WHEN i = least(CAST(floor(0.95 * n) AS INT), n - 1) THEN x END) OVER () AS u FROM places), tails AS (SELECT x - u AS y, u, n, row_number() OVER (ORDER BY x) - 1 AS j, COUNT(*) OVER () AS m FROM bounds WHERE x > u AND n >= 30),
 moments AS (SELECT u, m, n, AVG(y) AS b0, SUM(y * (m - 1 - j) / (m * (m - 1))) AS b1 FROM tails WHERE m >= 5 GROUP BY 1, 2, 3), fits AS (SELECT *, b0 / (b0 - 2 * b1) - 2 AS xi, 2 * b0 * b1 / (b0 - 2 * b1) AS sigma FROM moments),
 fit AS (SELECT * FROM fits WHERE sigma > 0 AND xi BETWEEN -0.5 AND 2),
 odds AS (SELECT risks.*, CASE WHEN fit.u IS NULL THEN 0.0 WHEN raised <= fit.u THEN 1.0 WHEN 1 + xi * (raised - u) / sigma <= 0 THEN 1e18 ELSE least(1e18, 1 / (m / n * pow(1 + xi * (raised - u) / sigma, -1 / xi))) END AS period FROM risks LEFT JOIN fit ON true),
 weights AS (SELECT session_id AS mail_id, MAX(CASE WHEN contains(rcpt_domain, 'n1.') THEN 5.0 WHEN contains(rcpt_domain, 'n2.') THEN 3.5 ELSE 1.0 END) AS impact FROM fx_recipients GROUP BY 1),
 news AS (SELECT session_id AS mail_id, 1 - product(1 - score * 0.1) AS novelty FROM fx_module_results GROUP BY 1),
 told AS (SELECT mail_id, list_filter([
     CASE WHEN raised * impact >= 3 THEN '0 expected_loss' WHEN raised * impact >= 1.5 THEN '1 expected_loss' WHEN raised * impact >= 0.5 THEN '2 expected_loss' WHEN raised * impact >= 0.2 THEN '3 expected_loss' END,
     CASE WHEN k_conflict > 0.7 THEN '0 conflict' END, CASE WHEN alarm THEN '0 cusum' END, CASE WHEN u_final > 0.6 THEN '2 uncertainty' END,
     CASE WHEN period >= 10000 THEN '0 extreme_value' WHEN period >= 1000 THEN '1 extreme_value' WHEN period >= 100 THEN '2 extreme_value' WHEN period >= 20 THEN '3 extreme_value' END,
     CASE WHEN trust > 0.25 THEN '2 trust_building' END, CASE WHEN attack > 0.3 THEN '1 attack_execution' END, CASE WHEN watched THEN '3 watchlist' END, CASE WHEN drifting THEN '3 drift' END, CASE WHEN graph_score > 0 THEN '2 graph' END,
     CASE WHEN ratio > 5 THEN '0 burst' WHEN ratio > 3 THEN '1 burst' END, CASE WHEN novelty > 0.6 THEN '1 novelty' WHEN novelty > 0.3 THEN '2 novelty' END], lambda x: x IS NOT NULL) AS why
   FROM odds JOIN weights USING (mail_id) JOIN news USING (mail_id) WHERE raised >= 0.15)"""


@query(
    "alert_levels", "fx_flow", "fx_recipients", "fx_module_results",
    sql=f"{ALERT_SQL} SELECT mail_id, COALESCE(CAST(list_min(why)[1] AS INT), 3) AS level, CASE WHEN len(why) = 0 THEN 'risk' ELSE array_to_string(list_transform(why, lambda x: x[3:]), ',') END AS reasons FROM told",
)
def _alerts(f, r, m):
    rows = _signals(f, r, m)
    scores = rows.drop("risk").withColumnRenamed("raised", "risk").withColumn("impact", op.impact(F.col("recipients"), (("n1.", 5.0), ("n2.", 3.5))))
    scores = written(scores.drop("recipients"), "scores")  # read by the fit and by the levels
    new = m.groupBy(F.col("session_id").alias("mail_id")).agg(fusion.noisy_or(F.col("score") * 0.1).alias("novelty"))
    judged = op.evt_tail(scores, op.evt_fit(scores, order=("at", "mail_id"))).join(new, "mail_id").withColumn("cross_conflict", F.lit(None).cast("double"))
    return op.alert_levels(judged).select("mail_id", F.col("level").cast("int").alias("level"), F.array_join("reasons", ",").alias("reasons"))


def _cooled_sql(source: str, key: str, seconds: int) -> str:
    """Recursive pick of events that a cool-down lets through; source has (key, t, id, ...)."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, id) AS k FROM {source}),
      p AS (SELECT {key}, k, id, t AS last, true AS took FROM o WHERE k = 1 UNION ALL
            SELECT o.{key}, o.k, o.id, CASE WHEN o.t - p.last >= {seconds} THEN o.t ELSE p.last END, o.t - p.last >= {seconds} FROM p JOIN o ON o.{key} = p.{key} AND o.k = p.k + 1)"""


@query(
    "volume_anomaly", "fx_incidents",
    sql=f"""WITH RECURSIVE h AS (SELECT * FROM (SELECT user_id, incident_id AS id, epoch_us(ts) / 1e6 AS t, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM fx_incidents) WHERE n >= 5),
      {_cooled_sql('h', 'user_id', 259200)}
      SELECT h.user_id, h.id AS incident_id, h.n AS in_window, CASE WHEN h.n >= 15 THEN 'critical' WHEN h.n >= 10 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN h ON h.user_id = p.user_id AND h.id = p.id WHERE took""",
)
def _volume(i):
    return op.volume_anomaly(i, seconds=86_400, cool_down=259_200)


@query(
    "jrt_compliance", "fx_incidents",
    sql=f"""WITH RECURSIVE l AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS level FROM fx_incidents),
      w AS (SELECT *, epoch_us(ts) / 1e6 AS t, SUM(CASE WHEN level = 4 THEN item_count ELSE 0 END) OVER z AS n4, SUM(item_count) OVER z AS n3 FROM l WHERE level >= 3 WINDOW z AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)),
      h AS (SELECT user_id || '-level4' AS key, user_id, incident_id AS id, t, 'level4' AS rule, n4 AS total FROM w WHERE level = 4 AND n4 >= 300 UNION ALL SELECT user_id || '-level3', user_id, incident_id, t, 'level3', n3 FROM w WHERE n3 >= 300),
      {_cooled_sql('h', 'key', 3600)}
      SELECT h.user_id, h.id AS incident_id, h.rule, CAST(h.total AS BIGINT) AS total FROM p JOIN h ON h.key = p.key AND h.id = p.id WHERE took""",
)
def _jrt(i):
    level = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).otherwise(2)
    return op.jrt_compliance(i.withColumn("level", level), least4=300, least3=300)


INCIDENT_SQL = "SELECT incident_id, user_id, incident_type, user_id % 3 || '.txt' AS file, item_count % 2 AS found, epoch_us(ts) / 1e6 AS t FROM fx_incidents"


@query(
    "dedup_incidents", "fx_incidents",
    sql=f"""WITH RECURSIVE i AS ({INCIDENT_SQL}), h AS (SELECT COALESCE(CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END, 'ip' || user_id % 40) || '-' || file || '-' || found AS key, incident_id AS id, t FROM i), {_cooled_sql('h', 'key', 7200)},
      h2 AS (SELECT COALESCE(CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END, '') || '-' || incident_type || '-' || found AS key, incident_id AS id, t FROM i WHERE incident_id IN (SELECT id FROM p WHERE took)), {_cooled_sql('h2', 'key', 86400).replace('o AS', 'o2 AS').replace('p AS', 'p2 AS').replace('FROM o ', 'FROM o2 ').replace('o.', 'o2.').replace('p.', 'p2.').replace('FROM p ', 'FROM p2 ').replace('JOIN o ', 'JOIN o2 ')}
      SELECT id AS incident_id FROM p2 WHERE took""",
)
def _dedup(i):
    rows = i.select(
        "incident_id", "ts", "incident_type", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("user"), F.concat(F.lit("ip"), F.col("user_id") % 40).alias("client_ip"),
        F.concat(F.col("user_id") % 3, F.lit(".txt")).alias("filename"), F.array(F.lit("m"), (F.col("item_count") % 2).cast("string")).alias("matches"),
    )
    return op.dedup_incidents(rows, near=7200, far=86_400).select("incident_id")


@query(
    "dedup_sessions", "fx_web",
    sql=f"""WITH RECURSIVE h AS (SELECT client_ip || ' ' || method || ' ' || split_part(uri, '?', 1) || CASE WHEN contains(uri, 'sid=7') THEN '?sid=7' ELSE '' END || COALESCE(filename, '') AS key, session_id AS id, epoch_us(ts) / 1e6 AS t FROM fx_web), {_cooled_sql('h', 'key', 3600)}
      SELECT id AS session_id FROM p WHERE took""",
)
def _dedup_sessions(w):
    return op.dedup_sessions(w, 3600).select("session_id")


@query(
    "chunk_reassembly", "fx_chunks",
    sql=f"""WITH RECURSIVE c AS (SELECT chunk_id AS id, epoch_us(ts) / 1e6 AS t, client_ip, 'c:' || regexp_extract(uri, 'c%3A([0-9])', 1) AS compose_id, '1' AS attachment_id, CAST(regexp_extract(uri, 'offset=([0-9]+)', 1) AS BIGINT) AS off, data FROM fx_chunks WHERE data <> '' AND contains(uri, 'attachmentId=1')),
      r AS (SELECT *, SUM(new) OVER (PARTITION BY client_ip, compose_id ORDER BY t, id) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_ip, compose_id ORDER BY t, id) < 600 THEN 0 ELSE 1 END AS new FROM c)),
      h AS (SELECT client_ip || '-' || compose_id || '-' || run AS key, id, t, client_ip, compose_id, attachment_id, off, data FROM r), {_cooled_sql('h', 'key', 1800)},
      s AS (SELECT h.*, COUNT(*) FILTER (WHERE took) OVER (PARTITION BY h.key ORDER BY h.t, h.id) AS part FROM h JOIN p ON p.key = h.key AND p.id = h.id),
      k AS (SELECT *, row_number() OVER (PARTITION BY key, part, off ORDER BY t DESC, id DESC) AS back FROM s)
      SELECT client_ip, compose_id, attachment_id, make_timestamp(CAST(MIN(t) * 1e6 AS BIGINT)) AS started, COUNT(*) AS n_chunks, CAST(SUM(strlen(data)) AS BIGINT) AS size, string_agg(data, '' ORDER BY off) FILTER (WHERE back = 1) AS data FROM k GROUP BY client_ip, compose_id, attachment_id, key, part""",
)
def _chunks(c):
    return op.reassembled(c, 600, 1800)
