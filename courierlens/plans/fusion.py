"""Evidence-fusion queries: one line of the fixture is one module's finding about one session."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import fusion as op
from courierlens.plans.registry import query
from courierlens.plans.relational import LEVEL_SQL
from courierlens.schemas import threat_level

ORDER = ("module_n", "part_n", "supp_n", "score", "confidence")
MASS_SQL = "{'b': score * confidence, 'd': (1 - score) * confidence, 'u': 1 - confidence, 'k': CAST(0.0 AS DOUBLE)}"
LIST_SQL = f"SELECT session_id, list({MASS_SQL} ORDER BY module_n, part_n, supp_n, score, confidence) AS l FROM fx_module_results GROUP BY 1"


def _dempster_sql(x: str, y: str) -> str:
    k = f"({x}.b * {y}.d + {x}.d * {y}.b)"
    part = lambda c: f"({x}.{c} * {y}.{c} + {x}.{c} * {y}.u + {x}.u * {y}.{c}) / (1 - {k})"
    none = f"{k} >= 1 - 1e-12"
    return (
        f"{{'b': CASE WHEN {none} THEN 0.0 ELSE {part('b')} END, 'd': CASE WHEN {none} THEN 0.0 ELSE {part('d')} END, "
        f"'u': CASE WHEN {none} THEN 1.0 ELSE {x}.u * {y}.u / (1 - {k}) END, 'k': CASE WHEN {none} THEN 1.0 ELSE 1 - (1 - {x}.k) * (1 - {k}) END}}"
    )


def _reduce_sql(items: str) -> str:
    return f"list_reduce({items}, lambda x, y: {_dempster_sql('x', 'y')})"


def _rounded(m: str, *parts: str):
    return [round6(f"{m}.{p}").alias(p) for p in parts]


@query(
    "effective_bpa", "fx_module_results",
    sql="SELECT module_n, R6(AVG(score * confidence), 6) AS b, R6(AVG((1 - score) * confidence), 6) AS d, R6(AVG(1 - confidence), 6) AS u, R6(AVG(score * confidence + 0.3 * (1 - confidence)), 6) AS risk, R6(AVG(score * confidence + (1 - confidence) / 2), 6) AS pignistic FROM fx_module_results GROUP BY 1",
)
def _effective(m):
    rows = m.select("module_n", op.bpa(F.col("score"), F.col("confidence")).alias("m"))
    return rows.groupBy("module_n").agg(*(round6(F.avg(f"m.{c}")).alias(c) for c in "bdu"), round6(F.avg(op.risk(F.col("m")))).alias("risk"), round6(F.avg(op.pignistic(F.col("m")))).alias("pignistic"))


@query("dempster_combine", "fx_module_results", sql=f"SELECT session_id, R6(r.b, 6) AS b, R6(r.d, 6) AS d, R6(r.u, 6) AS u, R6(r.k, 6) AS k FROM (SELECT session_id, {_reduce_sql('l')} AS r FROM ({LIST_SQL}))")
def _dempster(m):
    return op.evidence(m, "session_id", ORDER).select("session_id", op.dempster(F.col("items.m")).alias("r")).select("session_id", *_rounded("r", "b", "d", "u", "k"))


@query(
    "fused_levels", "fx_module_results",
    sql=f"SELECT level, COUNT(*) AS n FROM (SELECT {LEVEL_SQL} AS level FROM (SELECT ROUND(r.b + 0.3 * r.u, 9) AS risk FROM (SELECT {_reduce_sql('l')} AS r FROM ({LIST_SQL})))) GROUP BY 1",
)
def _fused_levels(m):
    risk = op.evidence(m, "session_id", ORDER).select(F.round(op.risk(op.dempster(F.col("items.m"))), 9).alias("risk"))
    return risk.groupBy(threat_level(F.col("risk")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


ENGINE_SQL = f"SELECT session_id, module_n - 1 AS engine, {_reduce_sql('l')} AS m FROM (SELECT session_id, module_n, list({MASS_SQL} ORDER BY part_n, supp_n, score, confidence) AS l FROM fx_module_results GROUP BY 1, 2)"


def _engines(m):
    """Each module is an engine: its findings about a session are combined; vacuous ones are dropped."""
    per = m.withColumn("engine", F.col("module_n").cast("int") - 1).repartition("session_id")  # serves both groupings, by engine and by session
    one = op.evidence(per, ("session_id", "engine"), ("part_n", "supp_n", "score", "confidence"))
    rows = one.select("session_id", "engine", op.dempster(F.col("items.m")).alias("r"))
    return rows.filter("r.u <= 1 - 1e-9").select("session_id", "engine", op.mass(F.col("r.b"), F.col("r.d"), F.col("r.u")).alias("m"), F.col("r.k").alias("k"))


@query("engine_bpas", "fx_module_results", sql=f"SELECT session_id, CAST(engine AS INT) AS engine, R6(m.b, 6) AS b, R6(m.d, 6) AS d, R6(m.u, 6) AS u, R6(m.k, 6) AS k FROM ({ENGINE_SQL}) WHERE m.u <= 1 - 1e-9")
def _engine_bpas(m):
    return _engines(m).select("session_id", "engine", *_rounded("m", "b", "d", "u"), round6("k").alias("k"))


def engine_lists(m):
    return _engines(m).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("engine", "m"))).alias("items"))


ENGINES_SQL = f"SELECT session_id, list({{'engine': engine, 'b': m.b, 'd': m.d, 'u': m.u, 'k': CAST(0.0 AS DOUBLE)}} ORDER BY engine) AS l FROM ({ENGINE_SQL}) WHERE m.u <= 1 - 1e-9 GROUP BY 1"
RHO_SQL = "[" + ", ".join("[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in row) + "]" for row in op.CORRELATION) + "]"
KNOWING_SQL = f"SELECT * FROM ({ENGINE_SQL}) WHERE m.u <= 1 - 1e-9"
DISCOUNT_SQL = f"""SELECT session_id, engine, CASE WHEN rho >= 0.1 THEN 1 - rho ELSE 1.0 END AS a, b, d FROM (
  SELECT x.session_id, x.engine, ANY_VALUE(x.m.b) AS b, ANY_VALUE(x.m.d) AS d, MAX(({RHO_SQL})[x.engine + 1][y.engine + 1]) AS rho
  FROM ({KNOWING_SQL}) x LEFT JOIN ({KNOWING_SQL}) y ON x.session_id = y.session_id AND x.engine <> y.engine GROUP BY 1, 2)"""


@query("correlation_discount", "fx_module_results", sql=f"SELECT session_id, CAST(engine AS INT) AS engine, R6(b * a, 6) AS b, R6(d * a, 6) AS d, R6(1 - b * a - d * a, 6) AS u FROM ({DISCOUNT_SQL})")
def _correlation(m):
    rows = engine_lists(m).select("session_id", F.explode(F.arrays_zip(F.col("items.engine").alias("engine"), op.correlation_discount(F.col("items")).alias("m"))).alias("x"))
    return rows.select("session_id", "x.engine", *_rounded("x.m", "b", "d", "u"))


DISTANCE_SQL = "sqrt(greatest(0.0, 0.5 * ((x.b - y.b) ** 2 + (x.d - y.d) ** 2 + (x.u - y.u) ** 2 + (x.b - y.b) * (x.u - y.u) + (x.d - y.d) * (x.u - y.u))))"
MURPHY_SQL = f"""WITH e AS (SELECT session_id, m.b AS b, m.d AS d, m.u AS u, engine FROM ({ENGINE_SQL}) WHERE m.u <= 1 - 1e-9),
 s AS (SELECT x.session_id, x.engine, x.b, x.d, x.u, SUM(CASE WHEN x.engine <> y.engine THEN 1 - {DISTANCE_SQL} ELSE 0 END) AS w FROM e x JOIN e y ON x.session_id = y.session_id GROUP BY 1, 2, 3, 4, 5),
 t AS (SELECT *, SUM(w) OVER p AS total, COUNT(*) OVER p AS n, MAX(w) OVER p AS most FROM s WINDOW p AS (PARTITION BY session_id)),
 c AS (SELECT *, CASE WHEN total <= 1e-8 OR most / total > 0.99 THEN 1.0 / n ELSE w / total END AS share FROM t),
 a AS (SELECT session_id, n, {{'b': SUM(b * share), 'd': SUM(d * share), 'u': SUM(u * share), 'k': CAST(0.0 AS DOUBLE)}} AS m FROM c GROUP BY session_id, n),
 r AS (SELECT session_id, n, {_reduce_sql("list_transform(range(n), lambda i: m)")} AS r FROM a)"""


@query("murphy_fusion", "fx_module_results", sql=f"{MURPHY_SQL} SELECT session_id, n, R6(r.b, 6) AS b, R6(r.d, 6) AS d, R6(r.u, 6) AS u, R6(r.k, 6) AS k FROM r")
def _murphy(m):
    rows = engine_lists(m).select("session_id", F.size("items").cast("long").alias("n"), op.murphy(F.col("items.m")).alias("r"))
    return rows.select("session_id", "n", *_rounded("r", "b", "d", "u", "k"))



def _tbm_sql(items: str) -> str:
    b, d, u = "(x.b * y.b + x.b * y.u + x.u * y.b)", "(x.d * y.d + x.d * y.u + x.u * y.d)", "(x.u * y.u)"
    e = "(x.b * y.d + x.d * y.b + x.e * (y.b + y.d + y.u + y.e) + y.e * (x.b + x.d + x.u))"
    n = f"({b} + {d} + {u} + {e})"
    return f"list_reduce({items}, lambda x, y: {{'b': {b} / {n}, 'd': {d} / {n}, 'u': {u} / {n}, 'e': {e} / {n}}})"


OPEN_SQL = "SELECT session_id, list({'b': score * confidence, 'd': (1 - score) * confidence, 'u': 1 - confidence, 'e': CAST(0.0 AS DOUBLE)} ORDER BY module_n, part_n, supp_n, score, confidence) AS l FROM fx_module_results {where} GROUP BY 1"


@query("tbm_conjunctive", "fx_module_results", sql=f"SELECT session_id, R6(r.b, 6) AS b, R6(r.d, 6) AS d, R6(r.u, 6) AS u, R6(r.e, 6) AS e FROM (SELECT session_id, {_tbm_sql('l')} AS r FROM ({OPEN_SQL.replace('{where}', '')}))")
def _tbm(m):
    return op.evidence(m, "session_id", ORDER).select("session_id", op.conjunctive(F.col("items.m")).alias("r")).select("session_id", *_rounded("r", "b", "d", "u", "e"))


@query(
    "cautious_combine", "fx_module_results",
    sql=f"""WITH t AS (SELECT session_id, {_tbm_sql('l')} AS r FROM ({OPEN_SQL.replace('{where}', 'WHERE pillar_n < 2')})), s AS (SELECT session_id, {_tbm_sql('l')} AS r FROM ({OPEN_SQL.replace('{where}', 'WHERE pillar_n >= 2')})),
      c AS (SELECT t.session_id, greatest(t.r.b, s.r.b) AS b, greatest(t.r.d, s.r.d) AS d, least(t.r.u, s.r.u) AS u, greatest(t.r.e, s.r.e) AS e FROM t JOIN s ON t.session_id = s.session_id)
      SELECT session_id, R6(b / (b + d + u + e), 6) AS b, R6(d / (b + d + u + e), 6) AS d, R6(u / (b + d + u + e), 6) AS u, R6(e / (b + d + u + e), 6) AS e FROM c""",
)
def _cautious(m):
    part = lambda rows, name: op.evidence(rows, "session_id", ORDER).select("session_id", op.conjunctive(F.col("items.m")).alias(name))
    both = part(m.filter("pillar_n < 2"), "t").join(part(m.filter("pillar_n >= 2"), "s"), "session_id")
    return both.select("session_id", op.cautious(F.col("t"), F.col("s")).alias("r")).select("session_id", *_rounded("r", "b", "d", "u", "e"))


@query("novelty", "fx_module_results", sql="SELECT session_id, R6(1 - product(1 - score * 0.1), 6) AS novelty FROM fx_module_results GROUP BY 1")
def _novelty(m):
    return m.groupBy("session_id").agg(round6(op.noisy_or(F.col("score") * 0.1)).alias("novelty"))


PILLAR_SQL = "SELECT session_id, pillar_n, 1 - product(1 - LEAST(1.0, score * 0.5)) AS t FROM fx_module_results GROUP BY 1, 2"


@query("pillar_scores", "fx_module_results", sql=f"SELECT session_id, pillar_n, R6(t, 6) AS t FROM ({PILLAR_SQL})")
def _pillars(m):
    return op.pillar_scores(m, "session_id", "pillar_n", 0.5).withColumn("t", round6("t"))


@query("weight_cap", "fx_module_results")
def _weight_cap(m):
    rows = m.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("module_n", "part_n", "supp_n", "score"))).alias("items"))
    return rows.select("session_id", F.transform(op.weight_cap(F.col("items.score")), round6).alias("weights"))


@query(
    "leave_one_out", "fx_module_results",
    sql=f"""WITH l AS ({LIST_SQL}), w AS (SELECT session_id, l, {_reduce_sql('l')} AS r FROM l)
      SELECT session_id, R6(COALESCE(list_max(list_transform(range(1, len(l) + 1), lambda i: abs(r.b + 0.3 * r.u - COALESCE({_reduce_sql("list_prepend({'b': 0.0, 'd': 0.0, 'u': 1.0, 'k': 0.0}, list_concat(l[1:i-1], l[i+1:]))").replace('lambda x, y', 'lambda x, y')}.b, 0) - 0.3 * {_reduce_sql("list_prepend({'b': 0.0, 'd': 0.0, 'u': 1.0, 'k': 0.0}, list_concat(l[1:i-1], l[i+1:]))")}.u))), 0), 6) AS change FROM w""",
)
def _leave_one_out(m):
    return op.evidence(m, "session_id", ORDER).select("session_id", round6(op.without_each(F.col("items.m"))).alias("change"))


@query("grouped_fusion", "fx_module_results")
def _grouped(m):
    """Technical engines by Murphy's rule, the other ones by Dempster's, then cautiously together."""
    rows = engine_lists(m)
    technical, blind = F.filter("items", lambda x: x["engine"] < 4), F.filter("items", lambda x: x["engine"] >= 4)
    both = rows.select("session_id", op.murphy(F.transform(technical, lambda x: x["m"])).alias("t"), op.dempster(F.transform(blind, lambda x: x["m"])).alias("s"))
    wide = lambda c: op.mass(F.col(f"{c}.b"), F.col(f"{c}.d"), F.col(f"{c}.u"))
    return both.select("session_id", op.cautious(wide("t"), wide("s")).alias("r"), (F.col("t.b") * F.col("s.d") + F.col("t.d") * F.col("s.b")).alias("cross")).select("session_id", *_rounded("r", "b", "d", "u"), round6("cross").alias("cross_conflict"))
