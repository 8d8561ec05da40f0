"""Training-table queries: labels joined to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import training as op
from courierlens.plans.registry import query

SAMPLES_SQL = "SELECT d.doc_id, d.lang, d.source, d.text, l.quality + 2 * l.toxic AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _samples(labels, docs):
    return labels.join(docs, "doc_id").select("doc_id", "lang", "source", "text", (F.col("quality") + 2 * F.col("toxic")).alias("label"))


@query("training_samples", "labels", "documents", sql=f"SELECT doc_id, lang, label FROM ({SAMPLES_SQL})")
def _training_samples(x, d):
    return _samples(x, d).select("doc_id", "lang", "label")


@query("training_text", "documents", sql="SELECT doc_id, sample, 'en' AS language FROM (SELECT doc_id, substr('From: ' || source || chr(10) || 'Subject: ' || lang || chr(10) || text, 1, 3000) AS sample FROM documents)")
def _training_text(d):
    return op.training_text(d, "source", "lang", "text").select("doc_id", "sample", "language")


@query("merge_rare_classes", "labels", "documents", sql=f"WITH s AS ({SAMPLES_SQL}), c AS (SELECT label, COUNT(*) AS n FROM s GROUP BY 1) SELECT CASE WHEN c.n < 30 THEN 4 ELSE s.label END AS label, COUNT(*) AS n FROM s JOIN c ON c.label = s.label WHERE (SELECT COUNT(*) FROM s) >= 30 GROUP BY 1")
def _rare(x, d):
    return op.merged_rare(_samples(x, d), 30).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", "labels", "documents")
def _folds(x, d):
    return op.folds(_samples(x, d).select("doc_id", "label"))


@query(
    "class_weights", "labels",
    sql="""WITH d AS (SELECT doc_id % 5 AS fold, quality + 2 * toxic AS label FROM labels), f AS (SELECT DISTINCT fold FROM d),
      c AS (SELECT f.fold, d.label, COUNT(*) AS n FROM f JOIN d ON d.fold <> f.fold GROUP BY 1, 2), t AS (SELECT *, SUM(n) OVER (PARTITION BY fold) AS total, MAX(n) OVER (PARTITION BY fold) AS most FROM c)
      SELECT CAST(fold AS INT) AS fold, label, n, R6(total / (5 * n), 6) AS weight, CAST(greatest(10, floor(most / 4)) AS BIGINT) AS target FROM t""",
)
def _weights(x):
    dealt = x.select((F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("quality") + 2 * F.col("toxic")).alias("label"))
    return op.fold_weights(dealt).withColumn("weight", round6("weight"))


@query(
    "fold_metrics", "labels", "documents",
    sql=f"""WITH p AS (SELECT doc_id % 5 AS fold, label, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE label END AS predicted FROM ({SAMPLES_SQL})), c AS (SELECT DISTINCT fold, label AS c FROM p),
      m AS (SELECT fold, c, (SELECT COUNT(*) FROM p WHERE label = c AND p.fold = c.fold) AS s, (SELECT COUNT(*) FROM p WHERE predicted = c AND p.fold = c.fold) AS g, (SELECT COUNT(*) FROM p WHERE label = c AND predicted = c AND p.fold = c.fold) AS r FROM c),
      e AS (SELECT fold, SUM(r) / SUM(s) AS a, AVG(r / s) AS b, AVG(2 * r / (s + g)) AS f FROM m GROUP BY 1)
      SELECT COUNT(*) AS folds, R6(AVG(a), 6) AS accuracy_mean, R6(stddev_pop(a), 6) AS accuracy_std, R6(AVG(b), 6) AS balanced_accuracy_mean, R6(stddev_pop(b), 6) AS balanced_accuracy_std, R6(AVG(f), 6) AS macro_f1_mean, R6(stddev_pop(f), 6) AS macro_f1_std,
        AVG(b) >= 0.5 AND AVG(f) >= 0.4 AS passes FROM e""",
)
def _metrics(x, d):
    rows = _samples(x, d).select((F.col("doc_id") % 5).alias("fold"), "label", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("label")).alias("predicted"))
    out = op.over_folds(rows)
    return out.select("folds", *(round6(c).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))), "passes")


@query("augment_rare", "labels", "documents")
def _augment(x, d):
    samples = _samples(x, d)
    return op.augmented(samples, op.class_weights(samples)).select("doc_id", "label", "copy", "text")
