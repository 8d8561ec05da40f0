"""Training-table jobs: labels, folds, weights, metrics, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fewest rows that a training run is made of.
ENOUGH_ROWS = 30


def merged_rare(samples: DataFrame, least: int = 3, other: int = 4, label: str = "label", enough: int = ENOUGH_ROWS) -> DataFrame:
    """samples with the labels of fewer than ``least`` rows turned into ``other``; nothing if there are under ``enough`` rows in all."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar()
    rows = samples.join(counts, label, "left").filter(total >= enough)
    return rows.withColumn(label, F.when(F.col("_n") < least, other).otherwise(F.col(label))).drop("_n")


def folds(samples: DataFrame, k: int | None = None, key: str = "doc_id", label: str = "label") -> DataFrame:
    """samples with a fold in [0, k), dealt evenly within each label by the order of a hash; k follows from the counts if it is not given.

    Rows are numbered within (label, hash bucket) and the buckets' sizes are
    added up, so one label never has to be sorted by one task.
    """
    rows = samples.withColumn("_h", F.xxhash64(F.col(key))).withColumn("_b", F.pmod("_h", F.lit(256)))
    sizes = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if k is None:
        per = sizes.groupBy(label).agg(F.sum("_n").alias("n"))
        many = per.agg(fold_count(F.sum("n"), F.min("n")).cast("long").alias("k")).scalar()
    else:
        many = F.lit(k)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    numbered = rows.withColumn("_i", within).join(before, [label, "_b"])
    return numbered.withColumn("fold", F.pmod(F.col("_before") + F.col("_i") - 1, many).cast("int")).drop("_h", "_b", "_before", "_i")


def fold_count(n_rows: Column, smallest: Column) -> Column:
    """Five folds from 60 rows on, else three; no more than the smallest class has rows, and at least two."""
    return F.greatest(F.lit(2), F.least(F.when(n_rows >= 60, 5).otherwise(3), smallest))


def class_weights(samples: DataFrame, classes: int = 5, label: str = "label") -> DataFrame:
    """(label, n, weight, target): inverse-frequency weights, and the size that rare classes are brought to."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.max("n").alias("most")).alias("t")).scalar()
    return counts.select(label, "n", (totals["n"] / (classes * F.col("n"))).alias("weight"), F.greatest(F.lit(10), F.floor(totals["most"] / 4)).cast("long").alias("target"))


def fold_weights(dealt: DataFrame, classes: int = 5, label: str = "label", fold: str = "fold") -> DataFrame:
    """(fold, label, n, weight, target) of the rows that each fold is trained on, which are those of all others."""
    cells = dealt.groupBy(fold, label).agg(F.count(F.lit(1)).alias("_n"))  # folds times labels
    whole = cells.groupBy(label).agg(F.sum("_n").alias("_all"))
    folds_ = cells.agg(F.collect_set(fold).alias("f")).scalar()
    every = whole.withColumn(fold, F.explode(folds_)).join(cells, [fold, label], "left")
    rows = every.withColumn("n", F.col("_all") - F.coalesce("_n", F.lit(0))).filter("n > 0")
    of_fold = Window.partitionBy(fold)
    weight = F.sum("n").over(of_fold) / (classes * F.col("n"))
    target = F.greatest(F.lit(10), F.floor(F.max("n").over(of_fold) / 4)).cast("long")
    return rows.select(fold, label, "n", weight.alias("weight"), target.alias("target"))


def metrics(predictions: DataFrame, label: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each fold): accuracy, balanced accuracy, macro F1, and whether both pass their gates (.50 and .40)."""
    cells = predictions.groupBy(*by, label, predicted).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    true = F.struct(F.col(label).alias("c"), F.col("n").alias("support"), zero.alias("guessed"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("right"))
    guess = F.struct(F.col(predicted).alias("c"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("right"))
    per = cells.select(*by, F.explode(F.array(true, guess)).alias("x")).select(*by, "x.*").groupBy(*by, "c").agg(*(F.sum(v).alias(v) for v in ("support", "guessed", "right")))
    recall = F.when(F.col("support") > 0, F.col("right") / F.col("support"))
    f1 = F.when(F.col("support") > 0, 2 * F.col("right") / (F.col("support") + F.col("guessed")))
    out = per.groupBy(*by).agg((F.sum("right") / F.sum("support")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
    return out.withColumn("passes", (F.col("balanced_accuracy") >= 0.50) & (F.col("macro_f1") >= 0.40))


def over_folds(predictions: DataFrame, label: str = "label", predicted: str = "predicted", fold: str = "fold") -> DataFrame:
    """One row: the mean and the standard deviation of each metric over the folds, and whether the means pass the gates."""
    each = metrics(predictions, label, predicted, (fold,))
    names = ("accuracy", "balanced_accuracy", "macro_f1")
    out = each.agg(F.count(F.lit(1)).alias("folds"), *(f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    return out.withColumn("passes", (F.col("balanced_accuracy_mean") >= 0.50) & (F.col("macro_f1_mean") >= 0.40))


def augmented(samples: DataFrame, targets: DataFrame, label: str = "label", text: str = "text", key: str = "doc_id") -> DataFrame:
    """samples and, of labels under their target (label, n, target), copies with a tenth of the words left out, chosen by a hash."""
    short = targets.filter("n < target").select(label, F.ceil((F.col("target") - F.col("n")) / F.col("n")).cast("int").alias("_k"))
    copies = samples.join(short, label).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    kept = F.filter(F.split(F.col(text), " "), lambda w, i: F.pmod(F.xxhash64(F.col(key), F.col("_c"), i, w), F.lit(10)) != 0)
    more = copies.withColumn(text, F.array_join(kept, " ")).select(*samples.columns, F.col("_c").alias("copy"))
    return samples.withColumn("copy", F.lit(0)).unionByName(more)


def training_text(rows: DataFrame, sender: str, subject: str, body: str, longest: int = 3000) -> DataFrame:
    """rows with ``sample`` (sender, subject and body, cut to the model's input size) and its language by script."""
    whole = F.substr(F.concat_ws("\n", F.concat(F.lit("From: "), F.col(sender)), F.concat(F.lit("Subject: "), F.col(subject)), F.col(body)), F.lit(1), F.lit(longest))
    han = F.length(F.regexp_replace(whole, "[^\\x{4E00}-\\x{9FFF}]", ""))
    return rows.withColumn("sample", whole).withColumn("language", F.when(han > 0.3 * F.length("sample"), "zh").otherwise("en"))
