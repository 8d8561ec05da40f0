"""Indicator tables in CSV: import with an error report, and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("ip", "domain", "url", "email", "hash", "subject")
VERDICTS = ("malicious", "suspicious", "clean")
SCHEMA = "indicator string, ioc_type string, verdict string, confidence string, source string, attack_type string"


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, (row, error) of the others); the confidence becomes a number, 0.5 where it is missing."""
    confidence = F.coalesce(F.col("confidence").try_cast("double"), F.when(F.col("confidence").isNull(), 0.5))
    ip = F.col("indicator").rlike("^([0-9]{1,3}[.]){3}[0-9]{1,3}$|:")
    error = (
        F.when(F.coalesce(F.trim("indicator"), F.lit("")) == "", "no indicator")
        .when(~F.coalesce(F.col("ioc_type").isin(*TYPES), F.lit(False)), "unknown type")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when(confidence.isNull() | (confidence < 0) | (confidence > 1), "confidence outside 0 to 1")
        .when((F.col("ioc_type") == "ip") & ~ip, "not an address")
    )
    checked = rows.withColumn("_error", error)
    good = checked.filter("_error is null").drop("_error").withColumns({"indicator": F.lower(F.trim("indicator")), "confidence": confidence})
    return good, checked.filter("_error is not null").withColumnRenamed("_error", "error")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return validated(spark.read.csv(path, schema=SCHEMA, header=True))


def csv_line(*columns: str) -> Column:
    """A line of CSV: every field quoted, quotes in it doubled, nulls empty."""
    quoted = (F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns)
    return F.concat_ws(",", *quoted)


def exported(iocs: DataFrame, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """The indicators of some verdicts, with ``line``, their line of CSV over all columns."""
    return iocs.filter(F.col("verdict").isin(*verdicts)).withColumn("line", csv_line(*iocs.columns))


def write_csv(iocs: DataFrame, path: str, verdicts: Sequence[str] = VERDICTS) -> None:
    """Write the indicators of some verdicts; every field is quoted."""
    exported(iocs, verdicts).drop("line").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def upserted(old: DataFrame, new: DataFrame, owners: Sequence[str] = ("admin_clean", "system")) -> DataFrame:
    """old merged with newer rows by (type, indicator): hits add up and the latest wins, but what an owner wrote only owners change."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # an owner's row outranks any other; among equals, the newest
    place = F.struct(F.col("source").isin(*owners).cast("int"), "_new", F.col("last_seen"))
    keep = [F.max_by(c, place).alias(c) for c in ("verdict", "confidence", "source")]
    attack = F.max_by("attack_type", F.when(F.coalesce("attack_type", F.lit("")) != "", F.struct("_new", "last_seen")))
    return both.groupBy("ioc_type", "indicator").agg(*keep, attack.alias("attack_type"), F.sum("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("expires_at").alias("expires_at"))
