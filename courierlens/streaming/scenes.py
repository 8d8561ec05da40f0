"""Scenes as a table of versions, brought up to date by each micro-batch.

A version is a folder named by the batch that wrote it. A batch merges what it
found into the last complete version of an earlier batch, so a batch that is
run again writes the same version again: the folders are the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.operators.scenes import lifecycle

SCHEMA = "scene_type string, actor string, severity string, status string, first_seen timestamp, last_seen timestamp, mails long"
#: Versions that stay, so that a reader of the last one but one can finish.
KEPT = 3


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose versions are complete, in order."""
    p, fs = _path(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")[0]))


def scenes(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last version, or the last one of a batch before the given one; empty if there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(SCHEMA).parquet(f"{path}/batch={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def merged(path: str, find: Callable[[DataFrame], DataFrame], quiet_hours: int = 24) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: find's scenes (scene_type, actor, severity, first_seen, last_seen, mails) of a batch, merged into the table.

    A scene goes on from the severity, first time and number of mails that it
    has; its time is the greatest that the table or the batch knows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = scenes(spark, path, before=number)
        new = find(batch)
        total = new.join(old.select("scene_type", "actor", F.col("mails").alias("_had")), ["scene_type", "actor"], "left").withColumn("mails", F.col("mails") + F.coalesce("_had", F.lit(0))).drop("_had")
        now = new.select("last_seen").unionByName(old.select("last_seen")).agg(F.max("last_seen")).first()[0]
        lifecycle(old, total, F.lit(now), quiet_hours).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for v in [v for v in versions(spark, path) if v <= number][:-KEPT]:
            p, fs = _path(spark, f"{path}/batch={v}")
            fs.delete(p, True)

    return write
