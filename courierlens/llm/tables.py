"""Corpus tables, tables written into the shared folder, and joins that deal out frequent keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.shared import remove, written  # noqa: F401

#: A key with more than one in HOT_SHARE of all rows is dealt over SALTS tasks; there are fewer than HOT_SHARE such keys.
HOT_SHARE, SALTS = 1000, 64
#: Bits of a bitmap of hashes, at most (16 MB); with more hashes than fit, more pass it, and the join behind it decides.
BITMAP_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One corpus table; every query reads the whole of it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, spread: str) -> DataFrame:
    """rows joined with keyed, which has each key once and in ``count`` the number of its rows.

    Rows of a frequent key are dealt by a hash of ``spread`` over SALTS tasks,
    and its one row of keyed is sent to each. The frequent keys can be
    broadcast: whatever the data, they number less than HOT_SHARE.
    """
    frequent = F.col(count) * HOT_SHARE > F.greatest(keyed.agg(F.sum(count).alias("s")).scalar(), F.lit(HOT_SHARE * SALTS))
    hot = keyed.filter(frequent).select(*on, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    each = F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("_salt", F.explode(each)), [*on, "_salt"]).drop("_salt")


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Which remainders a column of 64-bit hashes has: 8 bits for each row of the table, or BITMAP_BITS.

    It tells rows that a join would drop before they are shuffled; its size is
    bounded whatever the data.
    """
    bits = min(BITMAP_BITS, 1 << max(10, (8 * hashes.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")))
    found = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(word.alias("word")).toArrow()  # at most BITMAP_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these signed 64-bit hashes the bitmap has."""
    at = hashes & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
