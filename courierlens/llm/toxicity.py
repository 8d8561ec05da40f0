"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs, and pairs with one word between, of
a whole text, hashed into ``BUCKETS``. Each coordinate learns at its own rate
and L1 keeps most weights at zero; the weights are one array of a fixed size,
so they can be broadcast whatever the corpus.

The classifier is fitted on a bounded sample: at most about ``TRAIN_ROWS``
labelled rows, taken by a hash of their id. The sample is dealt over
``SHARDS`` tasks; each fits its part and the weights are averaged. One task is
enough for this bound and learns best from so few rows. Scoring runs over all
documents.

L1 shrinks the margins, so raw scores are too timid for a fixed threshold: a
first fit on four fifths of the sample is scored on the rest, a logistic curve
through those scores (Platt's scaling) is found, and its slope and offset are
laid into the weights of the fit on the whole sample.

Defined results: a null or empty text scores by the bias alone; rows with null
ids are scored and held_out is false; unlabelled rows and null labels teach
nothing; without labels of both kinds every score is the bias's; equal texts
have equal scores; texts of any length are read whole; repeated rows are scored
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import table
from courierlens.llm.words import WordHashes, mix, multiplier

BUCKETS = 1 << 18
#: Most labelled rows that the classifier is fitted on (in expectation).
TRAIN_ROWS = 16_000
SHARDS = 1
EPOCHS = 8
ALPHA, BETA = 0.5, 1.0
#: L1 as a share of the rows, and at least; a weight must be earned by a share of the sample.
L1_SHARE, L1_LEAST = 0.0025, 2.0
THRESHOLD = 0.7


def _core(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}<>#$%&*|") or word


def features(text: str | None, words: WordHashes) -> np.ndarray:
    """The buckets of a text's words, pairs and skip pairs; a bucket may repeat."""
    h = words.of(text)
    with np.errstate(over="ignore"):
        parts = [mix(h)]
        for gap in (1, 2):
            if len(h) > gap:
                parts.append(mix(h[:-gap] * multiplier(gap) + mix(h[gap:])))
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> np.ndarray:
    """Weights of one shard, the bias last. The order of rows is drawn anew for each epoch, by the seed."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, max(L1_LEAST, L1_SHARE * len(rows)))
    l1[-1] = 0.0

    def weight(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i = rows[r]
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weight(slice(None))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps; (1, 0) if it cannot be told."""
    if len(labels) < 50 or labels.min() == labels.max():
        return 1.0, 0.0
    up, down = labels.sum(), (1 - labels).sum()
    wanted = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack((margins, np.ones(len(margins))), 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - wanted))
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if 0 < at[0] < 20 else (1.0, 0.0)


def calibrated(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> np.ndarray:
    """ftrl() of all rows, with the slope and offset that a fit of four fifths of them has on the others."""
    rest = np.arange(len(rows)) % 5 == 0
    kept = [r for r, x in zip(rows, rest, strict=True) if not x]
    w = ftrl(rows, labels, seed)
    if kept and labels[~rest].min() != labels[~rest].max():
        part = ftrl(kept, labels[~rest], seed)
        slope, offset = platt(np.array([part[r].sum() for r, x in zip(rows, rest, strict=True) if x]), labels[rest])
        w = w * slope
        w[-1] += offset
    return w


def held_out(doc_id: str = "doc_id"):
    """True for the third of the rows that teaches nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The averaged weights, as float32, the bias last."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    share = min(1.0, train_rows / max(1, taught.count()))
    sample = taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # about train_rows rows, so it can be broadcast

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(_core)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [np.unique(features(t, words)) for t in part.column("text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))], ["doc_id", "toxic", "x"])

    def shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "toxic"], kind="stable")
        y = part["toxic"].to_numpy()
        if (y > 0).all() or (y <= 0).all():
            return pd.DataFrame({"i": np.array([], np.int32), "w": np.array([], float)})
        w = calibrated([np.append(x, BUCKETS) for x in part["x"]], (y > 0).astype(float), key[0])
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": at.astype(np.int32), "w": w[at]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = picked.select("doc_id", "toxic", "text").mapInArrow(of, "doc_id long, toxic int, x array<int>").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    learned = rows.groupBy("shard").applyInPandas(shard, "i int, w double").groupBy("i").agg(F.sum("w").alias("w"), F.count(F.when(F.col("i") == BUCKETS, 1)).alias("n")).toPandas()
    weights = np.zeros(BUCKETS + 1, np.float32)
    if len(learned):
        weights[learned["i"].to_numpy()] = learned["w"].to_numpy() / max(1, int(learned["n"].max()))
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = WordHashes(_core), held.value
        live = w[:-1] != 0

        def one(text: str | None) -> float:
            x = features(text, words)
            x = np.unique(x[live[x]])
            return float(1 / (1 + np.exp(-np.clip(float(w[x].sum(dtype=np.float64)) + float(w[-1]), -35, 35))))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([one(t) for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and whether its label could have been learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
