"""Whitening of embeddings over weighted distinct vectors.

Entries are put on an integer grid, so vectors that fall on the same points are
one vector. Each distinct vector enters the fit once, with a weight: the number
of its rows, or one. Sums are exact integers; the covariance is a product of
matrices centred before they are multiplied, one part for each task; the few
numbers of it (dimensions squared) go to the driver, which takes its
eigenvectors. Each distinct vector is whitened once and joined back to its rows.

Defined results: vectors that are null, empty, or hold null or non-finite
entries, or entries whose grid point is beyond 2^53, are dropped; so are
vectors of another length than most have (of equally frequent lengths the
longest); rows with a null id and repeated rows are fitted and come out like
any others; components without variance (up to rounding) do not exist, so a
table of one distinct vector, or an empty one, gives no rows; a deviation
beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import remove, spread_join, table, written

#: Grid points in one, and the point of nought.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows that one matrix product works on.
BLOCK_ROWS = 4096
_HALF = 32


def _matrices(column: pa.Array, dims: int) -> np.ndarray:
    """The grid points of a batch, one row for each vector."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def on_grid(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, key, x) of the valid rows: x the grid points as packed longs, key a digest of them."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, points = [], [], []
            lists = batch.column("embedding")
            whole = lists.flatten()
            flat, bad = whole.to_numpy(zero_copy_only=False).astype(np.float64), whole.is_null().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.floor(scale * flat)
                bad |= ~(np.abs(grid) < 2.0**53)
            grid[bad] = 0
            whole_x, wrong = grid.astype(np.int64) + offset, np.concatenate(([0], np.cumsum(bad)))
            for i, a, b in zip(batch.column("vec_id").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if a < b and wrong[a] == wrong[b]:
                    x = whole_x[a:b].tobytes()
                    ids.append(i)
                    points.append(x)
                    keys.append(xxhash.xxh3_128_digest(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(points, pa.binary())], ["vec_id", "key", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(of, "vec_id long, key binary, x binary")


def _sums(distinct: DataFrame, dims: int) -> np.ndarray:
    """The weighted sum of each dimension, as whole numbers of any size; one row a dimension comes to the driver."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x, w = _matrices(batch.column("x"), dims), batch.column("weight").to_numpy()
            high += w @ (x >> _HALF)
            low += w @ (x & ((1 << _HALF) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = distinct.select("x", "weight").mapInArrow(of, "i int, high long, low long")
    rows = parts.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
    out = np.zeros(dims, object)
    for r in rows:
        out[r["i"]] = (int(r["high"]) << _HALF) + int(r["low"])
    return out


class Centre:
    """The mean of a fit list: sums of whole numbers over n."""

    def __init__(self, sums: np.ndarray, n: int):
        self.sums, self.n = sums, n
        near = [(2 * int(s) + n) // (2 * n) for s in sums]  # the nearest whole number
        self.near = np.array(near, np.int64)
        self.rest = np.array([(int(s) - n * m) / n for s, m in zip(sums, near, strict=True)])

    def minus(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the large parts cancel as whole numbers."""
        return (x - self.near) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over the dimensions of (n x - sums)^2 of each row, exactly."""
        moved, rest = x - self.near, np.array([int(s) - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)], object)
        most = self.n * (int(np.abs(moved).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2**63:
            d = self.n * moved - rest.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * moved.astype(object) - rest
        return [v if v < 2**63 else None for v in (d * d).sum(1)]


def _products(rows: DataFrame, value: str, dims: int, read) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums, and sums of products, of the matrices that ``read`` makes of the column; dims + dims^2 numbers come to the driver."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                d, w = read(part.column(value)), part.column("weight").to_numpy().astype(np.float64)
                weighted = d.T * w
                total[:, 0] += weighted.sum(1)
                total[:, 1:] += weighted @ d
        i, j = np.divmod(np.arange(total.size), dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    parts = rows.select(value, "weight").mapInArrow(of, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dims, dims + 1))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out[:, 0], out[:, 1:]


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the entry of largest size is positive. Those without variance are left out."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    keep = e > max(e[0], 0) * len(e) * np.finfo(float).eps
    e, v = e[keep][:most], v[:, keep][:, :most]
    return e, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def whitened(vectors: DataFrame, most: int = COMPONENTS, weights: str = "count", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every valid row of (vec_id, embedding).

    ``weights`` is "count", the rows of each distinct vector, or "one". n is
    the weight of the fit list; whitened and explained have an entry for each
    of the first ``most`` components; identity_error is how far the covariance
    of the whitened fit list is from the identity. The result reads a table in
    the shared folder, which ``tables.remove`` deletes.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights is count or one")
    spark = vectors.sparkSession
    out_schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    rows = written(on_grid(vectors, scale, offset), "grid")
    lengths = rows.groupBy(F.octet_length("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        remove(rows)
        return spark.createDataFrame([], out_schema)
    dims = lengths["length"] // 8
    valid = rows.filter(F.octet_length("x") == lengths["length"])
    counted = valid.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(counted.withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("long")), "distinct")
    n = distinct.agg(F.sum("weight").alias("n")).first()["n"]
    centre = Centre(_sums(distinct, dims), n)
    covariance = _products(distinct, "x", dims, lambda column: centre.minus(_matrices(column, dims)))[1] / n
    e, axes = components(covariance, most)
    if not len(e):
        remove(rows, distinct)
        return spark.createDataFrame([], out_schema)
    project = spark.sparkContext.broadcast((centre, axes / np.sqrt(e)))  # dims x components numbers

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, onto = project.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrices(part.column("x"), dims)
                y = mean.minus(x) @ onto
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), part.column("weight"), pa.array(mean.deviations(x), pa.int64()), lists], ["key", "copies", "weight", "deviation", "whitened"])

    each = written(distinct.mapInArrow(of, "key binary, copies long, weight long, deviation long, whitened array<double>"), "whitened")
    k = len(e)
    sums, products = _products(each, "whitened", k, lambda column: column.flatten().to_numpy().reshape(-1, k))
    mean = sums / n
    error = float(np.abs(products / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = (e / np.trace(covariance)).tolist()
    joined = spread_join(valid.select("vec_id", "key"), each.drop("weight"), ["key"], "copies", "vec_id")
    out = joined.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
    remove(distinct)
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every valid embedding and component, up to 32 of them."""
    rows = whitened(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("component") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
