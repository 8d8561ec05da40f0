"""Substring dedup by content-defined chunks.

A gear rolling hash, which looks at the last bytes only, picks chunk borders
from the content itself, so an insertion moves borders near it and no others.
Chunks are compared by a 96-bit digest over all documents; runs of chunks that
also occur in another document form a span.

Digests are counted with partial aggregation before the shuffle, so a passage
that millions of documents share is one row per task. A bitmap of the shared
digests then lets only chunks travel that may be shared, and the rows of a very
frequent digest are dealt over many tasks.

Defined results: null and empty texts have no chunks; rows of one doc_id are one
document; null ids take no part; an exact copy of a document is one span; spans
under ``MIN_CHARS`` characters are left alone; of equal chunks the one in the
smallest doc_id is the first; texts of any length are read whole; other columns,
whatever their names, pass through ``deduplicated`` untouched; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courierlens.llm.tables import bitmap, passes, remove, spread_join, table, written
from courierlens.llm.words import mix

#: Least and most bytes of a chunk, and the bits of the hash that make a border (2**-BORDER_BITS of all places).
MIN_BYTES, MAX_BYTES, BORDER_BITS = 20, 128, 3
#: Least characters of a span that counts as a repeated passage.
MIN_CHARS = 90

with np.errstate(over="ignore"):
    _GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the gear values of the last 32 bytes, doubled once for each step back."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h = h.copy()
            h[step:] += h[:-step] << np.uint32(step)
    return h


def borders(data: np.ndarray) -> list[int]:
    """Where chunks end; never inside a character."""
    n = len(data)
    at = np.flatnonzero((gear(data) >> np.uint32(16)) & np.uint32((1 << BORDER_BITS) - 1) == 0) + 1
    starts = (data & 0xC0) != 0x80
    out, last = [], 0
    for c in [*at.tolist(), n]:
        while c - last > MAX_BYTES:
            cut = last + MAX_BYTES
            while not starts[cut]:
                cut -= 1
            out.append(cut)
            last = cut
        if c - last >= MIN_BYTES or c == n:
            while c < n and not starts[c]:
                c += 1
            if c > last:
                out.append(c)
                last = c
    return out


_CHUNKS = pa.schema([("d1", pa.int64()), ("d2", pa.int32()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])


def chunks(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """One row for each chunk: its digest (a long and an int), document, number, and place in characters (from 0).

    wanted: a bitmap of the first parts of digests; other chunks are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                digests, ids, nth, start, size = [], [], [], [], []
                for i, text in zip(batch.column("doc_id")[at : at + 64].to_pylist(), batch.column("text")[at : at + 64].to_pylist(), strict=True):
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    ends = borders(data)
                    begins = [0, *ends[:-1]]
                    digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, ends, strict=True)]
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))).astype(np.int32)
                    ids.append(np.full(len(ends), i, np.int64))
                    nth.append(np.arange(len(ends), dtype=np.int32))
                    start.append(chars[begins])
                    size.append(chars[ends] - chars[begins])
                if digests:
                    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    columns = [both[:, 0], both[:, 1].astype(np.int32), *map(np.concatenate, (ids, nth, start, size))]
                    if held is not None:
                        hit = passes(held.value, columns[0])
                        columns = [c[hit] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_CHUNKS)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''")
    return picked.mapInArrow(of, "d1 long, d2 int, doc_id long, nth int, start int, size int")


def repeated_spans(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, start, length, n_chunks, removed_chars, first_doc_ids): runs of chunks that also occur in another document.

    first_doc_ids are the first documents of the run's chunks; removed_chars
    counts the characters whose first document is an earlier one.
    """
    ends = chunks(docs).groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("rows"))
    shared = written(ends.filter("first_doc <> last_doc").select("d1", "d2", "first_doc", "rows"), "shared")
    rows = chunks(docs, bitmap(shared, "d1"))
    met = written(spread_join(rows, shared, ["d1", "d2"], "rows", "doc_id").select("doc_id", "nth", "start", "size", "first_doc"), "met")
    remove(shared)
    in_order = Window.partitionBy("doc_id").orderBy("nth")
    runs = met.withColumn("run", F.col("nth") - F.dense_rank().over(in_order)).distinct()
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        F.sum("size").alias("length"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.when(F.col("first_doc") < F.col("doc_id"), F.col("size")).otherwise(0)).alias("removed_chars"),
        F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids"),
        F.collect_list(F.when(F.col("first_doc") < F.col("doc_id"), F.struct("start", "size"))).alias("removed"),
    )
    return spans.filter(F.col("length") >= min_chars).drop("run")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with every repeated chunk of a span cut out of ``text``, save in its first document."""
    spans = repeated_spans(docs, min_chars)
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed"))))
    cuts = spans.groupBy(F.col("doc_id").alias("id")).agg(each.alias("cuts")).filter(F.size("cuts") > 0)
    text = F.col("row.text").cast("string")
    last = lambda i: F.get("cuts", i - 1)
    begin = lambda i: F.when(i == 0, 0).otherwise(last(i)["start"] + last(i)["size"])
    end = F.struct(F.length(text).alias("start"), F.lit(0).alias("size"))
    kept = F.transform(F.concat("cuts", F.array(end)), lambda c, i: F.substr(text, begin(i) + 1, c["start"] - begin(i)))
    left = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    return rows.join(cuts, "id", "left").select(*((left if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage with another one: how much, and with which first documents."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum("n_chunks").alias("n_chunks"),
        F.sum("length").alias("repeated_chars"),
        F.sum("removed_chars").alias("removed_chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"),
    )
