"""Cool-downs: which events a waiting time after the last one taken lets through.

The event that follows a taken one is the first at or after its time plus the
waiting time. With time cut into blocks of that length it lies in the next
block, or is the first one after it, so each event finds its successor with
two blocks in sight. The successors are followed from the events that are taken
in any case, by pointer doubling: in round k the first 2^k events of every
chain are known, and pointers that jump 2^k events ahead find as many more.
No run of events becomes an array, and none is ordered beyond a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierlens.operators.states import numbered
from courierlens.shared import cut, remove, written


def _successors(rows: DataFrame, wait: int) -> DataFrame:
    """rows (_key, _segment, n, _u, _chunk, _upto) with ``next``, the number of the first event at or after their own time plus the wait."""
    events = rows.select("_key", F.col("_chunk").alias("_c"), F.col("_u").alias("_at"), F.lit(1).alias("_event"), F.lit(None).cast("long").alias("_segment"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("_upto"))
    asking = rows.select("_key", (F.col("_chunk") + 1).alias("_c"), (F.col("_u") + wait).alias("_at"), F.lit(0).alias("_event"), "_segment", "n", "_upto")
    earlier = F.coalesce(F.sum("_event").over(Window.partitionBy("_key", "_c").orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    met = events.unionByName(asking).withColumn("_earlier", earlier).filter("_event = 0")
    return met.select("_key", "_segment", "n", (F.col("_upto") + F.col("_earlier") + 1).alias("next"))


def _chains(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(_key, _segment, n) of all events that pointers (_key, _segment, n, next) lead to from the starts, themselves included."""
    node = ["_key", "_segment", "n"]
    parts, jumps = [written(starts.select(*node), "known")], written(pointers, "jumps")
    while True:
        # what a round finds is written by itself, so what was known is not written again
        known = reduce(DataFrame.unionByName, parts)
        found = written(known.join(jumps, node).select("_key", "_segment", F.col("next").alias("n")), "known")
        if found.isEmpty():
            remove(jumps, found)
            return known
        parts.append(found)
        ahead = jumps.select("_key", "_segment", F.col("n").alias("next"), F.col("next").alias("_further"))
        following = written(jumps.join(ahead, ["_key", "_segment", "next"]).select(*node, F.col("_further").alias("next")), "jumps")
        remove(jumps)
        jumps = following


def taken(rows: DataFrame, keys: Sequence[str], seconds: float, gap: float | None = None, resets: Column | None = None) -> DataFrame:
    """The rows (with t in seconds, and id) that a cool-down after the last taken row of their keys lets through.

    Rows after a gap of ``gap`` seconds (by default of the cool-down) are taken
    in any case, and so are those that ``resets`` says; the cool-down begins
    anew with them. Null keys are equal.
    """
    wait = round(seconds * 1_000_000)
    micros = rows.withColumns({"_key": F.struct(*keys), "_u": F.round(F.col("t") * 1_000_000).cast("long")})
    at = numbered(micros, "_key", ("_u", "id"), F.call_function("div", F.col("_u") - F.pmod(F.col("_u"), F.lit(wait)), F.lit(wait)))
    fresh = F.coalesce(F.col("_u") - F.col("previous") >= round((gap or seconds) * 1_000_000), F.lit(True))
    begins = at.withColumn("_start", (fresh if resets is None else fresh | F.coalesce(resets, F.lit(False))).cast("int"))
    # the segment of an event: how many starts there are up to it
    chunks = begins.groupBy("_key", "_chunk").agg(F.sum("_start").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("_start").over(Window.partitionBy("_key", "_chunk").orderBy("_u", "id").rowsBetween(Window.unboundedPreceding, 0))
    counted = begins.join(chunks.select("_key", "_chunk", before.alias("_earlier")), ["_key", "_chunk"]).withColumn("_segment", F.col("_earlier") + within).drop("_earlier")
    # a checkpoint makes its last stage twice; but columns of no type are not for files
    placed = cut(counted) if "void" in counted.schema.simpleString() else written(counted, "placed")
    there = placed.select("_key", "_segment", F.col("n").alias("next"))
    pointers = _successors(placed, wait).join(there, ["_key", "_segment", "next"])  # those within a segment
    chosen = _chains(placed.filter("_start = 1"), pointers)
    return placed.join(chosen, ["_key", "_segment", "n"], "left_semi").select(*rows.columns)
