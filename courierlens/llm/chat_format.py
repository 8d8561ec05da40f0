"""Preference formatting of chosen and rejected conversations (DataFrame functions only).

A pair is two conversations under one key. Their longest common prefix of turns
is rendered once, as the prompt; what follows is rendered as two completions.
Each completion comes with a mask of character spans: only what an assistant
says, and the marker that ends its turn, is trained on.

Defined results: turns are ordered by turn number (null first), role and text, so
repeated rows stand side by side; a null role or text counts as empty; a null
key or conversation of one side only gives no pair; equal conversations, or one
that is a prefix of the other, give an empty completion; texts of any length
are rendered whole, and a conversation must fit into a task; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courierlens.llm.quality_rules import bound
from courierlens.llm.tables import remove, table, written

#: The turn markers of the rendered form.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns of each conversation in order, as structs of role and text."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return ordered.select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of first turns that two conversations have in common."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get(a, i) != F.get(b, i)))
    return F.array_min(differs)


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """Spans [start, end) of the rendered turns, in characters, that are trained on."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(header(t)).alias("h"), (F.length(t["text"]) + len(CLOSE)).alias("b"), (t["role"] == "assistant").alias("on")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        begin, end = state["at"] + s["h"], state["at"] + s["h"] + s["b"]
        more = F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(s["on"], more).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(sizes, empty, step, lambda s: s["spans"])


def preference_rows(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """From (key, chosen, rejected), arrays of turns: prompt, completions and their trained spans."""

    def formatted(n: Column) -> Column:
        rest = lambda x: F.slice(F.col(x), n + 1, F.greatest(F.size(x) - n, F.lit(0)))
        return F.struct(
            n.alias("n_common"),
            rendered(F.slice("chosen", F.lit(1), n)).alias("prompt"),
            *(part.alias(name) for x in ("chosen", "rejected") for part, name in ((bound(rest(x), rendered), f"{x}_completion"), (bound(rest(x), trained_spans), f"{x}_spans"))),
        )

    rows = pairs.select(key, bound(common_prefix(F.col("chosen"), F.col("rejected")), formatted).alias("r"))
    return rows.select(key, "r.*")


def next_ids(ids: DataFrame) -> DataFrame:
    """(conv_id, next_id) of distinct ids in their order; the last one is followed by the first.

    Ids are dealt by ranges, each range is ordered by itself, and the one row
    of each range that has nothing after it takes the first id of the next
    range. Those first ids number no more than the partitions.
    """
    ranges = written(ids.repartitionByRange("conv_id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranges.groupBy("range").agg(F.min("conv_id").alias("first"))
    first = firsts.agg(F.min("first").alias("first")).scalar()
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"))  # one row for each partition
    following = F.lead("conv_id").over(Window.partitionBy("range").orderBy("conv_id"))
    rows = ranges.withColumn("next_id", following).join(F.broadcast(after), "range")
    out = written(rows.select("conv_id", F.coalesce("next_id", "after", first).alias("next_id")), "next")
    remove(ranges)
    return out


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: (conv_id, chosen, rejected).

    The rejected side has its last assistant turn replaced by that of the
    conversation of the next id, which makes a fluent reply that does not fit;
    the last one takes that of the first. A conversation without an assistant
    gives no pair, nor does the only one of a table.
    """
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    having = conversations_of(turns).withColumn("at", last).filter("at is not null")
    order = next_ids(turns.filter("conv_id is not null and role = 'assistant'").select("conv_id").distinct()).filter("conv_id <> next_id")
    replies = having.select(F.col("conv_id").alias("next_id"), F.get("turns", F.col("at"))["text"].alias("other"))
    rows = having.join(order.join(replies, "next_id"), "conv_id")
    turned = F.transform("turns", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return rows.select("conv_id", F.col("turns").alias("chosen"), turned.alias("rejected"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair: the shared prompt and both masked completions."""
    return preference_rows(swapped_replies(table(spark, sf_dir, "conversations"))).select(
        "conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", "rejected_completion",
        *(F.array_join(F.transform(f"{x}_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(f"{x}_mask") for x in ("chosen", "rejected")),
    )


OP6_SQL = """
WITH t AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, max(i) AS at FROM t WHERE role = 'assistant' GROUP BY conv_id
), r AS (
  SELECT l.conv_id, l.at, t.text AS reply FROM l JOIN t ON l.conv_id = t.conv_id AND l.at = t.i
), o AS (
  SELECT *, COALESCE(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS other, count(*) OVER () AS n
  FROM r
), p AS (
  SELECT t.conv_id, t.i, t.role, t.text AS c, CASE WHEN t.i = o.at THEN o.other ELSE t.text END AS j
  FROM t JOIN o ON t.conv_id = o.conv_id WHERE o.n > 1
), q AS (
  SELECT *, COALESCE(min(CASE WHEN c <> j THEN i END) OVER (PARTITION BY conv_id), max(i) OVER (PARTITION BY conv_id) + 1) AS k,
         '<|' || role || '|>' || chr(10) AS h
  FROM p
), s AS (
  SELECT *, h || c || '<|end|>' || chr(10) AS rc, h || j || '<|end|>' || chr(10) AS rj FROM q
), u AS (
  SELECT *, sum(CASE WHEN i >= k THEN length(rc) ELSE 0 END) OVER w AS ec, sum(CASE WHEN i >= k THEN length(rj) ELSE 0 END) OVER w AS ej
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, CAST(min(k) AS BIGINT) AS n_common,
       COALESCE(string_agg(CASE WHEN i < k THEN rc END, '' ORDER BY i), '') AS prompt,
       COALESCE(string_agg(CASE WHEN i >= k THEN rc END, '' ORDER BY i), '') AS chosen_completion,
       COALESCE(string_agg(CASE WHEN i >= k THEN rj END, '' ORDER BY i), '') AS rejected_completion,
       COALESCE(string_agg(CASE WHEN i >= k AND role = 'assistant' THEN CAST(ec - length(rc) + length(h) AS VARCHAR) || '-' || CAST(ec AS VARCHAR) END, ',' ORDER BY i), '') AS chosen_mask,
       COALESCE(string_agg(CASE WHEN i >= k AND role = 'assistant' THEN CAST(ej - length(rj) + length(h) AS VARCHAR) || '-' || CAST(ej AS VARCHAR) END, ',' ORDER BY i), '') AS rejected_mask
FROM u GROUP BY conv_id
"""
