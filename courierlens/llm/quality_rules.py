"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. ``ledger`` stores the measurements
and one failure bit per rule; policies are versioned masks over those bits, so
a new policy, or the effect of leaving a rule out, is a bitwise operation on
the ledger and never reads a text again.

Defined results: a null text counts as no words; repeated rows give repeated
ledger rows; a null doc_id stays null; other columns are ignored; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import table

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
NOT_WHITE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements; the place is the bit.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),  # a share of very few lines says nothing
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    "few_letters": lambda: 100 * F.col("n_alpha_words") < 60 * F.col("n_words"),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: Policy version -> the rules that reject. Versions are only ever added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "word_length", "few_letters"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, by version or by rule names."""
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by a 64-bit hash; only texts with a repeat are sorted.
    """

    def of_windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(g: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda i, x: F.get(s, i)["g"] == x["g"]
            twice = F.filter(s, lambda x, i: F.coalesce(same(i - 1, x), F.lit(False)) | F.coalesce(same(i + 1, x), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        in_order = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bound(in_order, places))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(hashes, lambda h: bound(of_windows(h), covered))


def measurements(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id and the numbers that the rules look at; one pass, no shuffle. row: a column for the whole input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WHITE))
    of_words = bound(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).alias("n_alpha_words"),
        ),
    )
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    whole = [F.struct(*docs.columns).alias(row)] if row else []
    cells = docs.select(
        "doc_id",
        *whole,
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(text, WHITE_SPACE, "")).alias("c"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("s"),
    )
    return cells.select(
        "doc_id",
        *([row] if row else []),
        *(F.col(x).cast("long").alias(y) for x, y in (("w.n_words", "n_words"), ("c", "word_chars"), ("s", "n_symbols"), ("l.n_dup_lines", "n_dup_lines"), ("w.n_repeat_words", "n_repeat_words"), ("l.n_lines", "n_lines"), ("w.n_alpha_words", "n_alpha_words"))),
    )


def ledger(docs: DataFrame, row: str | None = None) -> DataFrame:
    """The measurements and ``failed``: one bit for each rule that the document fails."""
    bits = sum((F.when(rule(), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measurements(docs, row).withColumn("failed", bits.cast("long"))


def keeps(policy: str | tuple[str, ...], failed: str = "failed") -> Column:
    """True where a ledger row passes the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def kept(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that pass a policy."""
    return ledger(docs, "_row").filter(keeps(policy)).select("_row.*")


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: failures, and the documents that only this rule rejects.

    One aggregation over ledger rows; partial counts merge before the shuffle.
    """
    of = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(of).cast("long"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(hit != 0).alias("n_rejected"),
        *(F.count_if(hit.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"fails_{r}") for r in POLICIES[policy]),
        *(F.count_if(hit == BIT[r]).alias(f"only_{r}") for r in POLICIES[policy]),
    )
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"), (F.col("n_rejected") - F.col(f"only_{r}")).alias("n_rejected_without")) for r in POLICIES[policy]))
    return counts.select("n_docs", "n_rejected", F.explode(each).alias("r")).select("r.rule", "n_docs", "n_rejected", "r.n_failed", "r.n_only", "r.n_rejected_without")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdicts of the base rules and of policy v1."""
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~keeps("base")).alias("base_failed"), keeps("v1").alias("kept"), "failed",
    )


OP5_SQL = """
WITH t AS (
  SELECT doc_id, COALESCE(text, '') AS text,
         list_filter(string_split_regex(COALESCE(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) AS g,
         unnest(range(1, len(w) - 1)) AS i
  FROM t
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS BIGINT) AS n_alpha_words
  FROM t LEFT JOIN r ON t.doc_id = r.doc_id
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
         + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
         + CASE WHEN 100 * n_alpha_words < 60 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed
FROM f
"""
