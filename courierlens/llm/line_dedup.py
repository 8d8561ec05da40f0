"""Line dedup as an exact set-similarity join (DataFrame functions only).

A line is its set of lower-cased words. A line goes if an earlier line, by
(doc_id, line number), has a Jaccard similarity of at least ``num / den`` with
it. Lines with equal sets are first merged into one class, by partial
aggregation; classes are then joined by prefix: words are ordered by rarity,
and two similar classes share a word among the first few of each. Rarity is
the number of occurrences per word bucket, held in a table of fixed size
whatever the vocabulary; any common order gives the same result.

Length, position and bitmap filters cut the pairs, first against the earliest class of
each prefix word (linear in the word's classes, and enough for most copies),
then, for classes not yet gone, against every earlier class that shares the
word. The pairs that are left are verified on the whole sets.

Defined results: a null text has no lines; a line without a word is never
removed and matches nothing; of lines that are alike in one document the first
stays, and of those in several the one of the smallest doc_id; rows with a null
doc_id are kept as they are; rows of one doc_id are one document; texts and
lines of any length are read whole; other columns, whatever their names, pass
through ``deduplicated``; of a document that loses all its words nothing is
left, and its row goes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.quality_rules import NOT_WHITE, bound
from courierlens.llm.tables import remove, spread_join, table, written

NUM, DEN = 90, 100
#: Buckets of the rarity table.
BUCKETS = 1 << 18
#: About as many later places of a frequent word are compared with its earlier ones in one task.
CROWD = 2000
#: Most places of lines (12 bytes each) that are broadcast to fetch their words; more of them are joined by a shuffle.
BROADCAST_PLACES = 1_000_000


def tokens(line: Column) -> Column:
    """The lower-cased words of a line, with empty ones between blanks.

    Other white space is rare, and only then turned into blanks: splitting at a
    plain character is much faster.
    """
    plain = F.when(line.rlike("[\\t\\x0B-\\r]"), F.regexp_replace(line, "[\\t\\x0B-\\r]", " ")).otherwise(line)
    return F.split(F.lower(plain), " ")


def distinct_keys(line: Column, key: Callable[[Column], Column]) -> Column:
    """The distinct words of a line, each as key(hash)."""
    keys = F.transform(tokens(line), lambda w: key(F.xxhash64(w)))
    return F.array_distinct(F.array_remove(keys, key(F.xxhash64(F.lit("")))))


def words_of(line: Column) -> Column:
    """The distinct words of a line, as hashes."""
    return distinct_keys(line, lambda w: w)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, content) of every line that has a word."""
    each = docs.filter("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return each.filter(F.col("content").rlike(NOT_WHITE))


def rarity(docs: DataFrame) -> Callable[[Column], Column]:
    """A function of a word's hash: its rarity tier, then the hash, as one sortable number.

    The tiers are thirds of powers of two of the occurrences in each of BUCKETS
    buckets. Words are counted as they are written, since only the order needs
    them.
    """

    def bucket_of(w: Column) -> Column:
        return w.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")

    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(bucket_of(F.xxhash64("w")).alias("bucket")).count()
    tier = F.least(F.lit(126), (3 * F.log2("count")).cast("int"))
    none = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("tier"))
    whole = counts.select("bucket", tier.alias("tier")).unionByName(none).groupBy("bucket").agg(F.max("tier").alias("tier"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "tier"))), lambda x: x["tier"].cast("string"))
    held = F.split(F.lit(whole.agg(F.array_join(in_order, ",").alias("tiers")).first()["tiers"]), ",").cast("array<long>")  # BUCKETS numbers, folded into one constant array
    none_left = F.lit(0).cast("long")  # never needed, but arrays of keys that cannot be null are sorted much faster
    return lambda w: F.shiftleft(F.coalesce(F.get(held, bucket_of(w)), none_left), 56).bitwiseOR(F.shiftrightunsigned(w, 8))


def _similar(common: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Whether sets of n and m words with so many common ones have a Jaccard similarity of num / den."""
    return common * (num + den) >= (n + m) * num


def classes_of(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, line, n, bits, prefix): the first place of each distinct set of words, its size, parity bits, and rarest words.

    Every word turns one of the 64 bits, so two sets differ in at least as many
    words as their bits differ.
    """
    key = rarity(docs)
    n = F.size("keys")
    prefix = F.floor(n * (den - num) / F.lit(den)).cast("int") + 1
    bits = F.aggregate("keys", F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    keyed = lines_of(docs).select("doc_id", "line", F.sort_array(distinct_keys(F.col("content"), key)).alias("keys"))
    # a place is one number, since the least of structures could only be found by sorting all lines
    lines = F.lit(1 << 31).cast("decimal(10,0)")
    place = F.col("doc_id").cast("decimal(20,0)") * lines + F.col("line").cast("decimal(10,0)")
    told = keyed.select(F.xxhash64("keys").alias("h1"), F.hash("keys").alias("h2"), n.alias("n"), bits.alias("bits"), F.slice("keys", F.lit(1), prefix).alias("prefix"), place.alias("place"))
    found = told.groupBy("h1", "h2", "n", "bits", "prefix").agg(F.min("place").alias("place")).withColumn("line", F.pmod("place", lines))
    return found.select(F.call_function("div", F.col("place") - F.col("line"), lines).alias("doc_id"), F.col("line").cast("int").alias("line"), "n", "bits", "prefix")


def similar_classes(docs: DataFrame, classes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The places (doc_id, line) of classes that an earlier class resembles."""
    can_differ = F.floor(F.col("n") * den / F.lit(num)) > F.col("n")  # smaller sets are similar to equal ones only
    entries = classes.filter(can_differ).select(F.posexplode("prefix").alias("at", "w"), "doc_id", "line", "n", "bits").select("w", "doc_id", "line", "n", "at", "bits")

    def met(pairs: DataFrame) -> DataFrame:
        """The pairs of places (x earlier than y) of entries of one word that pass the length, position and bit filters."""
        n1, n2, a1, a2 = (F.col(c) for c in ("n_x", "n_y", "at_x", "at_y"))
        before = (F.col("doc_id_x") < F.col("doc_id_y")) | ((F.col("doc_id_x") == F.col("doc_id_y")) & (F.col("line_x") < F.col("line_y")))
        length = F.least(n1, n2) * den >= F.greatest(n1, n2) * num
        position = _similar(F.least(n1 - a1, n2 - a2) + F.least(a1, a2), n1, n2, num, den)
        differ = F.bit_count(F.col("bits_x").bitwiseXOR(F.col("bits_y"))) * (num + den) <= (n1 + n2) * (den - num)
        return pairs.filter(before & length & position & differ).select("doc_id_x", "line_x", "doc_id_y", "line_y")

    def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
        return rows.select("w", *more, *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "line", "n", "at", "bits")))

    def later(pairs: DataFrame) -> DataFrame:
        """The later places of those pairs whose whole sets are similar."""
        pairs = written(pairs.distinct(), "pairs")
        places = pairs.select(F.col("doc_id_x").alias("doc_id"), F.col("line_x").alias("line")).unionByName(pairs.select(F.col("doc_id_y").alias("doc_id"), F.col("line_y").alias("line"))).distinct()
        places = written(places, "places")
        few = places.count() <= BROADCAST_PLACES
        picked = lines_of(docs).join(F.broadcast(places) if few else places, ["doc_id", "line"], "left_semi")
        sets = written(picked.select("doc_id", "line", words_of(F.col("content")).alias("words")), "sets")
        joined = pairs
        for s in "xy":
            joined = joined.join(sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "line", "words"))), [f"doc_id_{s}", f"line_{s}"])
        common = F.size(F.array_intersect("words_x", "words_y"))
        out = written(joined.filter(_similar(common, F.size("words_x"), F.size("words_y"), num, den)).select(F.col("doc_id_y").alias("doc_id"), F.col("line_y").alias("line")).distinct(), "later")
        remove(pairs, places, sets)
        return out

    first = entries.groupBy("w").agg(F.min(F.struct("doc_id", "line", "n", "at", "bits")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("w", "f.*", "k")
    first = written(first, "first")
    with_first = written(spread_join(side(entries, "y"), side(first, "x", "k"), ["w"], "k", "doc_id_y"), "with-first")
    gone = later(met(with_first))
    # of a word with two classes nothing is left to compare
    parts = F.ceil(F.col("k") / CROWD).cast("int")
    crowded = with_first.filter("k > 2").select("w", *(F.col(f"{c}_y").alias(c) for c in ("doc_id", "line", "n", "at", "bits")), parts.alias("parts"))
    left = crowded.join(gone, ["doc_id", "line"], "left_anti")
    pairs = met(side(crowded.filter("parts = 1"), "x").join(side(left.filter("parts = 1"), "y"), "w"))
    # the later places of a frequent word are dealt into parts, and its earlier ones go to each, so no task has all of them
    earlier = crowded.filter("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = left.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("doc_id", "line"), F.col("parts")).cast("int"))
    rest = later(pairs.unionByName(met(side(earlier, "x", "part").join(side(dealt, "y", "part"), ["w", "part"]))))
    remove(first, with_first)
    return gone.unionByName(rest)  # two tables, and no place is in both


def kept_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, kept): the numbers of the lines that stay, of every document that has any; a table in the shared folder."""
    classes = written(classes_of(docs, num, den), "classes")
    gone = similar_classes(docs, classes, num, den)
    left = classes.select("doc_id", "line").join(gone, ["doc_id", "line"], "left_anti")
    kept = written(left.groupBy("doc_id").agg(F.collect_list("line").alias("kept")), "kept")  # never more than the document's lines
    remove(classes, gone)
    return kept


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_lines, removed) of every row: how many lines with a word it has, and which of them go, in order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept_lines(docs, num, den)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_WHITE), i))).alias("lines"))
    removed = F.when(F.col("doc_id").isNull(), F.array().cast("array<int>")).otherwise(F.array_except("lines", F.coalesce("kept", F.array().cast("array<int>"))))
    return rows.join(kept, "doc_id", "left").select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("removed"))


def deduplicated(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs without the lines that go, and without documents of which no word is left."""
    gone = removed_lines(docs, num, den).filter("size(removed) > 0").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.col("row.text").cast("string")
    left = F.when(F.col("removed").isNull(), text).otherwise(bound(F.split(text, "\n"), without))
    joined = rows.join(gone.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "removed", left.alias("left"))
    stays = F.col("removed").isNull() | F.col("left").rlike(NOT_WHITE)
    return joined.filter(stays).select(*(F.col("left" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines with words, how many go, and which (line numbers from 0)."""
    return removed_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
