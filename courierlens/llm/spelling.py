"""Grouping of spelling variants: words that differ by one edit.

*Vocabulary.* Words are counted inside the tasks before they are shuffled.

*Keys.* Of two words that differ by one inserted, deleted or replaced character
either the first half is equal or the rest is, the halves being those of the
shorter word. So a word enters, as it is and reversed, the lists of its own
length and, as the longer word, those of one less; such a list is named by the
half that is equal. A list of over ``LIST_WORDS`` words is cut into parts, and
the words that search it visit every part, so no task holds more than one part.

*Scan.* A task takes a list in sorted order. Rows of the edit matrix, three
cells wide, stand for each depth of the current word, for all searching words
at once; the next word keeps the rows of the prefix it shares with the word
before. Searching words with no cell of one or less leave the row below, and
where none is left, all words that share that prefix are skipped.

*Forms.* A word's form is its near word of largest count, if that is ``ratio``
times its own or more. Counts grow along forms, so chains end after as many
steps as counts have digits; roots come by doubling.

Defined results: null and wordless texts have no words; a null doc_id is
written as nothing; repeated rows count as often as they come; of equally
frequent near words the first in code-point order is the form; texts of any
length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import remove, spread_join, table, written

LEAST_LENGTH, LEAST_COUNT, RATIO, SLIPS = 7, 2, 10, 31
#: Most words in one part of a list.
LIST_WORDS = 20_000
#: Distinct words that one task counts before it hands them on.
COUNTED = 300_000
#: Searching words that one scan works on.
SEARCHING = 4096
#: Words of a row up to which they are taken one by one.
FEW = 24
#: A distance that is out of reach.
FAR = 2


def _slipped(i: int | None, found: dict[str, int], least: int, slips: int | None) -> Iterator[tuple[str, int]]:
    """The words of one text with their counts, those changed that a checksum picks."""
    start = zlib.crc32(f"{'' if i is None else i}:".encode())
    for word, n in found.items():
        if slips:
            h = zlib.crc32(word.encode(), start)
            if h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            yield word, n


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """(word, n) of the words of whole texts: runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased.

    ``slips`` takes one character from the words of a text whose checksum it
    divides, as if they were misspelt.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(run.findall((text.as_py() or "").encode("utf-8", "replace").lower().decode()))
                for word, n in _slipped(i, found, least_length, slips):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield handed()
                    counts = {}
        yield handed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    """Code points, one row for each word, filled up with 0."""
    width = max(map(len, words))
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)


def scan(listed: list[str], searching: list[str], begin: int) -> Iterator[tuple[int, int]]:
    """(place in searching, place in listed) of words exactly one edit apart.

    All words share their first ``begin`` characters; ``listed`` is sorted, and
    no listed word is more than one character longer or shorter than a
    searching one.
    """
    codes, lengths = _codes(searching), np.array(list(map(len, searching)))
    longest = max(map(len, listed))
    codes = np.pad(codes, ((0, 0), (1, 2 + max(0, longest - codes.shape[1]))))  # column j + 1 is character j
    spelt = [f"\0{w}".ljust(longest + 3, "\0") for w in searching]
    full = np.full(len(searching), FAR, np.int8)
    # row d: the words still in reach, and their distances to the prefix of d characters at d - 1, d and d + 1 of their own
    rows = {begin: _few(np.arange(len(searching)), full - 1, full - 2, full - 1)}
    dead, before = None, ""
    for place, word in enumerate(listed):
        shared = begin
        most = min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        before = word
        if dead is not None:
            if shared >= dead:
                continue
            dead = None
        for d in range(shared, len(word)):
            row = rows[d]
            row = _step_few(row, spelt, word[d], d) if isinstance(row, list) else _step(*row, codes, word[d], d)
            if not len(row):
                dead = d + 1
                break
            rows[d + 1] = row
        else:
            row = rows[len(word)]
            for i, *distances in row if isinstance(row, list) else zip(*(x.tolist() for x in row), strict=True):
                if distances[1 + int(lengths[i]) - len(word)] == 1:
                    yield i, place


def _few(who: np.ndarray, left: np.ndarray, mid: np.ndarray, right: np.ndarray) -> tuple | list:
    """A row as arrays, or as a list of its words where they are so few that arrays cost more."""
    return list(zip(who.tolist(), left.tolist(), mid.tolist(), right.tolist(), strict=True)) if len(who) <= FEW else (who, left, mid, right)


def _step(who: np.ndarray, left: np.ndarray, mid: np.ndarray, right: np.ndarray, codes: np.ndarray, letter: str, d: int) -> tuple | list:
    """The row below a row, for many words at once; those out of reach are left out."""
    c = ord(letter)
    new_left = np.minimum(mid + 1, left + (codes[who, d] != c))
    new_mid = np.minimum(np.minimum(right + 1, new_left + 1), mid + (codes[who, d + 1] != c))
    new_right = np.minimum(new_mid + 1, right + (codes[who, d + 2] != c))
    near = np.minimum(np.minimum(new_left, new_mid), new_right) < FAR
    return _few(who[near], new_left[near], new_mid[near], new_right[near])


def _step_few(row: list, spelt: list[str], letter: str, d: int) -> list:
    """The same for a few words, one after the other."""
    out = []
    for i, left, mid, right in row:
        word = spelt[i]
        a, b = mid + 1, left + (word[d] != letter)
        left = a if a < b else b
        a, b = (right if right < left else left) + 1, mid + (word[d + 1] != letter)
        mid = a if a < b else b
        a, b = mid + 1, right + (word[d + 2] != letter)
        right = a if a < b else b
        if left < FAR or mid < FAR or right < FAR:
            out.append((i, left, mid, right))
    return out


def _lists(words: DataFrame) -> DataFrame:
    """(key, word, n): the lists that a word enters; a key has the shorter length, the direction, and the half that is equal."""
    size = F.length("word")
    entries = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        rest = shorter - half
        front = F.concat(shorter, F.lit(">"), F.substr("word", F.lit(1), half))
        back = F.concat(shorter, F.lit("<"), F.reverse(F.substr("word", size - rest + 1, rest)))
        entries += [front, back]
    return words.select("word", "n", F.explode(F.array(*entries)).alias("key"))


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, near, n) of the ordered pairs of (word, n) that are exactly one edit apart; n is the count of near."""
    entries = _lists(words)
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    lists = lists.withColumn("parts", F.ceil(F.col("rows") / list_words).cast("int"))
    met = spread_join(entries, lists, ["key"], "rows", "word")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    listed = met.select("key", part.alias("part"), F.lit(False).alias("searches"), "word", "n")
    # searching words are those of the shorter length; the others are found by them
    length = F.regexp_extract("key", "^[0-9]+", 0).cast("int")
    searching = met.filter(F.length("word") == length).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("searches"), "word", "n")
    rows = listed.unionByName(searching).repartition("key", "part").sortWithinPartitions("key", "part", "searches", "word")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, wanted, out = None, [], [], []

        def search() -> None:
            if not held or not wanted:
                return
            reverse = "<" in key[0]
            shorter_length = int(re.match("[0-9]+", key[0])[0])
            half = shorter_length // 2
            begin = shorter_length - half if reverse else half
            turn = (lambda w: w[::-1]) if reverse else (lambda w: w)
            order = sorted((turn(w), w, n) for w, n in held)
            words_, search_words = [x[0] for x in order], [turn(w) for w, _ in wanted]
            for i, j in scan(words_, search_words, begin):
                (word, n), (_, near, m) = wanted[i], order[j]
                if reverse and word[:half] == near[:half]:
                    continue  # the list of their common first half has them
                out.append((word, near, m))
                if len(near) != len(word):
                    out.append((near, word, n))

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "near", "n"])

        for batch in batches:
            for k, p, s, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "searches", "word", "n")), strict=True):
                if (k, p) != key:
                    search()
                    key, held, wanted = (k, p), [], []
                (wanted if s else held).append((word, n))
                if len(wanted) >= SEARCHING:
                    search()
                    wanted = []
            yield handed()
            out.clear()
        search()
        yield handed()

    return rows.mapInArrow(of, "word string, near string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form), by doubling; each round is written to the shared folder."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        more = following.filter("moved").limit(1).count()
        remove(now)
        now = following.select("word", "root")
        if not more:
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    The result reads tables in the shared folder, which ``tables.remove`` deletes.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near")))
    found = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    rows = words.join(found, "word", "left").withColumn("f", formed)
    rows = written(rows.select("word", "f.form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "f.form_n"), "forms")
    remove(words)
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants among the words of documents, one slip in thirty-one texts."""
    return variants(vocabulary(table(spark, sf_dir, "documents"), slips=SLIPS))
