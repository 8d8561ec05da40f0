"""Benchmark decontamination by template canonicalisation.

Words are canonicalised to typed placeholders: numbers, units, and names
(capitalised words; several in a row are one name). The windows of canonical
words of documents and benchmark items are hash-joined, so a question whose
numbers or names were changed still matches. Matches of one document and item
are then held to slot consistency. A slot is a place of the item, so two equal
numbers of it may become two others; but on one diagonal a name stands for one
name of the document, the one that most windows with it have, and windows with
another one go. Of an item's diagonals the one with most windows left says what
its slots stand for; windows of other diagonals that say otherwise go as well.
A window is a template only if half of its words are literal, since
placeholders alone say nothing.

How a word is read depends on nothing but the word, and on the names beside it.
Since a copy may be in another case, and an item may be mostly names, the
windows of plain lower-cased words are joined as well: an item is found if
enough of its templates are, or enough of its plain windows.

The hashes of the item windows go to the tasks only if they number at most
``BROADCAST_WINDOWS``, so that documents send only windows that can join; above
that every window is sent and the join does all the work. The results are the
same.

Defined results: null or empty texts match nothing; items shorter than a window
are matched as a whole, and those under ``MIN_TEMPLATE`` words by their plain
words only; texts of any length are read whole; null ids match nothing;
repeated rows count once; of an item's two coverages the higher one comes out,
and of equal ones that of the templates; other columns are ignored; either
table may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courierlens.llm.tables import table
from courierlens.llm.words import WordHashes, member, mix, multiplier

WINDOW = 8
MIN_TEMPLATE = 5
COVERAGE = 0.5
#: Most item windows whose hashes are sent to the tasks (8 bytes each), and most that are sent whole (some 300 bytes each), so that a window of many documents is no hot key.
BROADCAST_WINDOWS, BROADCAST_ROWS = 1_000_000, 100_000

#: Words for numbers and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen twice".split())
UNITS = frozenset("% $ € £ mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs oz ounce ounces pound pounds ml l liter liters litre litres gallon gallons ms second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh meter meters metre metres centimeter centimeters kilometer kilometers".split())

_NUMBER = re.compile(r"[+\-]?\$?\d[\d.,:/]*%?$")
_EDGES = " \t.,;:!?\"'()[]{}<>«»“”‘’…"
_ASCII_EDGES = "".join(c for c in _EDGES if c.isascii()).encode()
_ASCII_KINDS = {w.encode(): 1 * (w in NUMBER_WORDS) | 2 * (w in UNITS) for w in NUMBER_WORDS | UNITS if w.isascii()}
_GLUED = re.compile(r"(?<=\d)(?=[A-Za-z€£$%])|(?<=[$€£])(?=\d)")
NUM, UNIT, NAME = 1, 2, 3
_IS_NUM, _IS_UNIT, _CAPITAL, _ENDS = (np.uint64(1 << i) for i in range(4))
_FLAGS = np.uint64(15)


class TypedWords(WordHashes):
    """word -> 60 bits of hash and 4 flags: number, unit, capitalised, followed by a mark."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        core = word.strip(_ASCII_EDGES)
        if core.isalpha():  # letters of ASCII between marks of ASCII: most words, read without decoding them
            low = core.lower()
            flags = _ASCII_KINDS.get(low, 0) | (4 if core[0] < 97 else 0) | (8 if word[-1] in _ASCII_EDGES else 0)
            self[word] = value = xxhash.xxh3_64_intdigest(low) & ~15 | flags
            return value
        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGES) or text
        low = core.casefold()
        number = (core[0] in "+-$" or core[0].isdecimal()) and bool(_NUMBER.match(core)) or low in NUMBER_WORDS
        flags = 1 * number | 2 * (low in UNITS) | 4 * core[:1].isupper() | 8 * (text[-1:] in _EDGES)
        self[word] = value = xxhash.xxh3_64_intdigest(low) & ~15 | flags
        return value


class Canonical:
    """A text as plain words, and as tokens: words or placeholders, a run of names being one."""

    def __init__(self, text: str | None, typed: TypedWords):
        text = text or ""
        if any(c in text for c in "0123456789"):
            text = _GLUED.sub(" ", text)
        self.words = text.encode("utf-8", "replace").split()
        packed = np.fromiter(map(typed.__getitem__, self.words), np.uint64, len(self.words))
        self.plain = packed & ~_FLAGS
        slot = np.where(packed & _CAPITAL, NAME, 0)
        slot[(packed & _IS_UNIT) > 0] = UNIT
        slot[(packed & _IS_NUM) > 0] = NUM
        first = np.ones(len(slot), bool)
        first[1:] = (slot[1:] != NAME) | (slot[:-1] != NAME) | ((packed[:-1] & _ENDS) > 0)
        self.start = np.flatnonzero(first)  # the word that each token begins with
        self.slot = slot[self.start]
        self.tokens = np.where(self.slot > 0, _SLOT_HASHES[self.slot], self.plain[self.start])

    def value(self, token: int) -> str:
        """What stands in a slot."""
        end = self.start[token + 1] if token + 1 < len(self.start) else len(self.words)
        return b" ".join(self.words[self.start[token] : end]).decode("utf-8", "replace").strip(_EDGES).casefold()


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, of 64 bits."""
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)))


#: An odd number, and its inverse by 2^64.
_BASE = int(multiplier(0))
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words that one run of powers covers; longer texts are hashed in pieces.
_PIECE = 1 << 14
_UP, _DOWN = _powers(_BASE, 2 * _PIECE), _powers(_INVERSE, _PIECE)
#: What stands for a placeholder, or a word, in a window: placeholders are small numbers, words have hashes already.
_SLOT_HASHES = np.concatenate(([np.uint64(0)], mix(np.arange(NUM, NAME + 1, dtype=np.uint64))))


def _window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of so many words: differences of running sums of h[i] * base^i, moved back to one place."""
    n, out = len(h) - size + 1, []
    step = _PIECE if size <= _PIECE else n
    up, down = (_UP, _DOWN) if size <= _PIECE else (_powers(_BASE, len(h)), _powers(_INVERSE, n))
    with np.errstate(over="ignore"):
        for at in range(0, n, step):
            part = h[at : min(at + step, n) + size - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            k = len(part) - size + 1
            out.append((sums[size:] - sums[:k]) * down[:k] + np.uint64(size))
    return out[0] if len(out) == 1 else np.concatenate(out)


def windows_of(c: Canonical, size: int, tokens: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's windows of this size: of plain words, or the templates among those of tokens."""
    h = c.tokens if tokens else c.plain
    n = len(h) - size + 1
    if size <= 0 or n <= 0:
        return np.array([], np.uint64), np.array([], np.int64)
    at = np.arange(n)
    if tokens:
        slots = np.concatenate(([0], np.cumsum(c.slot > 0)))
        at = np.flatnonzero(2 * (slots[size:] - slots[:-size]) <= size)
    return _window_hashes(h, size)[at], at


_FIELDS = "id long, h long, place int, tokens boolean, slots array<string>, spots array<int>, names array<boolean>, total int, size int"
_SCHEMA = pa.schema([
    ("id", pa.int64()), ("h", pa.int64()), ("place", pa.int32()), ("tokens", pa.bool_()), ("slots", pa.list_(pa.string())), ("spots", pa.list_(pa.int32())), ("names", pa.list_(pa.bool_())), ("total", pa.int32()), ("size", pa.int32()),
])


class Wanted:
    """A sorted array of hashes, with a table of their first bits that most others fail."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(10, (16 * len(hashes)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[hashes >> self.shift] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where in h the wanted hashes are."""
        at = np.flatnonzero(self.table[h >> self.shift])
        return at[member(h[at], self.hashes)]


def _rows(i: int, c: Canonical, sizes: Iterable[tuple[bool, int]], wanted: Wanted | None) -> Iterator[tuple]:
    """(id, hash, place, whether of tokens, values, places and kinds of the slots, windows of the text, words of the window) of the wanted windows."""
    for tokens, size in sizes:
        keys, at = windows_of(c, size, tokens)
        total = len(keys)
        if wanted is not None:
            hit = wanted.places(keys)
            keys, at = keys[hit], at[hit]
        for key, p in zip(keys.view(np.int64).tolist(), at.tolist(), strict=True):
            spots = (p + np.flatnonzero(c.slot[p : p + size])).tolist() if tokens else []
            yield i, key, p, tokens, [c.value(j) for j in spots], spots, [bool(c.slot[j] == NAME) for j in spots], total, size


def item_sizes(c: Canonical, window: int) -> list[tuple[bool, int]]:
    """The windows that an item is cut into: of plain words, and of tokens if it has enough of them."""
    return [(False, min(window, len(c.plain))), *([(True, min(window, len(c.tokens)))] if len(c.tokens) >= MIN_TEMPLATE else [])]


def _windows(df: DataFrame, key: str, sizes: list[tuple[bool, int]] | None, wanted: np.ndarray | None, window: int) -> DataFrame:
    """The windows of each text: of the given sizes, or of an item's own ones."""
    held = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed, rows, seen = TypedWords(), [], Wanted(held.value) if held else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    c = Canonical(text, typed)
                    rows += _rows(i, c, item_sizes(c, window) if sizes is None else sizes, seen)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_SCHEMA)], schema=_SCHEMA)
                    rows = []

    picked = df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null")
    return picked.mapInArrow(of, _FIELDS)


def _names(windows: str) -> Column:
    """(i, d) of the names i in windows of one diagonal: the name d that most of them have, of equals the last by letters."""
    seen = F.filter(F.flatten(F.col(f"{windows}.pairs")), lambda x: x["named"])

    def stands_for(i: Column, seen: Column) -> Column:
        own = F.filter(seen, lambda x: x["i"] == i)
        counted = F.transform(F.array_distinct(F.transform(own, lambda x: x["d"])), lambda d: F.struct(F.size(F.filter(own, lambda x: x["d"] == d)).alias("n"), d.alias("d")))
        return F.array_max(counted)["d"]

    each = F.array_distinct(F.transform(seen, lambda x: x["i"]))
    return F.transform(each, lambda i: F.struct(i.alias("i"), stands_for(i, seen).alias("d")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, n_slots) of items found in documents.

    coverage is the share of the item's templates that are found with
    consistent slots, or of its plain windows that the document has, whichever
    is more; n_windows and n_matched count the same ones, and n_slots the slots
    of one diagonal at most.
    """
    items = _windows(benchmark, "item_id", None, None, window)
    sizes = [(r["tokens"], r["size"]) for r in items.select("tokens", "size").distinct().collect()]  # at most twice the window's length
    hashes = items.select("h").distinct().limit(broadcast_windows + 1).toArrow()["h"].to_numpy() if broadcast_windows else None
    few = hashes is not None and len(hashes) <= broadcast_windows
    found = _windows(docs, "doc_id", sorted(sizes), np.sort(hashes.view(np.uint64)) if few else None, window)
    item = items.select(F.col("id").alias("item_id"), "h", "tokens", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "spots", "names", "total")
    met = found.select(F.col("id").alias("doc_id"), "h", "tokens", F.col("place").alias("doc_place"), "slots").join(F.broadcast(item) if few and items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else item, ["h", "tokens"])
    pairs = F.arrays_zip(F.col("spots").alias("p"), F.col("names").alias("named"), F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    # places of plain words need no diagonal of their own; of tokens, a diagonal has each place of the item once
    diagonal = F.when(F.col("tokens"), F.col("doc_place") - F.col("item_place"))
    lines = met.groupBy("doc_id", "item_id", "tokens", diagonal.alias("diagonal")).agg(F.collect_set(F.struct(F.col("item_place").alias("place"), pairs.alias("pairs"))).alias("w"), F.max("total").alias("total"))
    named = lines.withColumn("e", _names("w")).withColumn("w", F.filter("w", lambda w: F.forall(w["pairs"], lambda x: ~x["named"] | F.exists("e", lambda e: (e["i"] == x["i"]) & (e["d"] == x["d"])))))
    slots = named.withColumn("s", F.array_distinct(F.transform(F.flatten("w.pairs"), lambda x: F.struct(x["p"], x["d"]))))
    best = Window.partitionBy("doc_id", "item_id", "tokens").orderBy(F.desc(F.size("w")), "diagonal")
    held = slots.withColumn("a", F.first("s").over(best))
    same = F.filter("w", lambda w: F.forall(w["pairs"], lambda x: ~F.exists("a", lambda a: (a["p"] == x["p"]) & (a["d"] != x["d"]))))
    joined = held.groupBy("doc_id", "item_id", "tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.transform(same, lambda w: w["place"]))))).cast("long").alias("n_matched"),  # at most the item's places
        F.max("total").cast("long").alias("n_windows"),
        F.max(F.size("s")).cast("long").alias("n_slots"),
    )
    share = F.col("n_matched") / F.col("n_windows")
    best = joined.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("coverage"), "tokens", "n_windows", "n_matched", "n_slots")).alias("b"))
    return best.filter(F.col("b.coverage") >= coverage).select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.coverage", "b.n_slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names and units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "n_slots")
