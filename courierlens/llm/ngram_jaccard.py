"""N-gram Jaccard join over count vectors.

A document is the set of its k-word shingles. Shingles are hashed into groups,
and a document is the point of its group counts: the sum of coordinate minima
of two points is at least the size of their common set, so points that are too
far apart need no comparison.

*Classes.* Documents of one set are one class, known by a digest; only its
smallest document takes part in the search.

*Directory.* In so many dimensions the boxes of all top nodes touch, so a tree
alone cannot say on which machine two documents meet. Sets that are similar
enough differ in at most D shingles, and D follows from their sizes. The
coordinates are dealt into more than D blocks, so two such points agree on some
block. A document therefore enters the leaf (block, counts in that block) of its
first D + 1 blocks that hold anything, and similar documents meet in a leaf. A
document with too many empty blocks is dealt again with another seed. Leaves of
one document go before they travel, by a bitmap of the others.

*Trees.* The leaves that have their smallest document in common are one group:
its members are the points of an R-tree whose nodes hold coordinate maxima. A
pair of nodes is entered only if its bound reaches the needed overlap, and not
if all below it is linked already. The tree alone produces the pairs; each is
verified on the whole sets as it comes, so of a group of copies only the links
of a spanning tree come out.

First every document is searched in one group, that of its smallest companion.
Then the groups whose members are still in several components are searched
whole. A group of over GROUP_ROWS members or GROUP_SHINGLES shingles is cut
into parts: at first each part is searched with the group's smallest document;
then the members outside that document's component are taken to every part. No
task holds more than two parts.

Defined results: null and wordless texts have no shingles and no links; rows
with a null doc_id are in no pair and come out as their own row without a
component; repeated rows of one doc_id are one document that links as any of
them does, and each comes out; texts of any length are read whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.components import connected_components
from courierlens.llm.tables import bitmap, passes, remove, spread_join, table, written
from courierlens.llm.words import WordHashes, distinct, member, mix, windows

#: Coordinates of the points that bounds are computed on: for most groups, and for those with a set of LARGE shingles or more.
COORDINATES, FINER, LARGE = 128, 1024, 4000
#: Fine groups in a block of the directory.
FINE = 1 << 16
#: Most members and shingles of one part of a group.
GROUP_ROWS, GROUP_SHINGLES = 1500, 2_000_000
#: Entries of an R-tree node.
FANOUT = 16
#: How often a document with too many empty blocks is dealt again before its empty blocks enter the directory too.
SEEDS = 24
#: Most ids that are broadcast to pick rows (16 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: What finds the links among some sets: of ids, sets, and parts, which it changes to the joined ones.
Link = Callable[[list[int], list[np.ndarray], np.ndarray], Iterator[tuple[int, int]]]


@lru_cache(100_000)
def level(size: int, num: int, den: int) -> int:
    """The number of blocks for pairs whose larger set has this size: so many that most of them hold two shingles, and more than may differ."""
    differ = 2 * size * (den - num) // (den + num)
    return 1 << (9 * (differ + 1) // 5).bit_length()


def leaves(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The directory entries of a set.

    It enters the blocks of its own level, and of the level of the largest sets
    that it can link to: the first blocks, until one more than may differ have
    something in them. Of two sets that link, the one that stops earlier has
    such a block that the other shares.
    """
    n, out = len(h), []
    if not n:
        return h
    largest = n * den // num
    differ = (den - num) * (n + largest) // (den + num)
    for m in {level(n, num, den), level(largest, num, den)}:
        for seed in range(SEEDS + 1):
            salt = np.uint64((m * 1000003 + seed) * 0x9E3779B97F4A7C15 % 2**64)
            with np.errstate(over="ignore"):
                g = mix(h ^ salt)
                block = (g & np.uint64(m - 1)).astype(np.int64)
                fine = mix((g >> np.uint64(40)) % np.uint64(FINE) + salt)
                sums, counts = np.zeros(m, np.uint64), np.bincount(block, minlength=m)
                np.add.at(sums, block, fine)
                keys = mix(sums + mix(np.arange(m, dtype=np.uint64) ^ (salt * np.uint64(3))))
            full = np.flatnonzero(counts >= (2 if seed < SEEDS // 2 else 1))  # blocks of one shingle say little
            if len(full) > differ:
                out.append(keys[full[: differ + 1]])
                break
            out.append(keys if seed == SEEDS else keys[full])
    return distinct(np.concatenate(out))


def point(h: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The counts of a set's shingles in so many groups."""
    return np.bincount((mix(h) & np.uint64(size - 1)).astype(np.int64), minlength=size)


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Of small runs of rows: the ids, and the sorted distinct shingle hashes."""
    words = WordHashes()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for at in range(0, len(ids), 128):
            part = texts[at : at + 128].to_pylist()
            yield ids[at : at + 128].to_pylist(), [distinct(windows(words.of(t), k)) for t in part]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.array([], np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), pa.int64()))


def _rows_of(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column of longs, as unsigned arrays."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame, k: int, entries_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, n, a digest of the set, and its directory entries, of every row."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            entries = _lists([entries_of(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), digests, entries], ["doc_id", "n", "digest", "leaves"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, digest binary, leaves array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, and the sorted hashes of the set."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets)], ["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, hashes array<long>")


class Tree:
    """A packed R-tree over points: each node has the coordinate maxima and the range of sizes of what is below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.lexsort((*points.T[:3], sizes))  # sort-tile packing along size, then the first coordinates
        nodes = [self._node(order[i : i + FANOUT], []) for i in range(0, len(order), FANOUT)]
        while len(nodes) > 1:
            groups = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
            nodes = [self._node(np.concatenate([x["rows"] for x in g]), g) for g in groups]
        self.root = nodes[0]

    def _node(self, rows: np.ndarray, children: list) -> dict:
        sizes = self.sizes[rows]
        return {"rows": rows, "children": children, "top": self.points[rows].max(0), "least": int(sizes.min()), "most": int(sizes.max())}

    def _meets(self, x: dict, y: dict, num: int, den: int) -> bool:
        if den * min(x["most"], y["most"]) < num * max(x["least"], y["least"]):
            return False
        return (num + den) * int(np.minimum(x["top"], y["top"]).sum()) >= num * (x["least"] + y["least"])

    def pairs(self, num: int, den: int, parts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Rows of different parts whose bound reaches the needed overlap; the caller may merge parts as pairs come."""
        todo = [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            of_x, of_y = parts[x["rows"]], parts[y["rows"]]
            if (of_x == of_y[0]).all() and (of_y == of_y[0]).all() or not self._meets(x, y, num, den):
                continue
            if x["children"] or y["children"]:
                if x is y:
                    todo += [(a, b) for i, a in enumerate(x["children"]) for b in x["children"][i:]]
                elif len(x["rows"]) >= len(y["rows"]) and x["children"]:
                    todo += [(a, y) for a in x["children"]]
                else:
                    todo += [(x, b) for b in y["children"]]
                continue
            bound = np.minimum(self.points[x["rows"]][:, None, :], self.points[y["rows"]][None, :, :]).sum(2)
            n, m = self.sizes[x["rows"]][:, None], self.sizes[y["rows"]][None, :]
            fits = ((num + den) * bound >= num * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            for i, j in np.argwhere(fits & (of_x[:, None] != of_y[None, :])):
                a, b = int(x["rows"][i]), int(y["rows"][j])
                if parts[a] != parts[b] and (x is not y or i < j):
                    yield a, b


def linked(ids: list[int], sets: list[np.ndarray], parts: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links among these sets that join their parts as far as any links do; parts is changed to the joined ones."""
    sizes = np.array(list(map(len, sets)), np.int64)
    width = FINER if sizes.max() >= LARGE else COORDINATES
    tree = Tree(np.array([point(s, width) for s in sets]), sizes)
    for a, b in tree.pairs(num, den, parts):
        common = int(member(sets[a], sets[b]).sum())
        if (num + den) * common >= num * int(sizes[a] + sizes[b]):
            parts[parts == parts[b]] = parts[a]
            yield ids[a], ids[b]


def _searched(cells: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    """Links (a, b) found in each cell (first, p, q) of rows (doc_id, component)."""
    rows = cells.join(sets, "doc_id")
    rows = rows.repartition("first", "p", "q").sortWithinPartitions("first", "p", "q", "doc_id")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, components, a, b = None, [], [], [], [], []

        def search() -> None:
            if len(set(components)) > 1:
                parts = np.unique(components, return_inverse=True)[1]
                for x, y in link(ids, held, parts):
                    a.append(x)
                    b.append(y)

        for batch in batches:
            names = (batch.column(c).to_pylist() for c in ("first", "p", "q", "doc_id", "component"))
            for first, p, q, i, c, h in zip(*names, _rows_of(batch.column("hashes")), strict=True):
                if (first, p, q) != key:
                    search()
                    key, ids, held, components = (first, p, q), [], [], []
                ids.append(i)
                held.append(h)
                components.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        search()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("first", "p", "q", "doc_id", "component", "hashes").mapInArrow(of, "a long, b long")


def _parts(rows: Column | str, shingles: Column | str) -> Column:
    """The number of parts that so many members with so many shingles are cut into."""
    by_rows, by_shingles = F.col(rows) / GROUP_ROWS, F.col(shingles) / GROUP_SHINGLES
    return F.greatest(F.lit(1), F.ceil(by_rows), F.ceil(by_shingles)).cast("int")


def _numbers(parts: str) -> Column:
    return F.sequence(F.lit(0), F.col(parts) - 1)


def _at_home(members: DataFrame) -> DataFrame:
    """Cells of the first search: every member with the smallest of its companions, which is in every part of its group."""
    home = members.groupBy("doc_id").agg(F.min("first").alias("first"), F.max("n").alias("n")).filter("doc_id <> first")
    groups = home.groupBy("first").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    groups = groups.withColumn("parts", _parts("rows", "shingles"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    others = spread_join(home.select("first", "doc_id"), groups.select("first", "rows", "parts"), ["first"], "rows", "doc_id")
    firsts = groups.select("first", F.col("first").alias("doc_id"), F.explode(_numbers("parts")).alias("p"))
    cells = others.select("first", "doc_id", own.alias("p")).unionByName(firsts)
    return cells.select("first", "p", F.lit(0).alias("q"), "doc_id", F.col("doc_id").alias("component"))


def _open_groups(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members of groups of several components: (first, doc_id, n, component, outside, parts)."""
    known = members.join(components.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    main = F.min(F.when(F.col("doc_id") == F.col("first"), F.col("component")))
    groups = known.groupBy("first").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), main.alias("main"),
        F.min("component").alias("least"), F.max("component").alias("most"),
    ).filter("least <> most")
    groups = groups.select("first", "rows", "main", _parts("rows", "shingles").alias("parts"))
    met = spread_join(known, groups, ["first"], "rows", "doc_id")
    return met.select("first", "doc_id", "n", "component", (F.col("component") != F.col("main")).alias("outside"), "parts")


def _still_open(rows: DataFrame) -> DataFrame:
    """Cells of the second search, in the groups of several components.

    Part p of all members meets part q of those outside the component of the
    group's first document: copies are linked by then, so these are few unless
    a leaf holds many documents that are not alike.
    """
    outside = rows.filter("parts > 1 and outside").groupBy("first").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("s"))
    members = rows.filter("parts > 1").groupBy("first").agg(F.count(F.lit(1)).alias("rows"))
    split = members.join(outside.select("first", _parts("r", "s").alias("outer")), "first")
    cut = spread_join(rows.filter("parts > 1"), split, ["first"], "rows", "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("outer")).cast("int")
    whole = rows.filter("parts = 1").select("first", F.lit(0).alias("p"), F.lit(0).alias("q"), "doc_id", "component")
    inner = cut.select("first", own.alias("p"), F.explode(_numbers("outer")).alias("q"), "doc_id", "component")
    visitors = cut.filter("outside").select("first", F.explode(_numbers("parts")).alias("p"), chunk.alias("q"), "doc_id", "component")
    return whole.unionByName(inner).unionByName(visitors)


def _entries(signed: DataFrame, bits: np.ndarray) -> DataFrame:
    """(leaf, doc_id, n) of the directory entries that the bitmap has."""
    held = signed.sparkSession.sparkContext.broadcast(bits)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("leaves")
            leaf = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            sizes = np.diff(lists.offsets.to_numpy())
            hit = np.flatnonzero(passes(held.value, leaf))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[hit]), *(pa.array(batch.column(c).to_numpy()[row]) for c in ("doc_id", "n"))], ["leaf", "doc_id", "n"])

    return signed.select("doc_id", "n", "leaves").mapInArrow(of, "leaf long, doc_id long, n long")


def _only(docs: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """The rows of docs with (left_semi) or without (left_anti) these ids, which are broadcast only up to BROADCAST_IDS of them."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, on, how)


def components_by_leaves(docs: DataFrame, k: int, entries_of: Callable[[np.ndarray], np.ndarray], link: Link) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, from links among documents that share a directory entry.

    ``entries_of`` gives the entries of a set of k-word shingles, ``link`` finds
    links among some sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, k, entries_of), "signatures")
    whole = signed.filter("doc_id is not null and n > 0")

    classes = written(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "classes")
    again = spread_join(whole.select("digest", "doc_id"), classes, ["digest"], "rows", "doc_id")
    copies = written(again.filter("doc_id <> rep").select("doc_id", "digest", "rep").distinct(), "copies")
    remove(classes)
    own = _only(whole, copies.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")

    entries = own.select("doc_id", F.explode("leaves").alias("leaf"))
    seen = entries.groupBy("leaf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    shared = written(seen.filter("first <> last").select("leaf", "first", "rows"), "shared")
    met = spread_join(_entries(own, bitmap(shared, "leaf")), shared, ["leaf"], "rows", "doc_id")
    members = written(met.groupBy("first", "doc_id").agg(F.max("n").alias("n")), "members")
    slim = written(signed.drop("leaves"), "sets-of")
    remove(shared, signed)

    ids = written(members.select("doc_id").distinct(), "ids")
    sets = written(shingle_sets(_only(docs, ids, ["doc_id"], "left_semi"), k).filter("size(hashes) > 0"), "sets")
    near = written(_searched(_at_home(members), sets, link), "near")
    parts = connected_components(near)
    still = written(_open_groups(members, parts), "open")
    further = written(_searched(_still_open(still), sets, link), "further")
    # rows of one doc_id with different sets make their classes one
    twice = copies.join(slim.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y"), "doc_id", "left_semi")
    links = near.unionByName(further).unionByName(twice.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(links)
    rep = slim.join(copies, ["doc_id", "digest"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    out = rep.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "jaccard")
    remove(slim, copies, members, ids, sets, near, parts, still, further, components)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents link when ``den * |A and B| >= num * |A or B|`` over their
    k-word shingles; component_id is the smallest doc_id that links reach. The
    result is a table in the shared folder, which ``tables.remove`` deletes.
    """
    return components_by_leaves(docs, k, partial(leaves, num=num, den=den), partial(linked, num=num, den=den))


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those that a link leads to from a smaller doc_id; rows with a null doc_id stay."""
    others = jaccard_components(docs, k, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    return _only(docs, others, ["doc_id"], "left_anti").select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents over four-word shingles at a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)
