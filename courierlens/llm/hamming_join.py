"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its k-word shingles, and its signature the lowest
``BITS`` bits of each of ``SYMBOLS`` minima of hashes. The signatures of two
sets differ in as many symbols as one less their similarity says, so sets that
link are within the distance ``threshold()`` but for about one pair in a
million at the similarity of 0.8, and fewer above.

*Index.* The signature is cut into chunks of ``CHUNK`` symbols. Of a pair
within the threshold some chunk has at most ``ERRORS`` differing symbols, by
pigeonhole; so for each chunk the choices of that many symbols are enumerated
and left out, and what remains is a key. Every pair within the threshold has a
key in common, whatever the data.

*Join.* Equal sets are one class. Documents that share a key meet in the group
of the key's smallest document, as in the n-gram join, which also says how
large groups are cut into parts. In a group, signatures within the threshold
are candidates, and a link is confirmed on the full sets; of a group of copies
only the links of a spanning tree come out.

Defined results: null and wordless texts have no shingles and no links and are
kept; rows with a null doc_id are in no pair, have no component and are kept;
repeated rows of one doc_id are one document that links as any of them does,
and each comes out; texts of any length are read whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.ngram_jaccard import components_by_leaves
from courierlens.llm.tables import table
from courierlens.llm.words import distinct, member, mix

SYMBOLS, BITS, CHUNK, ERRORS = 120, 16, 5, 1
#: Shingles that one step of the minima works on.
STEP = 2048

_SALTS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64))
_FACTORS = mix(_SALTS) | np.uint64(1)


def threshold() -> int:
    """The most differing symbols that the index guarantees."""
    return SYMBOLS // CHUNK * (ERRORS + 1) - 1


def signature(h: np.ndarray) -> np.ndarray:
    """The symbols of a set of shingle hashes that is not empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), STEP):
            g = (h[None, at : at + STEP] ^ _SALTS[:, None]) * _FACTORS[:, None]
            least = np.minimum(least, (g ^ (g >> np.uint64(29))).min(1))
        return mix(least).astype(np.uint16) & np.uint16((1 << BITS) - 1)


def keys(symbols: np.ndarray) -> np.ndarray:
    """What remains of each chunk without each choice of symbols, as hashes."""
    at = np.arange(SYMBOLS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        each = mix(symbols.astype(np.uint64) | (at << np.uint64(BITS))).reshape(-1, CHUNK)
        out = []
        for number, left in enumerate(combinations(range(CHUNK), ERRORS)):
            out.append(mix(np.delete(each, left, axis=1).sum(1, dtype=np.uint64) + np.uint64(number)))
    return distinct(np.concatenate(out))


def entries(h: np.ndarray) -> np.ndarray:
    """The keys of a set; none of an empty one."""
    return keys(signature(h)) if len(h) else h


def near(symbols: np.ndarray, sizes: np.ndarray, parts: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Rows of different parts within the threshold whose sizes allow a link; the caller may merge parts as pairs come."""
    order = np.argsort(sizes, kind="stable")
    symbols, sizes = symbols[order], sizes[order]
    ends = np.searchsorted(sizes * num, sizes * den, "right")  # sizes rise: no set beyond is small enough to link
    for i, end in enumerate(ends.tolist()):
        rest = np.arange(i + 1, end)
        rest = rest[parts[order[rest]] != parts[order[i]]]
        if len(rest):
            for j in rest[(symbols[rest] != symbols[i]).sum(1) <= threshold()]:
                if parts[order[i]] != parts[order[j]]:
                    yield int(order[i]), int(order[j])


def linked(ids: list[int], sets: list[np.ndarray], parts: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links among these sets that join their parts as far as any links do; parts is changed to the joined ones."""
    sizes = np.array(list(map(len, sets)), np.int64)
    for a, b in near(np.array([signature(s) for s in sets]), sizes, parts, num, den):
        common = int(member(sets[a], sets[b]).sum())
        if (num + den) * common >= num * int(sizes[a] + sizes[b]):
            parts[parts == parts[b]] = parts[a]
            yield ids[a], ids[b]


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents link when ``den * |A and B| >= num * |A or B|`` over their
    k-word shingles; component_id is the smallest doc_id that links reach, and
    only that document of a component is kept. The result is a table in the
    shared folder, which ``tables.remove`` deletes. num / den below 0.8 leaves
    the range that the signature is laid out for.
    """
    if 5 * num < 4 * den:
        raise ValueError("the signature is laid out for similarities of 0.8 or more")
    rows = components_by_leaves(docs, k, entries, partial(linked, num=num, den=den))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of documents over two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80, 100)
