"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens as the byte-level tokenizer does; the distinct
new pre-tokens of a block are held as one ragged numpy array, and in each round
every pre-token applies its own lowest-rank pair, all of them at once. What
survives when no pair has a rank left is the number of tokens. Counts of
pre-tokens already met are remembered by the worker, within a bound.

A merge's result always ranks after the merge itself, so applying the lowest
pair of a sequence everywhere, from left to right, is the same as the usual
one-at-a-time order. A round costs as much as all symbols left, so the few
pre-tokens of over ``LONG`` characters, unbroken runs such as encoded data, are
merged one pair after the other by a heap instead.

Defined results: a null text counts as empty, 0 tokens and 0 bytes; lone
surrogates cannot occur in a Spark string; texts of any length are counted
whole; pairs of equal rank in one pre-token merge from the left; repeated rows
are counted each; other columns are ignored; special strings in a text are one
token each, as the library does by default; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import table
from courierlens.llm.words import blocks

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens whose count a worker remembers; beyond it the memory is emptied.
REMEMBERED = 500_000
#: Pre-tokens of more characters are merged apart, and not remembered.
LONG = 512
#: The public pre-tokenization pattern of byte-level BPE (a fixed value); white space is Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Ranks of pairs, as sorted arrays, and the counts of pre-tokens met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.counts: dict[str, int] = {}
        self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, pair: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; a number past all ranks for none."""
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], len(self.pairs))

    def merge(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        data = [t.encode() for t in tokens]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ids = self.first[np.frombuffer(b"".join(data), np.uint8)]
        seq = np.repeat(np.arange(len(data)), sizes)
        final = sizes.copy()
        none = len(self.pairs)
        while len(ids) > 1:
            rank = self.rank(ids[:-1] * self.size + ids[1:])
            rank[seq[:-1] != seq[1:]] = none
            best = np.full(len(data), none, np.int64)
            np.minimum.at(best, seq[:-1], rank)
            going = best[seq] < none  # the others are done
            hit = (rank == best[seq[:-1]]) & (rank < none)
            # runs of overlapping hits (a a a): every second one, from the left
            at = np.flatnonzero(hit)
            if not len(at):
                break
            start = np.concatenate(([True], np.diff(at) > 1))
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            ids[at] = self.merged[rank[at]]
            going[at + 1] = False
            dropped = np.bincount(seq[at + 1], minlength=len(data))
            final -= dropped
            ids, seq = ids[going], seq[going]
        return final

    def merge_long(self, token: str) -> int:
        """The number of symbols that survive in one pre-token, by a heap of (rank, place)."""
        ids = self.first[np.frombuffer(token.encode(), np.uint8)].tolist()
        n = left = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank, size, merged = self.rank_of.get, self.size, self.merged.tolist()
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & (1 << 40) - 1
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] * size + ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = merged[r], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (k := before[i]) >= 0 and (r := rank(ids[k] * size + ids[i])) is not None:
                heapq.heappush(heap, r << 40 | k)
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for t in texts:
            pieces = self.special.split(t) if self.special else [t]
            extra.append(len(pieces) - 1)
            parts.append([w for p in pieces for w in self.split(p)] if len(pieces) > 1 else self.split(t))
        every = {w for p in parts for w in p}
        apart = {w: self.merge_long(w) for w in every if len(w) > LONG}
        new = [w for w in every if len(w) <= LONG and w not in self.counts]
        if len(self.counts) + len(new) > REMEMBERED:
            self.counts.clear()
            new = [w for w in every if len(w) <= LONG]
        if new:
            self.counts.update(zip(new, self.merge(new).tolist(), strict=True))
        get = ChainMap(apart, self.counts).__getitem__ if apart else self.counts.__getitem__
        return [n + sum(map(get, p)) for n, p in zip(extra, parts, strict=True)]


@cache
def merger(path: str) -> Merger:
    """One for each worker process."""
    return Merger(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row; the file is opened where the tasks run."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path or public_path(tokenizer))
        for batch in batches:
            texts = batch.column("text")
            for a, b in blocks(texts.to_pylist()):
                part = [t or "" for t in texts[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(m.count(part), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass the context limit."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
