"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

The automaton holds the normal pieces of a model file. One scan of a text
reports, at each position, all pieces that end there (the node's own and those
on its output links), and each relaxes the best score of its end; characters
that no path covers become byte pieces. Scores are the model's own.

No piece has white space after another character and none has a line feed, so
the best path of a text is the best paths of its units (a word with the spaces
before it) side by side; the paths of units met before are remembered by the
worker, within a bound. ``unit_pattern`` checks this of the vocabulary.

Text is framed as the model does: one space in front, spaces as U+2581, no
other normalization. A U+2581 of the text itself is coded by bytes, so
``decode(encode(text)) == text`` for every text.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids; an id outside the vocabulary, or bytes that are not UTF-8, decode
to U+FFFD; of paths of equal score, the one whose last pieces are longest is
taken; texts of any length are coded whole; repeated rows are coded each; other
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from courierlens.llm.tables import table
from courierlens.llm.token_counts import public_path
from courierlens.llm.words import blocks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units whose path a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: How much worse than the worst piece a character by bytes is, as in the library.
UNKNOWN_PENALTY = 10.0


class Paths(dict):
    """unit -> the ids of its best path, as bytes; filled as units come.

    Two generations of REMEMBERED units: when the new one is full it becomes
    the old one, and units that are met again move back.
    """

    def __init__(self, path):
        super().__init__()
        self.path, self.old = path, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(unit)
        if ids is None:
            ids = array("i", self.path(unit)).tobytes()
            if len(unit) > 64:
                return ids
        self[unit] = ids
        return ids


class Codec:
    """The automaton, scores and byte pieces of one model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {i: model.get_score(i) for i in plain}
        self.by_bytes = min(self.scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            piece = model.id_to_piece(i).replace(SPACE, " ")
            self.automaton.add_word(piece, (len(piece), self.scores[i], i))
        self.automaton.make_automaton()
        self.bytes_of = [b"" if model.is_control(i) else "�".encode() for i in ids]
        for i in plain:
            self.bytes_of[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        self.units = self.unit_pattern([model.id_to_piece(i) for i in plain]).findall
        self.known = Paths(self.path)

    @staticmethod
    def unit_pattern(pieces: list[str]) -> re.Pattern:
        """Splits a framed text where no piece can reach across."""
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):  # such a vocabulary has no inner borders
            return re.compile(r"(?s).+")
        return re.compile(f" *[^ \\n{SPACE}]+| +|\\n|{SPACE}")

    def path(self, unit: str) -> list[int]:
        """The ids of the best path; of equal paths, the one whose last pieces are longest."""
        n, by_bytes = len(unit), self.by_bytes
        best, start, piece = [-inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], done = 0.0, 0  # the best scores up to here are final

        def settle(end: int) -> None:
            """Let the characters up to an end be bytes where that is better."""
            for e in range(done + 1, end + 1):
                if (s := best[e - 1] + by_bytes) > best[e]:
                    best[e], start[e], piece[e] = s, e - 1, -1

        for last, (length, score, i) in self.automaton.iter(unit):  # the longest piece of an end first, then its output links
            end = last + 1
            if end > done + 1:
                settle(end - 1)
                done = end - 1
            if (s := best[end - length] + score) > best[end]:
                best[end], start[end], piece[end] = s, end - length, i
        settle(n)
        out: list[int] = []
        at = n
        while at:
            i = piece[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in reversed(unit[start[at] : at].encode()))
            at = start[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as int32 in the machine's order."""
        return b"".join(map(self.known.__getitem__, self.units(f" {text}"))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        table, size = self.bytes_of, len(self.bytes_of)
        if len(ids) and (ids.min() < 0 or ids.max() >= size):
            raw = b"".join(table[i] if 0 <= i < size else "�".encode() for i in ids.tolist())
        else:
            raw = b"".join(map(table.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", check: str | None = None, model: str = MODEL, path: str | None = None) -> DataFrame:
    """df with a column of piece ids (array of int); an existing column of that name is replaced.

    check: also a column of this name, whether the ids decode to the text; true
    of a null text. It is found in the same pass.
    """
    df = df.drop(*(c for c in (ids, check) if c is not None and c != text))
    added = [StructField(ids, ArrayType(IntegerType())), *([StructField(check, BooleanType())] if check else [])]
    schema = StructType([*df.schema.fields, *added])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_path(model))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in blocks(texts.to_pylist()):
                part = texts[a:b].to_pylist()
                rows = [None if t is None else c.encode(t) for t in part]
                sizes = np.array([len(r or b"") // 4 for r in rows])
                values = np.frombuffer(b"".join(r or b"" for r in rows), np.int32)
                none = np.array([r is None for r in rows])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(none, False) if none.any() else None)
                new = [pa.ListArray.from_arrays(offsets, pa.array(values))]
                if check:
                    new.append(pa.array([t is None or c.decode(np.frombuffer(r, np.int32)) == t for t, r in zip(part, rows, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in batch.columns), *new], [*batch.schema.names, *[f.name for f in added]])

    return df.mapInArrow(of, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL, path: str | None = None) -> DataFrame:
    """df with a column of the text that the ids stand for; an existing column of that name is replaced."""
    df = df.drop(text) if ids != text else df
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_path(model))
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            for at in range(0, max(len(col), 1), 256):
                part = col[at : at + 256]
                rows = [None if not x.is_valid else c.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False)) for x in part]
                yield pa.RecordBatch.from_arrays([*(x[at : at + 256] for x in batch.columns), pa.array(rows, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(of, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded and decoded: its number of pieces, a digest of the ids, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = encode(docs, check="round_trip")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64("ids").alias("ids_digest"),
        "round_trip",
    )
