"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is just one token that its encoding
can end with.  An automaton over the vocabulary lists the tokens that are
suffixes of each prefix (its states are linked to their longest suffix that is
a state too); the last token of a prefix is the one that may follow the last
token of the prefix before it.  Back-pointers then give the ids.  No merge is
ever carried out on the text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How this kind of vocabulary cuts text into pieces.  Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs that a task remembers; memory that no input can grow.
REMEMBERED = 200_000
#: Longer pieces aren't remembered.
LONG = 64
#: Characters of text encoded before a batch is passed on.
PASS_ON = 4 << 20


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, their merges and the automaton of one byte-level vocabulary file."""

    def __init__(self, text: str):
        file = json.loads(text)
        as_byte = printable_bytes()
        ids = file["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {n: bytes(map(as_byte.__getitem__, t)) for t, n in ids.items()}
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes_of |= {n: t.encode() for t, n in self.added.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, n)
            self.parts.setdefault(whole, pair)
        self.cut = regex.compile(PIECES)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        special = set(self.added.values())
        for n in sorted((n for n in ids.values() if n not in special), key=lambda n: len(self.bytes_of[n])):
            left, right = self.parts.get(n, (n, n))
            whole[n] = left == n or (whole.get(left, False) and whole.get(right, False) and self.fits(left, right, n))
            if whole[n]:
                self.automaton.add_word(self.bytes_of[n].decode("latin-1"), (n, len(self.bytes_of[n])))
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        size = max(self.bytes_of, default=-1) + 1
        self.table = [self.bytes_of.get(n, b"") for n in range(size)]

    def fits(self, left: int, right: int, merged: int | None = None) -> bool:
        """Whether left and then right can stand side by side in an encoding: no merge across the seam comes first.

        The tokens that touch the seam while the two are being built are the
        right-most parts of left and the left-most parts of right.  Two of them
        meet if neither has been merged away before; of equal merges the one
        further left goes first.  merged: the token that the two may make.
        """
        never = len(self.rank)
        a, until_a = left, never
        while True:
            b, until_b = right, never
            while True:
                r = self.rank.get((a, b))
                if r is not None and r < until_a and r <= until_b and not (merged is not None and (a, b) == (left, right)):
                    return False
                if (p := self.parts.get(b)) is None:
                    break
                until_b, b = self.rank[p], p[0]
            if (p := self.parts.get(a)) is None:
                return True
            until_a, a = self.rank[p], p[1]

    def forget(self) -> None:
        """Gives up what has been remembered, so that an idle worker holds the vocabulary alone."""
        self.pieces.clear()
        self.pairs.clear()

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of one piece: the last token of every prefix, then back from the end."""
        n = len(piece)
        last, start_of, known = [-1] * (n + 1), [0] * (n + 1), self.pairs.get
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                if (before := last[start]) < 0:
                    continue
                fits = known(before << 32 | token)
                if not (self.follows(before, token) if fits is None else fits):
                    continue
            last[end], start_of[end] = token, start
        out = array("i")
        while n > 0:
            out.append(last[n])
            n = start_of[n]
        out.reverse()
        return out.tobytes()

    def encoded(self, text: str, out: list[bytes]) -> None:
        """Adds the ids of a text without added tokens to out, as 32-bit numbers."""
        known = self.pieces
        for piece in self.cut.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= LONG:
                    if len(known) >= REMEMBERED:  # the older half goes
                        for old in [*islice(known, REMEMBERED // 2)]:
                            del known[old]
                    known[piece] = ids
            out.append(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        if self.marks is not None:
            for m in self.marks.finditer(text):
                self.encoded(text[at : m.start()], out)
                out.append(np.array([self.added[m[0]]], "<i4").tobytes())
                at = m.end()
        self.encoded(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        table, size = self.table, len(self.table)
        if ids and not (0 <= min(ids) and max(ids) < size):
            ids = [n for n in ids if 0 <= n < size]
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def shared(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast: its size is that of the vocabulary, whatever the input."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode(docs: DataFrame, path: str, column: str = "text", name: str = "ids") -> DataFrame:
    """docs and the ids of each whole text in an array<int> column.  A null text counts as empty and has no ids.

    A column called like `name` is replaced.  Strings of added tokens in a text
    become their ids, as the usual library does unless told otherwise.
    """
    file = shared(docs.sparkSession, path)
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            texts, lo, size, found = batch.column(column), 0, 0, []
            for k, text in enumerate(texts):
                found.append(words.encode(text.as_py() or ""))
                size += len(found[-1])
                if size > PASS_ON or k == len(texts) - 1:
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                    part = batch.slice(lo, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, ids], [*batch.schema.names, name])
                    lo, size, found = k + 1, 0, []
        words.forget()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, column: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded and the text of its ids in a string column; null ids give null.  A column called like `name` is replaced."""
    file = shared(encoded.sparkSession, path)
    kept = encoded.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            ids, lo, size, found = batch.column(column), 0, 0, []
            for k in range(len(ids)):
                own = ids[k]
                found.append(words.decode(own.values.to_numpy(zero_copy_only=False).tolist()) if own.is_valid else None)
                size += len(found[-1] or "")
                if size > PASS_ON or k == len(ids) - 1:
                    part = batch.slice(lo, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*batch.schema.names, name])
                    lo, size, found = k + 1, 0, []

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, SHA-256 of its comma-joined ids, and SHA-256 of the text decoded from them.

    A null text counts as empty and has no tokens.  Null and repeated ids give
    rows like any other; further columns are not read; an empty table gives an
    empty one.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    both = decode(encode(texts, path).drop("text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
