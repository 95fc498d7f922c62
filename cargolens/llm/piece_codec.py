"""SentencePiece BPE by a table of prefixes: the last token of every prefix, then ids from the end.

Merges by (score, place) have one result, and what stands on one side of a
token boundary was merged without the other side. So a row of tokens is the
result exactly if each two neighbours are what merging their own text gives,
and every prefix of a text has one last token. An automaton over the pieces
finds those that end at a place; the one whose left neighbour, which the table
already holds, it can stand beside is that last token. Nothing is merged but
the few characters of two neighbours, and that once for each two.

No piece of these vocabularies goes on from another character into the sign
for a space, so a token boundary lies before every run of such signs, as it
does on both sides of a character that is in no piece. The table is made for
each stretch between them, and equal stretches of a worker share it. In a
vocabulary with such pieces only the latter part a text into stretches.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm import shared

SPACE = "▁"  # fixed value: the sign for a space
NEVER = float("-inf")
UNKNOWN = " ⁇ "  # fixed value: what an unknown id reads as
NORMAL, UNKNOWN_KIND, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file
STRETCHES, LONGEST_KEPT, PAIRS = 1 << 18, 64, 1 << 19  # a worker remembers up to twice so many stretches of at most so many characters, and so many pairs


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; numbers of 4 and 8 bytes as bytes."""

    def number(at_: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at_]
            value, shift, at_ = value | (b & 127) << shift, shift + 7, at_ + 1
            if b < 128:
                return value, at_

    place = 0
    while place < len(data):
        key, place = number(place)
        if key & 7 == 0:
            value, place = number(place)
        else:
            size, place = number(place) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], place)
            value, place = data[place : place + size], place + size
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds by id, and whether a text begins with a space of its own."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool

    @staticmethod
    def read(model: bytes) -> Vocabulary:
        """ValueError for a model that isn't BPE with byte fallback, or that changes texts before it encodes them."""
        rows, trainer, normaliser = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                rows.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else normaliser).update(fields(value))
        pieces, scores, kinds = zip(*rows, strict=True)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("not a BPE model with byte fallback and spaces before words")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("a model that normalises texts")
        if {USER_DEFINED, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
            raise ValueError("a model with pieces of its user, unused ones or without all bytes")
        return Vocabulary(pieces, scores, kinds, bool(normaliser.get(3, 1)))


def merges(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """text merged by the best score, the first place at ties: the tokens, and before each merge its score, the first part and the last part."""
    parts, steps = list(text), []
    while len(parts) > 1:
        best, place = max((scores.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == NEVER:
            break
        steps.append((best, parts[0], parts[-1]))
        parts[-place : 2 - place] = [parts[-place] + parts[1 - place]]
    return parts, [*steps, (NEVER, parts[0], parts[-1])]


@dataclass
class Codec:
    """Encodes and decodes single texts with one vocabulary."""

    vocabulary: Vocabulary
    known: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    def __post_init__(self):
        v = self.vocabulary
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == NORMAL}
        self.scores = {p: v.scores[i] for p, i in self.ids.items()}
        self.bytes_ = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes_)}
        self.end = v.pieces.index("</s>")
        self.readings = [v.pieces[i].replace(SPACE, " ") if k == NORMAL else UNKNOWN if k == UNKNOWN_KIND else "" for i, k in enumerate(v.kinds)]
        for b, i in enumerate(self.bytes_):
            self.readings[i] = chr(b) if b < 128 else None  # the others mean nothing alone
        self.automaton = ahocorasick.Automaton()
        self.steps = {}
        for p in self.ids:
            if len(p) > 1:
                parts, steps = merges(p, self.scores)
                if len(parts) == 1:  # a piece that merging never makes is never a token
                    self.steps[p] = steps
                    self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        across = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        inside = re.escape("".join(sorted({c for p in self.ids for c in p} - {SPACE})))
        self.stretches = re.compile(f"[{inside}{SPACE}]+|[^{inside}{SPACE}]" if across else f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]").findall

    def beside(self, left: str, right: str) -> bool:
        """Whether merging left and right together gives just these two: no merge across comes before what is left to merge on either side."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[left, right] = self.apart(self.steps.get(left) or [(NEVER, left, left)], self.steps.get(right) or [(NEVER, right, right)])
        return ok

    def apart(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        i = j = 0
        while True:
            (a, _, end), (b, start, _) = left[i], right[j]
            across = self.scores.get(end + start, NEVER)
            if across > a and across >= b:  # at ties the first place is merged first
                return False
            if a == b == NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[str]:
        """The tokens of a stretch: the last one of each prefix, then read from the end."""
        last, done, pairs = ["", *text], -1, self.pairs  # where no longer piece can stand, the character stands alone
        for end, piece in self.automaton.iter(text):  # by end, the longest first
            if end != done:
                start = end + 1 - len(piece)
                ok = start == 0 or pairs.get((last[start], piece))
                if ok or (ok is None and self.beside(last[start], piece)):
                    last[end + 1], done = piece, end
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def stretch(self, text: str) -> list[int]:
        """A stretch's ids."""
        got = self.older.get(text)
        if got is None:
            got = []
            for t in self.tokens(text):
                i = self.ids.get(t)
                got += [self.bytes_[b] for b in t.encode()] if i is None else (i,)
            got = tuple(got)
        if len(text) <= LONGEST_KEPT:
            if len(self.known) >= STRETCHES:
                self.known, self.older = {}, self.known
            self.known[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        """The ids of a text, the end id last."""
        text, out = text.replace(" ", SPACE), []
        for s in self.stretches(SPACE + text if text and self.vocabulary.dummy_prefix else text):
            out += self.known.get(s) or self.stretch(s)
        out.append(self.end)
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes that stand together are read as UTF-8, each that belongs to no character as U+FFFD; the space that encoding put before the text goes."""
        parts = list(map(self.readings.__getitem__, ids))
        if None in parts:
            parts = list(self.read(ids))
        text = "".join(parts)
        v = self.vocabulary
        first = next((i for i in ids if v.kinds[i] != CONTROL), None)
        return text[1:] if v.dummy_prefix and first is not None and v.kinds[first] == NORMAL and v.pieces[first].startswith(SPACE) else text

    def read(self, ids) -> Iterator[str]:
        """What ids with bytes of longer characters stand for."""
        waiting = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                waiting.append(b)
                continue
            if waiting:
                yield from characters(bytes(waiting))
                waiting.clear()
            yield self.readings[i]
        yield from characters(bytes(waiting))


def characters(data: bytes) -> Iterator[str]:
    place = 0
    while place < len(data):
        for size in range(1, 5):
            try:
                yield data[place : place + size].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            yield "�"
        place += size


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec a worker; its memory of stretches serves the next task too."""
    return Codec(Vocabulary.read(model))


def passes(docs: DataFrame, model: bytes, column: str, schema: str, each) -> DataFrame:
    """docs with the columns that `each` makes of one column's values, some megabytes at a time; columns of those names are replaced."""
    spark = docs.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    docs = docs.drop(*(n for n in names if n != column))
    kept = [c for c in docs.columns if c not in names]
    sent = spark.sparkContext.broadcast(model)  # half a megabyte
    types = docs.select(*kept, column).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(sent.value)
        for batch in batches:
            values = batch.column(len(kept))
            for row, end in bounds(values):
                part = batch.slice(row, end - row)
                yield pa.record_batch([*part.columns[: len(kept)], *each(code, values.slice(row, end - row))], names=[*kept, *names])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields if f.name in kept), schema])
    return docs.select(*kept, column).mapInArrow(shared.tidied(run), out)


def bounds(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about a megabyte."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        for row, end, _, _ in at.chunks(*at.buffers(values)):
            yield row, end
    else:
        yield from ((i, min(i + 256, len(values))) for i in range(0, len(values), 256))


def lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))))


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs without `column`, with `ids`: the ids of its whole texts, the end id last.

    Null texts are empty, and an empty text is the end id alone. Rows stay
    rows, whatever their ids or repetitions; an empty table stays empty. A very
    long text is one row of a batch of its own. The model file is read on the
    driver and sent to the tasks.
    """
    texts = docs.withColumn("ids", F.coalesce(F.col(column).cast("string"), F.lit("")))
    texts = texts if column == "ids" else texts.drop(column)
    return passes(texts, Path(path).read_bytes(), "ids", "ids array<int>", lambda code, values: [lists([code.encode(t) for t in values.to_pylist()])])


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """rows without `column`, with `decoded`: the text of its ids; null ids and none are the empty text."""
    ids = rows.withColumn("decoded", F.coalesce(F.col(column).cast("array<int>"), F.array().cast("array<int>")))
    ids = ids if column == "decoded" else ids.drop(column)
    return passes(ids, Path(path).read_bytes(), "decoded", "decoded string", lambda code, values: [pa.array([code.decode(x) for x in values.to_pylist()], pa.string())])


def both_ways(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs without `column`, with `ids` and `decoded`, the text of these ids, in one pass."""

    def each(code: Codec, values: pa.Array) -> list[pa.Array]:
        ids = [code.encode(t) for t in values.to_pylist()]
        return [lists(ids), pa.array([code.decode(x) for x in ids], pa.string())]

    texts = docs.withColumn("ids", F.coalesce(F.col(column).cast("string"), F.lit("")))
    texts = texts if column == "ids" else texts.drop(column)
    return passes(texts, Path(path).read_bytes(), "ids", "ids array<int>, decoded string", each)


def digest_query(spark, sf_dir: str, name: str = "piece_bpe_32k.model") -> DataFrame:
    """op12: one row a document with its number of ids, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = both_ways(docs, public_tokenizers.path(name))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
