"""Token counts: pieces are counted once for each distinct pre-token.

Texts become pre-token frequencies in one pass: a part, which is some
megabytes of texts, has the distinct pre-tokens of its documents, each
document's frequencies by place in that list, and nothing else. The lists of
all parts meet by pre-token, where equal ones stand together and are encoded
once; the counts go back to their parts, which sum them for each document.
No ids are made, and a task holds one part or one batch at a time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm import shared
from cargolens.llm.passages import keyed

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
PART_PRE_TOKENS, PART_BYTES = 600_000, 64 << 20  # a part ends when it has so many distinct pre-tokens or bytes
PART = pa.schema([("part", pa.int64()), ("pre_tokens", pa.list_(pa.string())), ("pid", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int32())), ("frequencies", pa.binary())])
PART_SQL = "part long, pre_tokens array<string>, pid array<long>, n_bytes array<long>, specials array<int>, frequencies binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, compressed by bytes of equal weight."""
    out = [np.array([len(c) for c in columns], "<i8").tobytes()]
    out += [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(out), 1)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw, out = zstandard.decompress(data), []
    sizes, at_ = np.frombuffer(raw, "<i8", n), 8 * n
    for k in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k, at_).reshape(4, k).T).view("<u4").ravel().astype(np.int64))
        at_ += 4 * k
    return out


def special_tokens(vocabulary: str) -> list[str]:
    """Strings that stand for a token wherever they occur; ValueError for a vocabulary whose pre-tokens aren't those of PATTERN."""
    known = json.loads(vocabulary)
    pre, added = known.get("pre_tokenizer") or {}, known.get("added_tokens", [])
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or known.get("normalizer"):
        raise ValueError("not a byte-level vocabulary")
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions on what stands beside them")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def splitter(special: list[str]):
    """A function from a text to its pre-tokens and how many special strings stand between them."""
    find = regex.compile(PATTERN).findall
    between = regex.compile("|".join(map(regex.escape, special))) if special else None

    def split(text: str) -> tuple[list[str], int]:
        parts = between.split(text) if between and any(s in text for s in special) else [text]
        return [t for p in parts for t in find(p)], len(parts) - 1

    return split


def parts(special: list[str], most: int):
    """Parts of the texts: their pre-tokens, and each document's frequencies of them by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = splitter(special), TaskContext.get().partitionId() << 36

        def fresh():
            return {}, [[] for _ in range(6)], 0

        def ended(known, columns) -> pa.RecordBatch:
            ids, sizes, specials, kinds, place, freq = (np.concatenate(c) if isinstance(c[0], np.ndarray) else sum(c, []) for c in columns)
            step = np.diff(place, prepend=0)
            step[(np.cumsum(kinds) - kinds)[kinds > 0]] = place[(np.cumsum(kinds) - kinds)[kinds > 0]]  # places ascend within a document
            return pa.record_batch([pa.array([x], t) for x, t in zip([number, list(known), ids, sizes, specials, packed(kinds, step, freq)], PART.types, strict=True)], schema=PART)

        known, columns, size = fresh()
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for row, end, _, offsets in at.chunks(*at.buffers(texts)):
                flat, lengths, specials = [], [], []
                for text in texts.slice(row, end - row).to_pylist():
                    tokens, n = split(text)
                    flat += tokens
                    lengths.append(len(tokens))
                    specials.append(n)
                coded = pa.array(flat, pa.large_string()).dictionary_encode()
                here = np.fromiter((known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                doc = np.repeat(np.arange(end - row), lengths)
                each, freq = np.unique((doc << 32) | here[coded.indices.to_numpy()], return_counts=True)
                kinds = np.bincount(each >> 32, minlength=end - row)
                for c, x in zip(columns, (ids.slice(row, end - row).to_pylist(), np.diff(offsets), np.array(specials, np.int32), kinds, each & 0xFFFFFFFF, freq), strict=True):
                    c.append(x)
                size += int(offsets[-1])
                if len(known) >= most or size >= PART_BYTES:
                    yield ended(known, columns)
                    number += 1
                    known, columns, size = fresh()
        if columns[0]:
            yield ended(known, columns)

    return run


def piece_counts(vocabulary):
    """(part, place and pieces in one number) of rows that come in order of pre-token: each is encoded when it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode = Tokenizer.from_str(vocabulary.value)
        encode.no_padding()
        encode.no_truncation()
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            kinds = coded.dictionary.to_pylist()
            new = [t for t in kinds if t != last[0]]
            counts = dict(zip(new, (len(e) for k in range(0, len(new), 2000) for e in encode.encode_batch_fast(new[k : k + 2000], add_special_tokens=False)), strict=True))
            counts.setdefault(*last)
            pieces = np.array([counts[t] for t in kinds], np.int32)[coded.indices.to_numpy()]
            if batch.num_rows:
                end = batch.column(0)[-1].as_py()
                last = (end, counts[end])
            yield pa.record_batch([batch.column(1), pa.array(batch.column(2).to_numpy().astype(np.int64) << 32 | pieces)], names=["part", "found"])

    return run


def summed(part: pa.Table, found: pa.Table) -> pa.Table:
    """pid, bytes and tokens of a part's documents."""
    get = lambda c: part.column(c)[0].values
    kinds, place, freq = unpacked(part.column("frequencies")[0].as_py(), 3)
    ends = np.cumsum(kinds)
    place = np.cumsum(place)
    starts = (ends - kinds)[kinds > 0]
    place -= np.repeat(np.r_[0, place][starts], kinds[kinds > 0])
    both = found.column("found").to_numpy()
    pieces = np.zeros(len(both), np.int64)
    pieces[both >> 32] = both & 0xFFFFFFFF
    sums = np.r_[0, np.cumsum(pieces[place] * freq)]
    tokens = sums[ends] - sums[ends - kinds] + get("specials").to_numpy()
    return pa.table([get("pid"), get("n_bytes"), pa.array(tokens, pa.int64())], names=["pid", "n_bytes", "n_tokens"])


def count(docs: DataFrame, path: str, limit: int = 512, part_pre_tokens: int = PART_PRE_TOKENS) -> DataFrame:
    """pid, n_bytes, n_tokens and over_limit of every document.

    Null texts are empty and have no token. Each row is counted by its own
    text, whatever its doc_id; pid is null where that is. Special strings
    inside a text are one token each, as the library's default has it. The
    vocabulary goes to the tasks as text, so its file is needed on the driver
    alone. Other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = Path(path).read_text(encoding="utf-8")
    special, sent = special_tokens(vocabulary), spark.sparkContext.broadcast(vocabulary)
    rows = shared.table(keyed(docs).mapInArrow(parts(special, part_pre_tokens), PART_SQL))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.select("part", F.posexplode("pre_tokens").alias("place", "t")).select("t", "part", "place").repartition(n, "t").sortWithinPartitions("t")
    pieces = lists.mapInArrow(piece_counts(sent), "part long, found long")
    out = rows.drop("pre_tokens").groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(summed, "pid long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def digest_query(spark, sf_dir: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    """op8: one row a document with its token count."""
    import public_tokenizers

    out = count(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(name))
    return out.select(F.col("pid").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
