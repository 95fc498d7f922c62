"""Substring dedup over words with an FM-index per shard.

Each bucket of passages.py is a shard: the contexts shipped to it become one
word sequence, whose Burrows-Wheeler transform is held in a wavelet matrix with
packed bits and block counts. The shard's documents are then streamed through
backward search; a window whose interval holds a smaller document is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cargolens.llm import arrowtext as at
from cargolens.llm import shared
from cargolens.llm.passages import Spec, covered, with_spans

STREAM_AT_ONCE = 200_000


class FMIndex:
    """Counts and locates patterns of up to `depth` symbols by backward search."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.n, sigma = n, int(symbols.max(initial=0)) + 1
        rank, reach = symbols.astype(np.int64), 1
        while reach < depth:  # suffixes by their first `depth` symbols, doubling
            key = rank * (max(n, sigma) + 1)
            key[:-reach or None] += (rank[reach:] + 1)[: n - reach] if reach < n else 0
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = new
            reach *= 2
        self.rank = rank
        self.sa = np.argsort(rank, kind="stable")
        bwt = symbols[self.sa - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))]
        self.levels, self.bits = [], max(1, (sigma - 1).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (bwt >> shift) & 1
            raw = np.packbits(np.r_[bit.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            ones = np.r_[0, np.cumsum(np.bitwise_count(raw), dtype=np.int64)]
            self.levels.append((raw, ones, n - int(bit.sum()), shift))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for raw, ones, zeros, shift in self.levels:
            word = i >> 6
            r = ones[word] + np.bitwise_count(raw[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> shift) & 1 == 1, zeros + r, i - r)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with `symbol` put before them."""
        ends = self._descend(np.r_[symbol, symbol], np.r_[lo, hi])
        base = self.before[symbol] - self.start[symbol]
        return base + ends[: len(symbol)], base + ends[len(symbol) :]


class RangeMin:
    """The least of any interval of values, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            pick = np.flatnonzero(level == k)
            out[pick] = np.minimum(self.rows[k][lo[pick]], self.rows[k][hi[pick] - (1 << k)])
        return out


def matching(index: FMIndex, least: RangeMin, symbols: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For each end of a window, how many words before it (window at most) stand in a smaller document too."""
    length = np.zeros(len(ends), np.int64)
    live, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), index.n)
    for k in range(window):
        lo, hi = index.extend(symbols[ends[live] - 1 - k], lo, hi)
        more = hi - lo > 1
        live, lo, hi = live[more], lo[more], hi[more]
        if k >= 4 or k == window - 1:
            more = least(lo, hi) < owner[live]
            live, lo, hi = live[more], lo[more], hi[more]
        length[live] = k + 1
        if not len(live):
            break
    return length


def earlier_windows(window: int):
    """An index for passages.shards: windows that a smaller document has too."""

    def index(meta, data, offsets):
        if not len(meta):
            return (np.zeros(0, np.int64),) * 3
        gap = np.full(len(meta), 10, np.uint8)  # contexts stay apart
        spaced = np.insert(data, offsets[1:], gap)
        ids, first, _ = at.coded_words(spaced, offsets + np.arange(len(offsets)), lower=False)
        n = len(ids)
        place = np.arange(n) + np.searchsorted(first[1:], np.arange(n), side="right")  # one separator after each context
        symbols = np.zeros(n + len(meta), np.int64)
        symbols[place] = ids + 1
        doc_of_context, docs = np.unique(meta["d"], return_inverse=True)
        lows = np.searchsorted(doc_of_context, meta["d"] - meta["dup"])  # smaller documents are those before it
        context = np.searchsorted(first, np.arange(n), side="right") - 1
        owner = np.full(len(symbols), len(doc_of_context), np.int32)
        owner[place] = docs[context]
        fm = FMIndex(symbols, window)
        least = RangeMin(owner[fm.sa])
        i = np.flatnonzero(first[context + 1] - np.arange(n) >= window)
        key = fm.rank[place[i]] * (len(doc_of_context) + 1) + lows[context[i]]  # equal keys: equal windows for the same smaller documents
        _, once, back = np.unique(key, return_index=True, return_inverse=True)
        hit = np.zeros(len(once), bool)
        for k in range(0, len(once), STREAM_AT_ONCE):
            own = i[once[k : k + STREAM_AT_ONCE]]
            hit[k : k + STREAM_AT_ONCE] = matching(fm, least, symbols, place[own] + window, lows[context[own]], window) == window
        i = i[hit[back]]
        of = context[i]
        run = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (of[1:] != of[:-1])][: len(i)])
        last = np.r_[run[1:], len(i)] - 1 if len(i) else run
        return of[run], i[run] - first[of[run]], i[last] - first[of[run]] + window

    return index


def dedup(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """pid, doc_id, the number of words, and what is left after windows of smaller documents are gone.

    A null text has no words; texts of fewer words than the window lose none.
    A null doc_id is neither smaller nor larger than another: such rows lose
    nothing and remove nothing. Rows that share a doc_id don't remove each
    other's words; each loses what a smaller doc_id has of its own text. pid is
    the row's number, the doc_id where no row shares it. Other columns are not
    read.
    """
    spans = with_spans(docs, Spec(window, gram, True, True), earlier_windows(window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, span in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                kept, at_ = [], 0
                for s, e in covered(span, len(words)):
                    kept += words[at_:s]
                    at_ = e
                kept += words[at_:]
                whole = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch([batch.column(0), batch.column(1).field("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["pid", "doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return spans.mapInArrow(shared.tidied(cut), "pid long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op7: one row a document with the digest of its kept words."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
