"""Repeated passages over all documents, found through content-chosen anchors.

A window is `window` consecutive units (bytes or words) of one document. Among
the gram hashes inside any window the smallest is its anchor, so equal windows
have equal anchors wherever they stand. The stages are one lazy plan:

1. every document's anchors go, packed, to the bucket of their hash, which
   keeps those that occur at least twice;
2. documents with such anchors ship the surrounding units (the only places a
   repeated window can be) to the same buckets; equal contexts of one batch
   are shipped once, so a large group of copies costs one context a batch;
3. each bucket's index (a suffix array or an FM-index, given by the caller)
   answers which windows repeat, as spans of documents;
4. spans meet their rows by a number of each row's own (shared.identified).

Hashes choose anchors and sort contexts; contexts count as equal only if their
bytes or words are.

Buckets are `per_partition` times spark.sql.shuffle.partitions and each holds
its share of the anchors; nothing is collected and nothing is broadcast. The
exchange of texts by id is used by steps 2 and 4 alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm import shared

ANCHOR = np.dtype([("h", "<u8"), ("d", "<i8"), ("p", "<i4")])
MARK = np.dtype([("d", "<i8"), ("p", "<i4")])
SPAN = np.dtype([("d", "<i8"), ("s", "<i4"), ("e", "<i4")])
CONTEXT = np.dtype([("a", "<u8"), ("c", "<u8"), ("d", "<i8"), ("s", "<i4"), ("u", "<i4"), ("n", "<i4"), ("dup", "<i4")])  # dup: also in another place; for earlier_only how far its id's least number lies below d


@dataclass(frozen=True)
class Spec:
    """What a window is, and how many units an anchor's gram has."""

    window: int
    gram: int
    by_words: bool
    earlier_only: bool  # a window counts only if a smaller id has it


def units(data, offsets, spec):
    """(hash sums over units, first unit of each row, byte start and end of each unit)."""
    if not spec.by_words:
        return at.prefix_sums(data), offsets, None, None
    starts, ends, first = at.words(data, offsets)
    return at.prefix_sums(at.word_hashes(data, offsets, lower=False)[0]), first, starts, ends


def anchors(sums, first, spec):
    """Units at which an anchor begins, their rows and hashes."""
    n = len(sums) - spec.gram
    if n < spec.window - spec.gram + 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    i = np.arange(n)
    h = at.slice_hash(sums, i, i + spec.gram)
    bound = np.zeros(len(sums) + 1, np.int32)
    inner = first[1:-1]
    np.add.at(bound, np.maximum(inner - spec.gram + 1, 0), 1)
    np.add.at(bound, inner, -1)
    h[np.cumsum(bound)[:n] > 0] = at.U64_MAX
    pos = at.minimizers(h, spec.window - spec.gram + 1)
    row = np.searchsorted(first, pos, side="right") - 1
    keep = first[row + 1] - first[row] >= spec.window
    pos, row = pos[keep], row[keep]
    return pos, row, h[pos]


def packed(bucket: np.ndarray, values: np.ndarray, n_buckets: int) -> dict[int, bytes]:
    """The values of each bucket, as bytes."""
    order = np.argsort(bucket, kind="stable")
    values, cut = values[order], np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    return {int(b): values[cut[b] : cut[b + 1]].tobytes() for b in np.flatnonzero(np.diff(cut))}


def rows_of(schema: pa.Schema, *parts: dict[int, bytes]) -> pa.RecordBatch:
    keys = sorted(set().union(*parts))
    return pa.record_batch([pa.array(keys, pa.int32()), *(pa.array([p.get(k) for k in keys], pa.binary()) for p in parts)], schema=schema)


def joined(column, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def scan(spec: Spec, n_buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for row, _, data, offsets in at.chunks(*at.buffers(batch.column(1))):
                sums, first, *_ = units(data, offsets, spec)
                pos, of, h = anchors(sums, first, spec)
                a = np.empty(len(pos), ANCHOR)
                a["h"], a["d"], a["p"] = h, keys[row + of], pos - first[of]
                found.append(a)
            a = np.concatenate(found) if found else np.empty(0, ANCHOR)
            a = a[np.argsort(a["h"], kind="stable")]
            head = np.flatnonzero(np.r_[True, a["h"][1:] != a["h"][:-1]][: len(a)])
            many = np.diff(np.r_[head, len(a)]) > 1
            repeated = a[np.repeat(many, np.diff(np.r_[head, len(a)]))]
            one = a[head]
            one["p"][many] = -1  # known to repeat, and its places are marks
            marks = np.empty(len(repeated), MARK)
            marks["d"], marks["p"] = repeated["d"], repeated["p"]
            yield rows_of(schema, packed((one["h"] % np.uint64(n_buckets)).astype(np.int32), one, n_buckets), packed((at.mix(marks["d"].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), marks, n_buckets))

    return run


def repeated_anchors(table: pa.Table) -> pa.Table:
    a, m = joined(table.column("anchors"), ANCHOR), joined(table.column("marks"), MARK)
    a = a[np.argsort(a["h"], kind="stable")]
    head = np.flatnonzero(np.r_[True, a["h"][1:] != a["h"][:-1]][: len(a)])
    if len(a):
        size = np.diff(np.r_[head, len(a)])
        again = (size > 1) | (np.minimum.reduceat(a["p"], head) < 0)
        a = a[np.repeat(again, size)]
        a = a[a["p"] >= 0]
    return pa.table({"pid": np.concatenate([a["d"], m["d"]]), "pos": np.concatenate([a["p"], m["p"]])})


def union(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document, merged."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["s"], spans["d"]))]
    doc = np.cumsum(np.r_[0, spans["d"][1:] != spans["d"][:-1]]).astype(np.int64) << 32
    top = np.maximum.accumulate(doc + spans["e"])
    head = np.flatnonzero(np.r_[True, (doc + spans["s"])[1:] > top[:-1]])
    out = spans[head]
    out["e"] = top[np.r_[head[1:], len(spans)] - 1] - doc[head]
    return out


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the slices, one after another."""
    size = end - start
    at_ = np.repeat(start - (np.cumsum(size) - size), size)
    return data[at_ + np.arange(len(at_))] if len(at_) else data[:0]


def told_apart(same: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, spec: Spec) -> np.ndarray:
    """same, changed where slices of data with an equal value differ in their bytes or words."""
    order = np.argsort(same, kind="stable")
    again = np.flatnonzero(same[order][1:] == same[order][:-1]) + 1
    if not len(again):
        return same
    raw, out = memoryview(np.ascontiguousarray(data)), same.copy()
    part = (lambda i: b" ".join(bytes(raw[lo[i] : hi[i]]).split())) if spec.by_words else (lambda i: raw[lo[i] : hi[i]])
    last, head = -1, None
    for j in again.tolist():
        if j != last + 1:
            head = part(order[j - 1])
        last, own = j, part(order[j])
        if own != head:
            out[order[j]] = int.from_bytes(hashlib.blake2b(bytes(own), digest_size=8).digest(), "little")
    return out


def contexts(spec: Spec, n_buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("meta", pa.binary()), ("body", pa.binary()), ("spans", pa.binary())])
    before = spec.window - spec.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            behind = keys - batch.column(3).field("low").to_numpy(zero_copy_only=False)  # rows of the same id before it
            mark_off, mark = marks.offsets.to_numpy(), marks.values.to_numpy(zero_copy_only=False)
            whole, parts = at.buffers(batch.column(1)), []
            for row, end_row, data, offsets in at.chunks(*whole):
                sums, first, starts, ends = units(data, offsets, spec)
                count = np.diff(mark_off[row : end_row + 1])
                of = np.repeat(np.arange(end_row - row), count)
                g = first[of] + mark[mark_off[row] : mark_off[end_row]]
                s, e = np.maximum(first[of], g - before), np.minimum(first[of + 1], g + spec.window)
                keep = e - s >= spec.window
                of, g, s, e = of[keep], g[keep], s[keep], e[keep]
                base = whole[1][row]
                lo, hi = (base + s, base + e) if starts is None else (base + starts[s], base + ends[e - 1]) if len(s) else (s, e)
                parts.append((row + of, s - first[of], e - first[of], lo, hi, at.slice_hash(sums, g, g + spec.gram), at.slice_hash(sums, s, e) ^ at.mix((g - s).astype(np.uint64))))
            at_row, s, e, lo, hi, anchor, same = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 7
            if not len(at_row):
                continue
            d, behind = keys[at_row], behind[at_row]
            same = told_apart(same, lo, hi, whole[0], spec)
            order = np.lexsort((s, d, same))
            new = np.r_[True, (same[order][1:] != same[order][:-1]) | (d[order][1:] != d[order][:-1]) | (s[order][1:] != s[order][:-1])]
            order = order[new]  # rows alike in id and text are one document
            head = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
            size = np.diff(np.r_[head, len(order)])
            first_doc = np.repeat(d[order][head], size)
            if spec.earlier_only:
                direct, dup = d[order] - behind[order] > first_doc, behind[order]
                ship = ~direct  # rows of the first one's id, too
            else:
                many = np.repeat(size > 1, size)
                ship = np.zeros(len(order), bool)
                ship[head] = True
                direct, dup = many, many
            spans = np.empty(int(direct.sum()), SPAN)
            spans["d"], spans["s"], spans["e"] = (x[order][direct] for x in (d, s, e))
            spans = union(spans)
            kept = order[ship]
            meta = np.empty(len(kept), CONTEXT)
            meta["a"], meta["c"], meta["d"], meta["s"], meta["u"], meta["n"], meta["dup"] = anchor[kept], same[kept], d[kept], s[kept], (e - s)[kept], (hi - lo)[kept], dup[ship]
            bucket = (anchor[kept] % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            body = {int(b): squeeze.compress(gather(whole[0], lo[kept[by[cut[b] : cut[b + 1]]]], hi[kept[by[cut[b] : cut[b + 1]]]]).tobytes()) for b in np.flatnonzero(np.diff(cut))}
            yield rows_of(schema, packed(bucket, meta, n_buckets), body, packed((at.mix(spans["d"].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), spans, n_buckets))

    return run


def shards(index: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], spec: Spec) -> Callable:
    """index(contexts, bytes, offsets of contexts) gives repeated windows: context, first and end unit in it.

    Equal contexts are answered at once and stand in the index once; contexts
    of an anchor that has nothing else to compare do not enter it.
    """

    def run(table: pa.Table) -> pa.Table:
        meta, bodies = [], []
        for m, b in zip(table.column("meta").to_pylist(), table.column("body").to_pylist(), strict=True):
            if m:
                meta.append(np.frombuffer(m, CONTEXT))
                bodies.append(zstandard.decompress(b))
        spans = joined(table.column("spans"), SPAN)
        if meta:
            meta, data = np.concatenate(meta), np.frombuffer(b"".join(bodies), np.uint8)
            end = np.cumsum(meta["n"], dtype=np.int64)
            meta["c"] = told_apart(meta["c"], end - meta["n"], end, data, spec)
            order = np.lexsort((meta["s"], meta["d"], meta["c"], meta["a"]))
            meta, end = meta[order], end[order]
            other = np.r_[True, (meta["c"][1:] != meta["c"][:-1]) | (meta["d"][1:] != meta["d"][:-1]) | (meta["s"][1:] != meta["s"][:-1])]
            meta, end = meta[other], end[other]  # rows alike in id and text are one document
            head = np.flatnonzero(np.r_[True, (meta["c"][1:] != meta["c"][:-1]) | (meta["a"][1:] != meta["a"][:-1])])
            size = np.diff(np.r_[head, len(meta)])
            if spec.earlier_only:
                direct, live = meta["d"] - meta["dup"] > np.repeat(meta["d"][head], size), np.ones(len(head), bool)
            else:
                many = (size > 1) | (meta["dup"][head] > 0)
                direct, live = np.repeat(many, size) & (meta["dup"] == 0), ~many
            reps = meta[head]
            if not spec.earlier_only:
                reps["dup"] = ~live
            group = np.cumsum(np.r_[0, reps["a"][1:] != reps["a"][:-1]])
            use = ((np.bincount(group) > 1) & (np.bincount(group, live) > 0))[group]
            reps, rep_end, first = reps[use], end[head][use], head[use]
            which, s, e = index(reps, gather(data, rep_end - reps["n"], rep_end), np.r_[0, np.cumsum(reps["n"], dtype=np.int64)])
            if spec.earlier_only:  # the same document may hold the context again
                alike = np.r_[head[1:], len(meta)][use] - first
                times = alike[which]
                at_ = np.repeat(first[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                s, e = np.repeat(s, times), np.repeat(e, times)
                s, e, at_ = s[~direct[at_]], e[~direct[at_]], at_[~direct[at_]]
            else:
                at_ = first[which]
            more = np.empty(len(at_) + int(direct.sum()), SPAN)
            hit = meta[np.r_[at_, np.flatnonzero(direct)]]
            more["d"], more["s"], more["e"] = hit["d"], hit["s"] + np.r_[s, np.zeros(int(direct.sum()), np.int64)], hit["s"] + np.r_[e, hit["u"][len(at_) :]]
            spans = np.concatenate([spans, more])
        spans = union(spans)
        return pa.table({"pid": spans["d"].copy(), "s": spans["s"].copy(), "e": spans["e"].copy()})

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """pid (the doc_id, null where it is) and text alone."""
    return docs.select(F.col("doc_id").cast("long").alias("pid"), F.col("text").cast("string").alias("text"))


def with_spans(docs: DataFrame, spec: Spec, index: Callable, per_partition: int = 4) -> DataFrame:
    """pid, ids (doc_id and low), text and spans (array of s, e in units, null if none) for each row."""
    n = per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = shared.identified(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    known = F.coalesce("pid", F.lit(0)).alias("pid")  # never null, and so the planner knows it and filters neither join
    texts = texts.select(known, F.struct("doc_id", "low").alias("ids"), "text")  # the same columns in both joins: one exchange
    use = texts.filter("ids.doc_id is not null") if spec.earlier_only else texts  # no id is smaller than a null one, nor larger
    found = use.select("pid", "text").mapInArrow(shared.tidied(scan(spec, n)), "bucket int, anchors binary, marks binary").groupBy("bucket").applyInArrow(repeated_anchors, "pid long, pos int")
    marks = found.groupBy("pid").agg(F.collect_list("pos").alias("marks"))
    ship = texts.join(marks, "pid").select("pid", "text", "marks", "ids").mapInArrow(shared.tidied(contexts(spec, n)), "bucket int, meta binary, body binary, spans binary")
    spans = ship.groupBy("bucket").applyInArrow(shards(index, spec), "pid long, s int, e int").groupBy("pid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return texts.join(spans, "pid", "left").select("pid", "ids", "text", "spans")


def covered(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal disjoint runs of what the spans cover below size."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], size)) for x in spans or ()):
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
