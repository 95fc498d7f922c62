"""Quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad. Node weights act on the line's own features and on
those of its neighbours, and a 2 x 2 table links neighbouring labels. Training
takes every line of a labelled document to have the document's label. A
document's quality is the mean of the forward-backward marginals of "good",
weighted by line length, put on a probability scale by two parameters that are
fitted to the same training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm import shared
from cargolens.llm.passages import keyed

TRAIN_DOCS, STEPS, THRESHOLD = 3000, 150, 0.3
OWN = 14


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(mask, dtype=np.int64)]
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an equal key stood in the same row before."""
    order = np.lexsort((np.arange(len(key)), key, row))
    again = np.zeros(len(key), bool)
    if len(key):
        k, r = key[order], row[order]
        again[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return again


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of each line, and each row's first line; an empty text is one empty line."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    breaks = breaks[~np.isin(breaks, offsets[1:])]  # a break at the end opens no line
    starts = np.concatenate([offsets[:-1], breaks])
    owner = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(rows + 1))
    bounds = np.r_[starts, offsets[-1]]
    size = np.diff(bounds).astype(np.float64)
    safe = np.maximum(size, 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high, space = (data >= 48) & (data <= 57), data >= 128, data == 32
    mark = ~(upper | lower | digit | high | (data <= 32))
    common = (data == 44) | (data == 46)
    w_start, w_end, w_first = at.words(data, bounds)
    words = np.diff(w_first).astype(np.float64)
    hashes = at.rough_hashes(data, w_start, w_end)
    w_line = np.repeat(np.arange(len(starts)), np.diff(w_first))
    w_sums = at.prefix_sums(hashes)
    i = np.arange(max(len(hashes) - 2, 0))
    i = i[w_line[i] == w_line[i + 2]] if len(i) else i
    three = at.slice_hash(w_sums, i, i + 3)
    trigrams = np.bincount(w_line[i], minlength=len(starts)) if len(i) else np.zeros(len(starts))
    again_doc = np.bincount(w_line[i], repeats(three, owner[w_line[i]]), minlength=len(starts)) if len(i) else np.zeros(len(starts))
    again_word = np.bincount(w_line, repeats(hashes, w_line), minlength=len(starts)) if len(hashes) else np.zeros(len(starts))
    sums = at.prefix_sums(data)
    again_line = repeats(at.slice_hash(sums, bounds[:-1], bounds[1:]), owner)
    last = np.where(size > 0, data[np.maximum(bounds[1:] - 1, 0)] if len(data) else 0, 0)
    ends_mark = np.bincount(w_line, mark[w_end - 1] & ~common[w_end - 1], minlength=len(starts)) if len(hashes) else np.zeros(len(starts))
    own = np.stack(
        [
            np.log1p(size),
            count_in(upper, bounds) / safe,
            count_in(mark & ~common, bounds) / safe,
            count_in(digit, bounds) / safe,
            count_in(high, bounds) / safe,
            count_in(common, bounds) / safe,
            count_in(space, bounds) / safe,
            np.minimum(count_in(upper | lower | high, bounds) / np.maximum(words, 1), 30) / 10,
            again_word / np.maximum(words, 1),
            again_doc / np.maximum(trigrams, 1),
            again_line.astype(np.float64),
            ends_mark / np.maximum(words, 1),
            (words < 4).astype(np.float64),
            ((last == 46) | (last == 10)).astype(np.float64),
        ],
        axis=1,
    )
    index = np.arange(len(starts))
    before = own[np.where(np.isin(index, first[:-1]), index, index - 1)]
    after = own[np.where(np.isin(index + 1, first[1:]), index, np.minimum(index + 1, len(index) - 1))]
    return np.concatenate([own, own**2, (before + after) / 2, np.ones((len(own), 1))], axis=1), safe, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def marginals(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(labels of the line and its successor) for the lines that have one."""
    score = np.clip((x - model.mean) / model.scale @ model.node, -30, 30)
    push = np.exp(np.stack([-score / 2, score / 2], 1))
    step = np.exp(model.edge)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(longest), side="left")
    fwd, bwd = np.empty((len(x), 2)), np.ones((len(x), 2))
    for t in range(longest):
        at_ = first[:-1][order[: active[t]]] + t
        a = push[at_] if t == 0 else (fwd[at_ - 1] @ step) * push[at_]
        fwd[at_] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at_ = first[:-1][order[: active[t + 1]]] + t
        b = (bwd[at_ + 1] * push[at_ + 1]) @ step.T
        bwd[at_] = b / b.sum(1, keepdims=True)
    p = fwd * bwd
    good = p[:, 1] / p.sum(1)
    inner = np.ones(len(x), bool)
    inner[first[1:][size > 0] - 1] = False
    i = np.flatnonzero(inner)
    pair = fwd[i][:, :, None] * step[None] * (bwd[i + 1] * push[i + 1])[:, None, :]
    return good, pair / pair.sum((1, 2), keepdims=True)


def document_mean(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1]) if len(first) > 1 else np.zeros(0)


def squeezed(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, ridge: float = 1e-3) -> Model:
    """Weights of greatest conditional likelihood, by Adam over all training documents at once."""
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    parts = [line_features(d, o) for *_, d, o in at.chunks(np.frombuffer(b"".join(texts), np.uint8), offsets)]  # a chunk at a time keeps the driver small
    x, length = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    model = Model(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    z = (x - mean) / scale
    size = np.diff(first)
    y_doc = np.array(labels, np.float64)
    y = np.repeat(y_doc, size)
    weight = np.repeat(1 / np.maximum(size, 1), size)  # each document counts once
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = weight[inner & (y == 0)].sum(), weight[inner & (y == 1)].sum()
    theta = np.zeros(len(model.node) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, pair = marginals(model, x, first)
        grad = np.r_[z.T @ (weight * (y - good)), (seen - (weight[inner][:, None, None] * pair).sum(0)).ravel()] / len(texts) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model.node, model.edge = theta[:-4], theta[-4:].reshape(2, 2)
    q = squeezed(document_mean(marginals(model, x, first)[0], length, first))
    for _ in range(60):  # Newton steps of a logistic regression on one variable
        p = 1 / (1 + np.exp(-(model.slope * q + model.shift)))
        g = np.array([((y_doc - p) * q).sum() - 1e-2 * model.slope, (y_doc - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * q * q).sum() + 1e-2, (w * q).sum()], [(w * q).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        model.slope, model.shift = model.slope + move[0], model.shift + move[1]
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of at most `most` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("pid"), F.col("quality").cast("int").alias("label")).filter("pid is not null and label is not null")
    known = known.filter(~held_out(F.col("pid"))).groupBy("pid").agg(F.min("label").alias("label")).orderBy(F.xxhash64("pid"), "pid").limit(most)
    rows = keyed(docs).join(F.broadcast(known), "pid").select("pid", "text", "label").collect()
    rows.sort(key=lambda r: (r.pid, r.text or ""))
    if not rows:
        width = 3 * OWN + 1
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)
    return fit([(r.text or "").encode() for r in rows], [r.label for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' pid, text and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for *_, data, offsets in at.chunks(*at.buffers(batch.column(1))):
                x, length, first = line_features(data, offsets)
                q = squeezed(document_mean(marginals(model, x, first)[0], length, first))
                out.append(1 / (1 + np.exp(-(model.slope * q + model.shift))))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], names=["pid", "score"])

    return keyed(docs).mapInArrow(shared.tidied(run), "pid long, score double")


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pid, score and keep of every document.

    Null and empty texts are one empty line. A score depends on the text alone,
    so repeated rows score alike. Without any usable label every score is 0.5.
    Other columns of either table are not read.
    """
    return scored(docs, train(docs, labels)).withColumn("keep", F.col("score") >= threshold)


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op3: one row a document with its score."""
    out = rejected(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    id_ = F.col("pid")
    return out.select(id_.alias("doc_id"), F.coalesce(held_out(id_), F.lit(False)).alias("held_out"), "score", F.col("keep").cast("int").alias("predicted"))
