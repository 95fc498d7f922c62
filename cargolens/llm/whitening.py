"""Whitening of vectors by block subspace iteration, without a covariance matrix.

A Spark pass multiplies a thin block Q by the covariance: every task centres
its rows, forms C and then C'(CQ), and stripes of these sums are added by key.
The driver holds as many numbers as a vector has entries times the width of
the block, whatever the number of rows. Each pass ends in a Rayleigh-Ritz
step; its residuals say how far every component is from being an eigenvector,
and the passes go on until all wanted ones are certified. A block that
converges slowly is doubled, and one as wide as the vectors is exact at once.

Entries are whole numbers, so sums, centring (n*x - S) and squared deviations
are exact; OverflowError where 63 bits can't hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import shared

COMPONENTS, SPARE = 32, 32  # components, and columns of the block beside them
PATIENCE = 12  # passes after which the block is doubled
RESIDUAL = 1e-13  # of a certified component, over the largest eigenvalue
FLAT = 1e-12  # an eigenvalue under this part of the largest is no component
STRIPE = 32  # entries of a vector whose sums travel together
BATCH = 1 << 14  # rows multiplied at once
MOST = 2**62


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: rows, sums of entries, unit components as columns, their variances, the whole variance, passes over the rows."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows."""
        return centred(x, self.n, self.sums)[1] @ (self.components / np.sqrt(self.variances))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n*x - S as whole numbers, and x - S/n."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) > MOST:
        raise OverflowError("vectors too large for exact centring")
    c = n * x - sums
    return c, c / n


def whole(df: DataFrame, scale: int, shift: int, column: str = "embedding") -> DataFrame:
    """df with `x`, the entries as whole numbers floor(scale * entry) + shift, without the rows that have none.

    A row goes if its vector is null, empty, or holds null, NaN or infinite
    entries; and if its length isn't the most frequent one (the greatest of
    several), so that all rows have one length.
    """
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(fine).withColumn("x", F.transform(v, lambda c: F.floor(c * float(scale)) + shift))
    lengths = rows.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()  # a row
    return rows.filter(F.size("x") == (lengths.k if lengths else -1))


def arrays(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal lists as a matrix."""
    return np.asarray(column.flatten()).reshape(-1, width)


def added(x: DataFrame, width: int, columns: int, dtype: str, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of each(rows), a width x columns matrix: added up in a task, then by stripes across tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = arrays(batch.column(0), width)
            for k in range(0, len(rows), BATCH):
                now = each(rows[k : k + BATCH])
                total = now if total is None else total + now
        if total is not None:
            stripes = [total[k : k + STRIPE] for k in range(0, width, STRIPE)]
            yield pa.record_batch([pa.array(range(len(stripes)), pa.int32()), pa.array([s.tobytes() for s in stripes], pa.binary())], names=["stripe", "sums"])

    def both(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = np.array([np.frombuffer(b, dtype) for b in t.column("sums").to_pylist()])
        if dtype == "<i8" and np.abs(parts.astype(np.float64)).sum(0).max() > MOST:
            raise OverflowError("vectors too large for exact sums")
        return pa.table({"stripe": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([parts.sum(0).tobytes()], pa.binary())})

    got = x.select("x").mapInArrow(shared.tidied(part), "stripe int, sums binary").groupBy("stripe").applyInArrow(both, "stripe int, sums binary").collect()
    out = np.zeros((width, columns), dtype)
    for r in got:
        rows = np.frombuffer(bytes(r.sums), dtype).reshape(-1, columns)
        out[r.stripe * STRIPE : r.stripe * STRIPE + len(rows)] = rows
    return out


def fit(x: DataFrame, k: int = COMPONENTS, seed: int = 11) -> Whitening | None:
    """The first k components of the rows of `x`, or as many as have variance; None without rows or without any variance."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d

    def sums_of(rows: np.ndarray) -> np.ndarray:
        if int(np.abs(rows).max()) * len(rows) > MOST:
            raise OverflowError("vectors too large for exact sums")
        return np.c_[rows.sum(0), np.full(d, len(rows))]

    both = added(x, d, 2, "<i8", sums_of)
    sums, n = both[:, 0].copy(), int(both[0, 1])
    rng, passes = np.random.default_rng(seed), 0
    wanted, width = min(k, d), min(d, k + SPARE)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    while True:
        block = q

        def product(rows: np.ndarray, block: np.ndarray = block) -> np.ndarray:
            c = centred(rows, n, sums)[1]
            return np.c_[c.T @ (c @ block), np.einsum("ij,ij->j", c, c)]

        y = added(x, d, width + 1, "<f8", product) / n
        y, total, passes = y[:, :-1], float(y[:, -1].sum()), passes + 1
        if total == 0:
            return None
        small = block.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, vectors, images = values[order], block @ turn[:, order], y @ turn[:, order]
        residuals = np.linalg.norm(images - vectors * values, axis=0)[:wanted]
        if width == d or residuals.max() <= RESIDUAL * values[0]:
            break
        if passes % PATIENCE == 0:
            width = min(d, 2 * width)
            images = np.c_[images, rng.standard_normal((d, width - images.shape[1]))]
        q = np.linalg.qr(images)[0]
    fine = values[:wanted] > FLAT * values[0]
    vectors = vectors[:, :wanted][:, fine]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1.0, 1.0)  # one sign for all rows
    return Whitening(n, sums, vectors, values[:wanted][fine], total, passes)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity: one more pass."""
    k = model.components.shape[1]

    def product(rows: np.ndarray) -> np.ndarray:
        w = model.project(rows)
        out = np.zeros((rows.shape[1], k + 1))
        out[:k, :k], out[:k, k] = w.T @ w, w.sum(0)
        return out

    got = added(x, len(model.sums), k + 1, "<f8", product)[:k] / model.n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


def transform(x: DataFrame, model: Whitening, id_: str = "vec_id") -> DataFrame:
    """(id, deviation, whitened): for each row the squared n*x - S summed over entries, and its whitened entries."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                c, _ = centred(rows := arrays(part.column(1), d), model.n, model.sums)
                if len(c) and (c.astype(np.float64) ** 2).sum(1).max() > MOST:
                    raise OverflowError("vectors too large for exact deviations")
                w = model.project(rows)
                places = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.record_batch([part.column(0), pa.array((c * c).sum(1)), pa.ListArray.from_arrays(places, pa.array(w.ravel()))], names=[id_, "deviation", "whitened"])

    kind = x.schema[id_].dataType.simpleString()
    return x.select(id_, "x").mapInArrow(shared.tidied(run), f"`{id_}` {kind}, deviation long, whitened array<double>")


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op11: a row for each remaining vector and component.

    Rows without a usable vector are dropped (see `whole`); a null vec_id stays
    one, repeated rows count and are returned as often as they occur, other
    columns are not read. Without rows, or if all are equal, there is no
    component and no row comes back. Components without variance are left out.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    x = whole(table, 64, 1_000_000)
    model = fit(x)
    if model is None:
        return spark.createDataFrame([], ROWS)
    error = identity_error(x, model)
    rows = transform(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.element_at(F.lit(model.explained.tolist()), F.col("component") + 1)
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
