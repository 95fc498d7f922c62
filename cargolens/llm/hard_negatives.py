"""Hard negatives by a blocked matrix product in two dimensions.

Rows are ranked by (label, id) and cut into blocks of a fixed size, anchors
likewise, and vectors into chunks of dimensions. A tile is the product of an
anchor block and a row block; the task of one chunk of a tile makes partial
scores, whole numbers of 64 bits, and the partial tiles of all chunks meet by
tile and are added. What is left of a tile is the few best of its rows for
each anchor, and these lists meet by anchor.

That runs twice. The first time only tiles whose blocks share a label are
made, and give each anchor's positives; the second time all tiles are made,
and give the best of each window that an anchor and a positive span. A hot
label is as many blocks as its rows need; no group is larger than a tile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import shared
from cargolens.operators.relational import ranked

TILE = ["anchors", "block"]


@dataclass(frozen=True)
class Mining:
    """Scale of entries, anchors, positives and negatives; per cent of the positive's score that a negative has at least; sizes of a tile."""

    scale: int = 256
    every: int = 100
    positives: int = 5
    negatives: int = 5
    least: int = 80
    anchors_a_tile: int = 256
    rows_a_tile: int = 4096
    dimensions: int = 32


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: as doubles where every partial sum is below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound >= 1 << 62:
        raise OverflowError("scores too large for 64 bits")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 1 << 53 else a @ b.T


def packed(tile: np.ndarray) -> bytes:
    """Scores by bytes of equal weight, compressed."""
    return zstandard.compress(np.ascontiguousarray(tile.ravel().view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.int64).reshape(shape)


def usable(df: DataFrame, m: Mining) -> DataFrame:
    """(vec_id, label, x): rows that take part, with whole-number entries, one for each vec_id.

    A row goes if its vec_id, label or vector is null or its vector is empty or
    holds null, NaN or infinite entries. Of rows that share a vec_id, alike or
    not, the least by label and entries stays. Vectors of other lengths than
    the longest are filled up with zeros.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and size(embedding) > 0").filter(fine)
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform(v, lambda c: F.floor(c * float(m.scale))).alias("x"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the number of their block, by rank of (label, vec_id)."""
    return ranked(rows, [F.col("label"), F.col("vec_id")], "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def chunked(rows: DataFrame, width: int, m: Mining) -> DataFrame:
    """A row for each chunk of dimensions, x being its part."""
    n = -(-width // m.dimensions)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(n * m.dimensions) - F.size("x")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(filled, c * m.dimensions + 1, m.dimensions))
    return rows.select("*", F.posexplode(parts).alias("chunk", "part")).drop("x")


TILE_SQL = "anchors long, block long, chunk int, anchor_id array<long>, anchor_label array<long>, window array<array<long>>, row_id array<long>, row_label array<long>, scores binary"


def partial(left: pa.Table, right: pa.Table) -> pa.Table:
    """The partial scores of one chunk of one tile; anchors and rows in order of id."""
    left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
    matrix = lambda t: np.array(t.column("part").combine_chunks().flatten()).reshape(t.num_rows, -1)
    names = [f.split()[0] for f in TILE_SQL.split(", ")]
    if not left.num_rows or not right.num_rows:
        return tile_table([])
    values = [left.column("anchors")[0].as_py(), right.column("block")[0].as_py(), left.column("chunk")[0].as_py(), *(left.column(c).to_pylist() for c in ("vec_id", "label", "window")), *(right.column(c).to_pylist() for c in ("vec_id", "label")), packed(product(matrix(left), matrix(right)))]
    return tile_table([dict(zip(names, values, strict=True))])


def tile_table(rows: list[dict]) -> pa.Table:
    long, longs = pa.int64(), pa.list_(pa.int64())
    kinds = [long, long, pa.int32(), longs, longs, pa.list_(longs), longs, longs, pa.binary()]
    return pa.Table.from_pylist(rows, schema=pa.schema([(f.split()[0], k) for f, k in zip(TILE_SQL.split(", "), kinds, strict=True)]))


BEST = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
BEST_SQL = "anchor_id long, slot int, ids array<long>, scores array<long>"


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The k first by falling score, then id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[-k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order].tolist(), scores[order].tolist()


def reduced(positives: bool, m: Mining):
    """Of one tile the best rows of each anchor (slot 0), or of each of its windows, from its partial tiles."""

    def run(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1).to_pylist()[0]
        ids, labels = np.array(one["row_id"], np.int64), np.array(one["row_label"], np.int64)
        scores = np.zeros((len(one["anchor_id"]), len(ids)), np.int64)
        for p in t.column("scores"):
            scores += unpacked(p.as_py(), scores.shape)
        out = []
        for anchor, label, window, s in zip(one["anchor_id"], one["anchor_label"], one["window"], scores, strict=True):
            if positives:
                ok = (labels == label) & (ids != anchor)
                out.append((anchor, 0, *best(ids[ok], s[ok], m.positives)))
                continue
            other = labels != label
            for slot, p in enumerate(window):
                ok = other & (s <= p) & (100 * s >= m.least * p)
                out.append((anchor, slot, *best(ids[ok], s[ok], m.negatives)))
        out = [r for r in out if r[2]]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(BEST)], schema=BEST)

    return run


def merged_best(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, scores = (np.asarray(t.column(c).combine_chunks().flatten()) for c in ("ids", "scores"))
        return pa.table([pa.array([x], f.type) for x, f in zip([t.column("anchor_id")[0].as_py(), t.column("slot")[0].as_py(), *best(ids, scores, k)], BEST, strict=True)], schema=BEST)

    return run


def tiled(anchors: DataFrame, rows: DataFrame, tiles: DataFrame, width: int, positives: bool, m: Mining) -> DataFrame:
    """(anchor_id, slot, ids, scores) over the given tiles."""
    key = [*TILE, "chunk"]
    anew = lambda df: df.toDF(*df.columns)  # noqa: E731  the two sides share tables, not columns
    left = anew(chunked(anchors.join(tiles, "anchors"), width, m))
    right = anew(chunked(rows.join(tiles, "block"), width, m))
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial, TILE_SQL)
    lists = parts.groupBy(*TILE).applyInArrow(reduced(positives, m), BEST_SQL)
    return lists.groupBy("anchor_id", "slot").applyInArrow(merged_best(m.positives if positives else m.negatives), BEST_SQL)


def mine(df: DataFrame, m: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see `usable` for what takes part.

    An anchor without another row of its label has no rows, nor has a positive
    whose window is empty, as every window of a negative score is. Ties go to
    the smaller id. An empty table gives an empty result.
    """
    rows = shared.table(blocks(usable(df, m), m.rows_a_tile, "block"))
    anchors = shared.table(blocks(rows.filter(F.col("vec_id") % m.every == 0).drop("block"), m.anchors_a_tile, "anchors"))
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1)).alias("w")).first().w
    share = anchors.select("anchors", "label").distinct().join(rows.select("block", "label").distinct(), "label").select(*TILE).distinct()
    none = F.array().cast("array<long>")
    found = shared.table(tiled(anchors.withColumn("window", none), rows, share, width, True, m))
    held = anchors.join(found.select(F.col("anchor_id").alias("vec_id"), F.col("scores").alias("window")), "vec_id")
    last = rows.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("n")).first().n
    every = held.select("anchors").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0)).cast("long")) if last >= 0 else none))
    negatives = tiled(held, rows, every, width, False, m).select("anchor_id", "slot", F.posexplode(F.arrays_zip(F.col("ids").alias("i"), F.col("scores").alias("s"))).alias("rank", "n"))
    own = found.select("anchor_id", F.posexplode(F.arrays_zip(F.col("ids").alias("i"), F.col("scores").alias("s"))).alias("slot", "p"))
    both = own.join(negatives, ["anchor_id", "slot"])
    return both.select("anchor_id", F.col("p.i").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("n.i").alias("negative_id"), F.col("p.s").alias("positive_score"), F.col("n.s").alias("negative_score"))


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op13: hard negatives of every hundredth vector against all rows."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) x
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id a, b.vec_id b, a.label = b.label same, list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
 SELECT p.a anchor_id, p.b positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS "rank", n.b negative_id, p.s positive_score, n.s negative_score
 FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s QUALIFY "rank" <= 5"""
