"""What several operators need: the shared folder, bounded tallies, components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.operators.relational import ranked

BLOCKS = 64
LEAST_TASKS, EDGES_A_TASK = 8, 200_000  # how a round's edges are dealt to files: never more tasks than shuffle partitions
BYTES_A_TASK = 4 << 20  # of stored input; what a task that writes a table has at least


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def tasks(docs: DataFrame) -> int:
    """How many tasks write a table derived from docs: it grows with the stored input, and files stay few on small ones."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_TASKS, min(size // BYTES_A_TASK, 1 << 30))


def fewer(df: DataFrame, most: int | None) -> DataFrame:
    """df in at most so many partitions; partitions are joined, never split or shuffled."""
    return df if most is None else df.coalesce(most)


def table(df: DataFrame, most: int | None = None) -> DataFrame:
    """df written to the shared folder, in at most so many files, and read back: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    fewer(df, most).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """docs with `pid`, a number of each document, and `low`, the least pid of its doc_id.

    Both are the doc_id where no row shares it and none is null. Else a
    document is what rows alike in id and text have in common: documents are
    numbered in the order of doc_id, nulls last, and a digest of the text, and
    the numbers are written. A document without an id shares it with no other.
    """
    docs = docs.drop("pid", "low").withColumn("doc_id", F.col("doc_id").cast("long"))
    if docs.groupBy("doc_id").count().filter("doc_id is null or `count` > 1").isEmpty():
        return docs.withColumns({"pid": F.col("doc_id"), "low": F.col("doc_id")})
    rows = docs.withColumn("_key", F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit("-")))
    known = ranked(rows.select("doc_id", "_key").distinct(), [F.col("doc_id").asc_nulls_last(), F.col("_key")], "pid")
    known = table(known, tasks(docs))
    low = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("pid").alias("low"))
    known = known.join(low, "doc_id", "left").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "pid", F.coalesce("low", "pid").alias("low"))
    return rows.join(known, (F.col("_key") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*docs.columns, "pid", "low")


def discard(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """df after a checkpoint in the shared folder, in at most so many files."""
    shared_dir(df.sparkSession)
    return fewer(df, most).checkpoint()


def release(spark: SparkSession) -> None:
    """Lets the cleaner delete shuffle files of plans that a cut has ended; it waits for the driver's collector."""
    spark.sparkContext._jvm.System.gc()


def tidied(run: Callable) -> Callable:
    """run, which maps Arrow batches, giving what its worker has freed back to the system at its end: workers are used again and wait beside each other."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def tally(df: DataFrame, slots: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int, bits: bool = False) -> np.ndarray:
    """How often slots(batch) names each of `size` slots (at most 2**32 - 1), over all of df; or, as packed bits, whether.

    size is fixed, whatever the input; the driver holds that many counters or bits.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8 if bits else np.uint32)
        for batch in batches:
            for x in slots(batch):
                if bits:
                    total[x] = 1
                else:
                    at, n = np.unique(x, return_counts=True)
                    total[at] += n.astype(np.uint32)
        parts = [(i, zstandard.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(total, BLOCKS)) if p.any()]
        yield pa.record_batch([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size // BLOCKS, np.uint64)
        for b in t.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(b), np.uint8 if bits else np.uint32)
        total = np.packbits(total > 0, bitorder="little") if bits else np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": [t.column("block")[0].as_py()], "counts": [zstandard.compress(total.tobytes(), 1)]}, schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    out = np.zeros(size // 8 if bits else size, np.uint8 if bits else np.uint32)
    each = len(out) // BLOCKS
    for r in df.mapInArrow(tidied(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r.block * each : (r.block + 1) * each] = np.frombuffer(zstandard.decompress(bytes(r.counts)), out.dtype)
    return out


def components(edges: DataFrame, most: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node it reaches.

    Alternating large-star and small-star steps; each is joins and minima over
    edges, so a hub is split like any skewed key. Stops when nothing moves.
    """
    def state_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    cur = cut(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), most)
    seen = state_of(cur)
    for _ in range(most_rounds):
        both = cur.unionByName(cur.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").selectExpr("b a", "m b").unionByName(low.filter("m < a").selectExpr("a", "m b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").selectExpr("b a", "m b").unionByName(low.selectExpr("a", "m b")).distinct()
        cur = cut(small.coalesce(max(LEAST_TASKS, seen[0] // EDGES_A_TASK)))
        state = state_of(cur)
        if state == seen:
            return cur.selectExpr("a node", "b root").unionByName(cur.selectExpr("b node", "b root").distinct())
        seen = state
        release(edges.sparkSession)
    raise RuntimeError("components did not settle")
