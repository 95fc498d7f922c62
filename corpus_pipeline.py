"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last adds the mix. A driver writes each result as Parquet and reads it as
the next stage's docs; run() does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, jaccard_join, mixing, quality_crf, shared, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with a number `pid` of each document, also where an id is null or shared; rows alike in id and text have one number."""
    return shared.identified(docs.select(*COLUMNS))


def by_key(rows: DataFrame) -> DataFrame:
    """What the operators read of numbered rows: the number as doc_id, and the text."""
    return rows.select(F.col("pid").alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    Each row is judged by its own text, whatever its id. Null and empty texts
    are one empty line and judged as such. An empty table stays one.
    """
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = told_apart(docs)
    kept = quality_crf.scored(by_key(rows), model).filter(F.col("score") >= quality_crf.THRESHOLD).select("pid").distinct()
    return rows.join(kept, "pid", "left_semi").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id; rows without one come last.

    Each row is grouped by its own text, so rows that share an id, or have
    none, are one only if their texts are near copies; of those with the
    smallest id the first by a digest of the text stays, of equal rows any
    one. Null and empty texts have no copies and all stay.
    """
    rows = told_apart(docs)
    kept = jaccard_join.groups(by_key(rows)).filter("pid = component_id").select("pid").distinct()
    return rows.join(kept, "pid", "left_semi").dropDuplicates(["pid"]).select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere; a text that loses all of itself stays as an empty one.

    Rows that share an id, or have none, are different documents unless they
    have the same text. Null texts stay null; n_chars is counted anew for texts that lose
    something.
    """
    rows = told_apart(docs)
    cut = suffix_dedup.dedup(by_key(rows)).filter("n_removed > 0").select(F.col("doc_id").alias("pid"), "kept").dropDuplicates(["pid"])
    text = F.coalesce("kept", "text")
    return rows.join(cut, "pid", "left").withColumn("n_chars", F.when(F.col("kept").isNotNull(), F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; each row is judged by its own text, whatever its id.

    Null and empty texts, and all texts where the benchmark is empty, stay.
    """
    rows = told_apart(docs)
    found = decontaminate.hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))[0]
    return rows.join(found.select("pid").distinct(), "pid", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its block, slot and place in the mix; rows without a source are one source, repeated rows all stay."""
    return mixing.mixed(docs, {"src0": 2.0}).select(*COLUMNS, "block_no", "slot", "place")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("benchmark decontamination", benchmark_leaks), ("mixing sources", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
