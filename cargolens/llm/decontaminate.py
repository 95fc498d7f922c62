"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Every window of an item (ten consecutive words, or a shorter item whole) is a
set of five-word shingles with their offsets. A document contains the window
only if it contains all of them, so one necessary shingle is the window's
prefix: the rarest, by how many documents have its rarest word, which bounds
how many have the shingle. Prefixes are chosen first, and only they meet the
documents' shingles, by a hash; position and length bounds drop windows that
don't fit; and what is left is compared word by word with a slice of the
document. An item's windows have its own size, so short items need no other
way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1 << 20

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, s FROM (SELECT item_id, l, unnest(list_transform(generate_series(1, len(w) - l + 1), lambda p: array_to_string(w[p:p + l - 1], ' '))) s FROM bl)),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, unnest(list_transform(generate_series(1, len(w) - l + 1), lambda p: {{'p': p, 's': array_to_string(w[p:p + l - 1], ' ')}})) x FROM d, lens WHERE len(w) >= l),
hit AS (SELECT doc_id, dw.l, x.p p, item_id FROM dw JOIN win ON win.l = dw.l AND win.s = x.s),
cov AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) q FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, sha256(string_agg(i, ',' ORDER BY i)) items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def words(text):
    """Words of a text column; only A-Z are lowered, and null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def grams(array, size: int):
    """A hash of the `size` words from each place on; none in shorter texts."""
    each = F.transform(F.sequence(F.lit(0), F.size(array) - size), lambda i: F.xxhash64(F.lit(size), *(F.get(array, i + j) for j in range(size))))
    return F.when(F.size(array) >= size, each).otherwise(F.array().cast("array<long>"))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows: win, len, grams with offsets; item_ids that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.lit(size), F.size("w")))
    return items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i")).select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("w")).withColumn("win", F.array_join("w", " "))


def small(df: DataFrame, bytes_: int) -> DataFrame:
    """df, broadcast only if its proven size allows it; a join by shuffle otherwise."""
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def prefixes(win: DataFrame, tokens: DataFrame, n_bytes: int) -> DataFrame:
    """(win, len, k, off, g): the necessary shingle of each window, rarest by the documents that have its rarest word."""
    distinct = win.select("win", "len", "w").distinct().withColumn("k", F.least(F.lit(SHINGLE), F.col("len")))
    known = small(distinct.select(F.explode("w").alias("word")).distinct(), n_bytes)
    counts = shared.cut(tokens.select(F.explode(F.array_distinct("w")).alias("word")).join(known, "word").groupBy("word").agg(F.count("*").alias("df")))
    g = F.lit(None).cast("array<long>")
    for k in range(1, SHINGLE + 1):
        g = F.when(F.col("k") == k, grams(F.col("w"), k)).otherwise(g)
    shingles = distinct.select("win", "len", "k", "w", F.posexplode(g).alias("off", "g"))
    bound = shingles.select("win", "off", F.explode(F.slice("w", F.col("off") + 1, F.col("k"))).alias("word")).join(counts, "word", "left").groupBy("win", "off").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))
    best = shingles.join(bound, ["win", "off"]).groupBy("win", "len", "k").agg(F.min(F.struct("df", "g", "off")).alias("p"))
    return best.filter("p.df > 0").select("win", "len", "k", "p.off", "p.g")  # a word that no document has: the window occurs nowhere


def hits(rows: DataFrame, benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(pid, start, len, win) of every occurrence of a window in rows of (pid, text), and (win, item)."""
    win = shared.cut(windows(benchmark, size))
    n_bytes = 10 * int(win.agg(F.coalesce(F.sum(F.octet_length("win") + 40), F.lit(0))).first()[0])
    lengths = sorted(r[0] for r in win.select(F.least(F.lit(SHINGLE), F.col("len")).alias("k")).distinct().collect())  # SHINGLE values at most
    tokens = rows.select("pid", words(F.col("text").cast("string")).alias("w"))
    known = shared.cut(prefixes(win, tokens, n_bytes))
    if not lengths:
        return rows.sparkSession.createDataFrame([], "pid long, start int, len int, win string"), win.select("win", "item").distinct()
    met = tokens.select("pid", F.size("w").alias("n"), F.posexplode(F.concat(*(grams(F.col("w"), k) for k in lengths))).alias("pos", "g")).join(small(known, n_bytes), "g")
    before = F.lit(0)  # hashes of each length stand one after another
    for k, longer in zip(lengths, lengths[1:], strict=False):
        before = before + F.when(F.col("k") >= longer, F.greatest(F.col("n") - (k - 1), F.lit(0))).otherwise(0)
    met = met.withColumn("start", F.col("pos") - before - F.col("off"))
    met = shared.cut(met.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))).groupBy("pid").agg(F.collect_set(F.struct("start", "len", "win")).alias("met")))
    ids = met.select("pid")
    own = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "pid", "left_semi")  # few texts move
    own = own.select("pid", words(F.col("text").cast("string")).alias("w")).join(met, "pid")
    exact = own.select("pid", F.explode(F.filter("met", lambda x: F.array_join(F.slice(F.col("w"), x["start"] + 1, x["len"]), " ") == x["win"])).alias("x"))
    return exact.select("pid", "x.*").distinct(), win.select("win", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document its words, the words inside benchmark windows, and the items found.

    Null texts have no words; an item of fewer words than the window is one
    window, an item of none is never found. A null item_id hits words but is
    no item of the list. Rows that share a doc_id, or have none, are different
    documents if their texts differ; rows alike in id and text have the same
    result, on a row each. Other columns are not read.
    """
    rows = shared.identified(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found, items = hits(rows, benchmark, size)
    found = shared.cut(found)
    n_hit = found.select("pid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("q")).distinct().groupBy("pid").agg(F.count("*").alias("n_hit"))
    listed = found.select("pid", "win").distinct().join(items, "win").filter("item is not null").select("pid", "item").distinct().groupBy("pid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    base = rows.select("pid", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = base.join(n_hit.join(listed, "pid", "left"), "pid", "left").select("pid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select("pid", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op9: one row a document with its hits."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
