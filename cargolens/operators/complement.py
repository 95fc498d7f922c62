"""Draws from what was never seen: the complement of a set of ids is drawn from by rank, and never listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.plans.durable import cut


def running(df: DataFrame, order: list[str], sums: dict[str, Column], then: list[Column] | None = None) -> DataFrame:
    """df with running sums, each row's own value included, over all rows in that order (rows alike in it by `then`).

    Rows are sorted by ranges and the sums of the ranges before are added, so a
    key with very many rows is spread over tasks.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order, *(then or [])).withColumn("_p", F.spark_partition_id())
    placed = cut(placed.withColumn("_i", F.monotonically_increasing_id()))  # range bounds are drawn once
    each = placed.groupBy("_p").agg(*(F.sum(f"_v_{n}").alias(n) for n in sums))  # a row a range
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("_p", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    here = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({n: F.sum(f"_v_{n}").over(here) for n in sums}).join(F.broadcast(before), "_p")
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_p", "_i", *(f"_{x}_{n}" for n in sums for x in "vb"))


SPAN = 256  # seen ids in one row of a table of gaps
WIDE = 1 << 16  # ids whose seen ones are collected together


def gap_slices(seen: DataFrame, key: list[str]) -> DataFrame:
    """(key, _gaps, _before, _lo, _hi, _m, _n, _i, _top): the key's seen ids less their ranks, up to SPAN of them a row, in order.

    With the number of seen ids before the row, the row's first gap and the
    next row's, the key's seen ids and rows, the row's place and the key's
    last first gap. No group holds more than WIDE ids or a row a SPAN.
    """
    by = Window.partitionBy(*key)
    own = seen.groupBy(*key, F.floor(F.col("id") / WIDE).alias("_w")).agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    own = own.withColumn("_r", F.coalesce(F.sum(F.size("_ids")).over(by.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / SPAN).cast("int")))).withColumn("_before", F.col("_r") + F.col("_j") * SPAN)
    own = own.withColumn("_gaps", F.transform(F.slice("_ids", F.col("_j") * SPAN + 1, F.lit(SPAN)), lambda x, i: x - i - F.col("_before")))
    own = own.select(*key, "_gaps", "_before", F.col("_gaps")[0].alias("_lo"))
    order = by.orderBy("_before")
    own = own.withColumns({"_hi": F.lead("_lo").over(order), "_i": F.row_number().over(order)})
    return own.withColumns({"_m": F.sum(F.size("_gaps")).over(by), "_n": F.count("*").over(by), "_top": F.max("_lo").over(by)})


def up_to(gaps: str, k: str) -> Column:
    return F.size(F.filter(gaps, lambda x: x <= F.col(k)))


def free_ids(draws: DataFrame, seen: DataFrame, key: list[str], size: Column, u: Column, name: str, slices: DataFrame | None = None) -> DataFrame:
    """draws with an id below `size` that `seen` doesn't have under the row's key, even among those by the whole number u.

    The u-th of n free ids, modulo n, is found without listing them: of the
    key's seen ids s0 < s1 < ..., s(i) - i free ones lie below s(i), so the k-th
    free id is k and as many seen ids as have s(i) - i <= k. A key of up to SPAN
    seen ids is one row; others are joined by equal slots of their gaps too, so
    a draw meets a row or two. A draw whose key leaves no id free goes; there is
    no limit of attempts, and no other is lost. Who draws several times gives the
    `gap_slices` of seen and key.
    """
    slices = gap_slices(seen, key) if slices is None else slices
    slot = lambda x: F.least(F.floor(x.cast("double") * F.col("_n") / (F.col("_top") + 1)), F.col("_n") - 1)
    first = slices.filter("_i = 1").select(*key, "_m", "_n", "_top", F.when(F.col("_n") == 1, F.col("_gaps")).alias("_one"))
    points = draws.withColumn("_size", size).withColumn("_u", u).join(first, key, "left").withColumn("_left", F.col("_size") - F.coalesce("_m", F.lit(0))).filter("_left > 0")
    points = points.withColumn("_k", F.pmod(F.col("_u"), F.greatest("_left", F.lit(1)))).drop("_size", "_u", "_left", "_m")
    points = points.withColumn("_slot", F.when(F.col("_n") > 1, slot(F.col("_k")))).withColumn("_few", F.when(F.col("_n") == 1, up_to("_one", "_k"))).drop("_one", "_n", "_top")
    last = F.when(F.col("_hi").isNull(), F.col("_n") - 1).otherwise(slot(F.col("_hi") - 1))
    table = slices.filter("_n > 1 AND (_hi IS NULL OR _hi > _lo)").select(*(F.col(c).alias(f"_at_{c}") for c in key), "_gaps", "_before", "_lo", "_hi", F.explode(F.sequence(slot(F.col("_lo")), last)).alias("_at"))
    same = [F.col(c) == F.col(f"_at_{c}") for c in key]
    meets = reduce(lambda a, b: a & b, same) & (F.col("_slot") == F.col("_at")) & (F.col("_k") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_k") < F.col("_hi")))
    found = points.join(table, meets, "left").withColumn(name, F.col("_k") + F.coalesce("_few", F.col("_before") + up_to("_gaps", "_k"), F.lit(0)))
    return found.select(*draws.columns, name)


def free_ids_sql(draws: str, seen: str, size: str, u: str, name: str = "free") -> list[str]:
    """Named parts of SQL: `draws` with the id that `free_ids` finds, for (key, ...) and seen (key, id)."""
    return [
        f"{name}_own AS (SELECT key, id - (row_number() OVER (PARTITION BY key ORDER BY id) - 1) gap, count(*) OVER (PARTITION BY key) m FROM (SELECT DISTINCT key, id FROM {seen}))",
        f"{name}_left AS (SELECT d.*, {size} - coalesce(o.m, 0) n_left FROM {draws} d LEFT JOIN (SELECT DISTINCT key, m FROM {name}_own) o USING (key))",
        f"{name}_k AS (SELECT *, {u} % n_left k FROM {name}_left WHERE n_left > 0)",
        f"{name}_gaps AS (SELECT key, list_sort(list(gap)) gaps FROM {name}_own GROUP BY 1)",
        f"{name} AS (SELECT x.*, k + coalesce(len(list_filter(g.gaps, lambda y: y <= k)), 0) id FROM {name}_k x LEFT JOIN {name}_gaps g USING (key))",
    ]
