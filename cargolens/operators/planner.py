"""What the driver decides from a few numbers: the order of a matrix chain, and when a loop has settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain(sizes: list[int]) -> tuple[str, int]:
    """The cheapest bracketing of matrices of sizes[i] x sizes[i + 1], and its multiplications; of equally cheap ones the later split."""
    best: dict[tuple[int, int], tuple[int, str]] = {(i, i): (0, str(i)) for i in range(len(sizes) - 1)}
    for span in range(1, len(sizes) - 1):
        for i in range(len(sizes) - 1 - span):
            j = i + span
            options = [(best[i, k][0] + best[k + 1, j][0] + sizes[i] * sizes[k + 1] * sizes[j + 1], -k, f"({best[i, k][1]} {best[k + 1, j][1]})") for k in range(i, j)]
            cost, _, order = min(options)
            best[i, j] = (cost, order)
    cost, order = best[0, len(sizes) - 2]
    return order, cost


def converged(losses: DataFrame, step: str, loss: str, tolerance: float, times: int, least: int) -> DataFrame:
    """The first step, counted from 1, from `least` on at which the loss has moved by less than tolerance so many times running; null if none."""
    w = Window.orderBy(step)  # a row a step of a loop
    near = F.when(F.abs(F.col(loss) - F.lag(loss).over(w)) < tolerance, 1).otherwise(0)
    steps = losses.withColumn("ok", near).withColumn("step", F.row_number().over(w)).withColumn("n", F.sum("ok").over(w.rowsBetween(1 - times, 0)))
    return steps.filter((F.col("n") == times) & (F.col("step") >= least)).agg(F.min("step").cast("long").alias("step"))
