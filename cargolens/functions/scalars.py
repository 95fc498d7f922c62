"""Scalar expressions over records, labels and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """md5 of the values in column order, joined by underscores."""
    return F.md5(F.concat_ws("_", *columns))


def suffixed_id(column: str, suffix: str) -> Column:
    """The id with decimal digits put after it; wide enough for any long."""
    return F.concat(F.col(column).cast("string"), F.lit(suffix)).cast("decimal(38,0)")


def without_dots(column: str) -> Column:
    return F.replace(F.col(column), F.lit("."), F.lit(""))


def has_prefix(column: str, codes: list[str]) -> Column:
    """Whether the code's first two or four characters are among the codes, themselves cut to four."""
    cut = sorted({c[:4] for c in codes})
    return F.substring(column, 1, 2).isin(cut) | F.substring(column, 1, 4).isin(cut)


def threshold_sign(value: Column, bound: float, inclusive: bool) -> Column:
    """Sign of a value whose size reaches (or passes) the bound, 0 otherwise."""
    reached = F.abs(value) >= bound if inclusive else F.abs(value) > bound
    return F.when(reached, F.signum(value)).otherwise(0.0).cast("int")


def cross_sizes(d1: int, d2: int) -> tuple[int, int]:
    """The two bucket numbers of a hashed cross of domains of d1 and d2 values."""
    h1 = max(19, 6 * int(math.sqrt(d1 * d2 / 2) // 6) - 1)
    return h1, max(7, 6 * int((h1 // 2) // 6) - 1)


def hashed_cross(v1: Column, v2: Column, d1: int, d2: int) -> Column:
    """The bucket of a pair of codes."""
    h1, h2 = cross_sizes(d1, d2)
    x = v1 * d2 + v2
    return (x + x % h2) % h1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def interaction(vectors: Column, dim: int) -> Column:
    """Half of (squared sum minus sum of squares) of an array of vectors, summed over their places."""
    total = lambda k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[k])
    squares = lambda k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[k] * v[k])
    out = F.lit(0.0)
    for k in range(dim):
        out = out + (total(k) * total(k) - squares(k)) / 2
    return out


def code_vector(code: Column, dim: int) -> Column:
    """A fixed, reproducible vector for a code: for scores whose weights are given, not trained."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: ((code * 31 + k * 17) % 23 - 11) / 23.0)


def pattern_key(pattern: str) -> Column:
    """One key for a map of domains to entities, whatever the order of its entries."""
    entries = F.array_sort(F.transform(F.map_entries(pattern), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.md5(F.array_join(entries, ","))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
