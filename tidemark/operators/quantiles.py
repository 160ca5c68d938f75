"""Exact ranks by radix selection: no group's values are ever sorted in one task.

Values are whole numbers. They are counted by group and value first, and the counts are kept in the shared folder. Then
each wanted rank is narrowed: the first digit of ``value - least`` to base 2**DIGIT_BITS tells in which bucket the rank
lies, the next digit looks only into that bucket, and so on. A task sorts at most 2**DIGIT_BITS buckets of a group,
however many distinct values the group has. Once no more distinct values than that are left in all, each is a bucket.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import FEW, cut

DIGIT_BITS = 16


def _checked(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small


def ranks(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """(by..., _n, name...): for each group the number of its values and those at the 0-based places ``wanted``.

    A place is an expression of ``_n``, from 0 to ``_n - 1``. Null values don't count; a null in ``by`` is a group.
    ``value`` lies between -2**62 and 2**62. A group without values has no row; without ``by`` there is one row, then of nulls.
    """
    groups = [f"_w{i}" for i in range(len(by))]
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(w)) for c, w in zip(by, groups, strict=True)), F.lit(True))
    left = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_k"))
    left = cut(left)
    n_left, least, most = left.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), p.cast("long").alias("_place")) for n, p in wanted.items())))
    aims = left.groupBy(*by).agg(F.sum("_k").alias("_n")).where("_n is not null")
    aims = aims.select(*(F.col(c).alias(w) for c, w in zip(by, groups, strict=True)), "_n", places.alias("_x"))
    aims = aims.select(*groups, "_n", "_x.*", F.lit(0).cast("long").alias("_prefix"))
    digits = F.col("_v") - F.lit(least or 0)
    left, shift = left.withColumn("_at", F.lit(0).cast("long")), (most - least).bit_length() if n_left else 0
    while shift:
        shift = max(0, shift - DIGIT_BITS) if n_left > 1 << DIGIT_BITS else 0
        left = left.withColumn("_bucket", F.shiftright(digits, shift))
        sums = left.groupBy(*by, "_at", "_bucket").agg(F.sum("_k").alias("_k"))
        before = Window.partitionBy(*by, "_at").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
        inside = same & (F.col("_at") == F.col("_prefix")) & (F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_k"))
        aims = sums.join(_checked(aims), inside).select(*groups, "_n", "_name", (F.col("_place") - F.col("_before")).alias("_place"), F.col("_bucket").alias("_prefix"))
        aims = cut(aims)
        if shift:  # from here on only the buckets in which a rank lies
            edges = _checked(aims.select(*groups, "_prefix").distinct())
            left = left.join(edges, same & (F.col("_bucket") == F.col("_prefix")), "left_semi")
            left = left.select(*by, "_v", "_k", F.col("_bucket").alias("_at"))
            n_left = left.count()
    at = lambda n: F.max(F.when(F.col("_name") == n, F.col("_prefix") + F.lit(least or 0))).alias(n)
    found = aims.groupBy(*groups).agg(F.max("_n").alias("_n"), *map(at, wanted))
    return found.select(*(F.col(w).alias(c) for c, w in zip(by, groups, strict=True)), "_n", *wanted)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """(by..., name...): for each group its percentiles, ``points`` interpolated between neighbours, ``nearest`` those of the
    nearest rank (halves to even). Null values don't count; without ``by`` there is one row, of nulls if there is no value."""
    place = lambda p: (F.col("_n") - 1) * F.lit(p)
    wanted = {n: F.bround(place(p), 0) for n, p in (nearest or {}).items()}
    for n, p in points.items():
        wanted |= {f"_lo_{n}": F.floor(place(p)), f"_hi_{n}": F.ceil(place(p))}
    found = ranks(rows, by, value, wanted)

    def mixed(n: str, p: float) -> Column:
        part = place(p) - F.floor(place(p))
        return (F.col(f"_lo_{n}") * (1 - part) + F.col(f"_hi_{n}") * part).alias(n)

    return found.select(*by, *(mixed(n, p) for n, p in points.items()), *(nearest or {}))
