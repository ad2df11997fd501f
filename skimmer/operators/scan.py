"""Running sums and maxima of a key's rows by a parallel prefix scan, so that one hot key takes many tasks.

The order's range is cut into blocks of about as many rows each; a window runs in each (key, block), and the totals of the blocks,
a row each, are scanned apart and added. Rows are read three times: for the cuts, the totals and the windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.operators.match import small

BLOCKS = 32


def cut(rows: DataFrame, order: str, blocks: int = BLOCKS) -> Column:
    """The block of a row's order, from 0: its rank among approximate quantiles. Rows of a null order are in block 0."""
    bounds = sorted(set(rows.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [i / blocks for i in range(1, blocks)], 0.2 / blocks)))
    return reduce(lambda a, b: a + b, (F.coalesce((F.col(order) > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def running(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """rows with running sums and maxima by key in order; before: of earlier rows only, null at a key's first one. Rows of equal order
    follow one another in any way."""
    sums, maxima = sums or {}, maxima or {}
    rows = rows.withColumn("__block", cut(rows, order, blocks))
    kinds = [(k, v, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)) for k, v in sums.items()]
    kinds += [(k, v, F.max, lambda a, b: F.greatest(a, b)) for k, v in maxima.items()]
    totals = rows.groupBy(*by, "__block").agg(*(f(v).alias(k) for k, v, f, _ in kinds))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, "__block", *(f(k).over(earlier).alias(f"__{k}") for k, _, f, _ in kinds))
    here = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    within = rows.withColumns({k: f(v).over(here) for k, v, f, _ in kinds})
    own = {c: f"__at_{c}" for c in [*by, "__block"]}
    heads = small(heads.withColumnsRenamed(own))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()))
    done = within.join(heads, same, "left").withColumns({k: both(F.col(k), F.col(f"__{k}")) for k, _, _, both in kinds})
    return done.drop("__block", *own.values(), *(f"__{k}" for k, *_ in kinds))
