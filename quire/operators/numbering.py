"""Places of rows within their groups, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Values of the order that are numbered in one task: blocks of this width.
BLOCK = 8192


def numbered(rows: DataFrame, by: list[str], order: str, start: int = 1, width: int = BLOCK) -> DataFrame:
    """``rows`` with ``nth``, each row's place among those with equal ``by`` in the order of a whole number; nulls are one group, and stand first.

    Blocks of the order are counted first and their counts summed up; a window only spans a block.
    """
    keyed = rows.withColumn("__block", F.expr(f"`{order}` div {width} - if(`{order}` < 0 and `{order}` % {width} <> 0, 1, 0)"))
    counts = keyed.groupBy(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__block").alias("__b")).agg(F.count("*").alias("n"))
    names = [f"__{i}" for i in range(len(by))]
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)] + [F.col("__block").eqNullSafe(F.col("__b"))]
    joined = keyed.join(starts, reduce(lambda a, b: a & b, same))
    within = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(order))
    return joined.withColumn("nth", F.col("__start") + within + (start - 1)).drop("__block", "__b", "__start", *names)
