"""Running aggregates that no single task has to hold.

A plain window over ``partitionBy(key)`` puts all of a key's rows into one
task.  Here order is cut into buckets of ``width``: an aggregate by (key,
bucket), combined on the map side, gives each bucket's total; a window over
the totals (a row a bucket) gives what came before it; the rows' own window
runs inside (key, bucket).  A key with most of the log is then as many tasks
as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running(rows: DataFrame, by: Sequence[str], order: str, value: Column, name: str, how: str = "sum", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """``rows`` and ``name``: the sum, max or min of ``value`` over the rows of the key up to this one.

    ``order`` is a column of longs, distinct within a key.  Without
    ``inclusive`` the row itself is left out, and the first has null.
    """
    return runnings(rows, by, order, {name: value}, how, inclusive, width)


def runnings(rows: DataFrame, by: Sequence[str], order: str, values: dict[str, Column], how: str = "sum", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """As ``running``, several values in one pass."""
    step = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[how]
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    by, names = list(by), list(values)
    keyed = rows.withColumns({"__bucket": F.floor(F.col(order) / F.lit(width)).cast("long"), **{f"__value{k}": values[c] for k, c in enumerate(names)}})
    totals = keyed.groupBy(*by, "__bucket").agg(*[agg(f"__value{k}").alias(f"__total{k}") for k in range(len(names))])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = [agg(f"__total{k}").over(earlier).alias(f"__base{k}") for k in range(len(names))]
    base = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__b"), *bases)
    same = F.col("__bucket") == F.col("__b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = keyed.join(base, same).withColumns({c: step(F.col(f"__base{k}"), agg(f"__value{k}").over(inside)) for k, c in enumerate(names)})
    return joined.select(*[c for c in rows.columns if c not in values], *names)


def before(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` and ``name``: what ``value`` was in the key's row before this one; null in the first."""
    last = running(rows, by, order, F.struct(F.col(order).alias("o"), F.col(value).alias("v")), "__last", "max", inclusive=False, width=width)
    return last.withColumn(name, F.col("__last.v")).drop("__last")


def numbered(rows: DataFrame, order: str, name: str, start: int = 1, by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """``rows`` and ``name``: start, start + 1, ... in ``order``, within each key of ``by``."""
    out = running(rows, by, order, F.lit(1).cast("long"), "__n", width=width)
    return out.withColumn(name, (F.col("__n") + F.lit(start - 1)).cast("long")).drop("__n")
