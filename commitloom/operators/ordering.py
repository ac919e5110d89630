"""Orders of commits: overall, by author, by file, by file and author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, fresh


def dense_order(df: DataFrame, by: list[str], name: str = "order", slices: int = 200) -> DataFrame:
    """Adds 1..n by the columns ``by``, without sorting everything in one task.

    Rows are parted into ranges, numbered within them, and each range begins
    where the rows of the ranges before end.  Ties that ``by`` does not settle
    are numbered in any order.
    """
    part, local = fresh(df.columns, "_part"), fresh(df.columns, "_local")
    ranged = cut(df.repartitionByRange(slices, *[F.col(b) for b in by]).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col(part), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = ranged.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return numbered.join(F.broadcast(starts), part).withColumn(name, (F.col("before") + F.col(local)).cast("bigint")).drop(part, local, "before")


def running_total(df: DataFrame, by: list[str], value: str, name: str = "total", slices: int = 200) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one by the columns ``by``, without sorting everything in one task.

    Rows are parted into ranges, summed up within them, and each range goes on
    from the sum of the ranges before.  Null values add nothing.
    """
    part, local, before = (fresh(df.columns, n) for n in ("_part", "_sum", "_before"))
    ranged = cut(df.repartitionByRange(slices, *[F.col(b) for b in by]).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy(part).agg(F.sum(value).alias("s")).select(part, F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn(local, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(local)).drop(part, local, before)


def order_within(df: DataFrame, keys: list[str], by: list[str], name: str, slices: int = 200) -> DataFrame:
    """Adds 1..n by ``by`` within each key; null keys are one key.

    A key may hold a large part of all rows, so no key is sorted as a whole: rows
    are parted into ranges of ``by``, numbered within key and range, and each
    range goes on where the ranges before end for that key.
    """
    part, local, before = (fresh(df.columns, n) for n in ("_part", "_local", "_before"))
    ranged = cut(df.repartitionByRange(slices, *[F.col(b) for b in by]).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"{k}_s") for k in keys], F.col(part).alias(f"{part}_s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    numbered = ranged.withColumn(local, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*by)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_s")) for k in keys] + [F.col(part) == F.col(f"{part}_s")]
    out = numbered.join(starts, same).withColumn(name, (F.col(before) + F.col(local)).cast("bigint"))
    return out.drop(part, local, before, f"{part}_s", *[f"{k}_s" for k in keys])


def order_range(df: DataFrame, order: str = "order", reachable: str | None = "reachable", cutoff: int | None = None, date: str = "date") -> DataFrame:
    """``least, greatest``: the range of the order over reachable rows after the cutoff."""
    keep = F.lit(True)
    keep = keep & F.col(reachable) if reachable else keep
    keep = keep & (F.col(date) > cutoff) if cutoff is not None else keep
    return df.filter(keep).agg(F.min(order).alias("least"), F.max(order).alias("greatest"))


def as_map(df: DataFrame, key: str, name: str, value: str, out: str) -> DataFrame:
    """``key, out``: a map from ``name`` to ``value`` per key (the files of one commit)."""
    return df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias(out))


def order_window(df: DataFrame, offset: float = 0, limit: float = 0, order: str = "order") -> DataFrame:
    """Rows of a part of the order; numbers below 1 are fractions of its range, a limit of 0 means to the end."""
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    span = F.col("_hi") - F.col("_lo") + 1
    start = F.col("_lo") + (F.floor(span * offset) if 0 < offset < 1 else F.lit(int(offset)))
    size = (F.floor(span * limit) if 0 < limit < 1 else F.lit(int(limit))) if limit else span
    return df.crossJoin(F.broadcast(ends)).filter((F.col(order) >= start) & (F.col(order) < start + size)).drop("_lo", "_hi")
