"""Ordered per-key folds: the running form (one row per message) and the final form (one row per key).

Final forms aggregate before they shuffle.  Running forms are one window per
key and share one shuffle when they share key and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def history(key: str = "key", order: str | list[str] = "offset") -> WindowSpec:
    """Everything of the key up to and with the current message."""
    return Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_count(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(w)


def running_sum(value: Column, w: WindowSpec) -> Column:
    return F.sum(value).over(w)


def running_count_if(condition: Column, w: WindowSpec) -> Column:
    return F.sum(condition.cast("long")).over(w)


def running_last_n(value: Column, n: int, key: str = "key", order: str | list[str] = "offset") -> Column:
    """The last n values, oldest first."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(-(n - 1), Window.currentRow)
    return F.collect_list(value).over(w)


def running_latch(on: Column, off: Column, w: WindowSpec) -> Column:
    """True after the last ``on``, false after the last ``off``, null before either."""
    return F.last(F.when(on, F.lit(True)).when(off, F.lit(False)), ignorenulls=True).over(w)


def ratio_alerts(df: DataFrame, part: Column, whole: Column, least: int, ratio: float, key: str = "key", order: str | list[str] = "offset") -> DataFrame:
    """Messages at which the key has ``least`` counted messages and ``part`` makes up at least ``ratio`` of them."""
    w = history(key, order)
    df = df.withColumns({"part": running_count_if(part, w), "whole": running_count_if(whole, w)})
    return df.filter((F.col("whole") >= least) & (F.col("part") >= ratio * F.col("whole")))


def final_count(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("value"))


def final_sum(df: DataFrame, value: Column, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("value"))


def final_last(df: DataFrame, *columns: str, key: str = "key", order: str = "offset") -> DataFrame:
    """The columns of the key's last message, nulls included."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def final_last_n(df: DataFrame, value: Column, n: int, key: str = "key", order: str = "offset") -> DataFrame:
    """The last n values of a key, oldest first.  Ranks first, so a key's list never holds more than n."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    top = df.select(key, F.col(order).alias("_o"), value.alias("_v"), F.row_number().over(w).alias("_r")).filter(F.col("_r") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("value"))


def final_latch(df: DataFrame, on: Column, off: Column, key: str = "key", order: str = "offset") -> DataFrame:
    flag = F.when(on, F.lit(True)).when(off, F.lit(False))
    marked = df.select(key, F.col(order).alias("_o"), flag.alias("_f")).filter(F.col("_f").isNotNull())
    return marked.groupBy(key).agg(F.max_by("_f", "_o").alias("value"))


def running_sum_in_buckets(df: DataFrame, value: Column, width: int, key: str = "key", order: str = "offset", name: str = "value") -> DataFrame:
    """:func:`running_sum` for keys that hold a large share of all rows.

    A key's order is cut into buckets of ``width``; buckets are summed before
    they are shuffled, a bucket's rows start from the sum of those before, and
    no task holds more than a bucket's rows.  Null keys and null orders are
    values like others; a null order comes first.
    """
    df = df.withColumns({"_bucket": F.floor(F.col(order) / width), "_value": value})
    sums = df.groupBy(key, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.sum("_sum").over(before).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.sum("_value").over(inside))
    columns = [key, *(c for c in out.columns if c not in (key, "_bucket", "_value"))]
    out = out.join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    return out.withColumn(name, F.coalesce(F.col(name) + F.col("_before"), name, "_before")).select(*columns)
