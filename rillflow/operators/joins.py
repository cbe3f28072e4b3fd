"""Table joins of a stream: co-partitioned (same key) and replicated (any key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000


def join_latest(stream: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """Each message with its key's row of a compacted table, or nulls."""
    return stream.join(table, key, "left")


def join_asof(stream: DataFrame, changelog: DataFrame, *columns: str, key: str = "key", order: str = "offset", prefix: str = "table_") -> DataFrame:
    """Each message with the table's row as it stood then: the last change at or before the message.

    One union and one window on the key, no join and no blow-up.  A change is
    a struct, so a tombstone (null inside) overrides what was before.
    """
    columns = columns or ("value",)
    change = F.struct(*[F.col(c).alias(c) for c in columns])
    left = stream.withColumns({"_side": F.lit(1), "_change": F.lit(None).cast(changelog.select(change.alias("c")).schema["c"].dataType)})
    right = changelog.select(key, order, F.lit(0).alias("_side"), change.alias("_change"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_change", F.last("_change", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*stream.columns, *[F.col(f"_change.{c}").alias(f"{prefix}{c}") for c in columns])


def join_asof_in_buckets(stream: DataFrame, changelog: DataFrame, width: int, *columns: str, key: str = "key", order: str = "offset", prefix: str = "table_") -> DataFrame:
    """:func:`join_asof` for keys that hold a large share of all rows.

    A key's order is cut into buckets of ``width``; the last change of each
    bucket is aggregated before it is shuffled and carried into later ones, so
    no task holds more than a bucket's rows.  Null keys and null orders are
    values like others; a null order comes first.
    """
    columns = columns or ("value",)
    change = F.struct(*[F.col(c).alias(c) for c in columns])
    bucket = F.floor(F.col(order) / width)
    kind = changelog.select(change.alias("c")).schema["c"].dataType
    left = stream.withColumns({"_side": F.lit(1), "_change": F.lit(None).cast(kind), "_bucket": bucket})
    right = changelog.select(key, order, F.lit(0).alias("_side"), change.alias("_change"), bucket.alias("_bucket"))
    last = left.select(key, "_bucket", order, "_change").unionByName(right.select(key, "_bucket", order, "_change"))
    last = last.groupBy(key, "_bucket").agg(F.max_by("_change", F.when(F.col("_change").isNotNull(), F.struct(order))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key, "_bucket").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_change", F.last("_change", ignorenulls=True).over(w)).filter("_side = 1")
    both = both.join(last, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    found = F.coalesce("_change", "_carried")
    return both.withColumn("_change", found).select(*stream.columns, *[F.col(f"_change.{c}").alias(f"{prefix}{c}") for c in columns])


def lookup(stream: DataFrame, table: DataFrame, on: Column, rows: int | None = None) -> DataFrame:
    """Each message with a row of a replicated table, found by any key.

    The table is broadcast where ``rows`` (its checked size) allows; without a
    size Spark's own statistics decide.
    """
    small = rows is not None and rows <= BROADCAST_ROWS
    return stream.join(F.broadcast(table) if small else table, on, "left")


def lookup_words(stream: DataFrame, dictionary: DataFrame, text: str, id_cols: list[str], word: str = "word", value: str = "value", rows: int | None = None) -> DataFrame:
    """Replaces each word of a text that the dictionary knows, in order; one lookup per word."""
    words = stream.select(*id_cols, F.posexplode(F.split(text, " ")).alias("_pos", "_word"))
    found = lookup(words, dictionary.select(F.col(word).alias("_key"), F.col(value).alias("_new")), F.col("_word") == F.col("_key"), rows)
    picked = F.struct("_pos", F.coalesce("_new", "_word").alias("_word"))
    rebuilt = found.groupBy(*id_cols).agg(F.array_sort(F.collect_list(picked)).alias("_words"))
    return rebuilt.select(*id_cols, F.array_join(F.transform("_words", lambda w: w["_word"]), " ").alias(text))


def unless(joined: DataFrame, flag: str) -> DataFrame:
    """Drops messages whose joined flag is true; a missing row keeps the message."""
    return joined.filter(~F.coalesce(F.col(flag), F.lit(False)))
