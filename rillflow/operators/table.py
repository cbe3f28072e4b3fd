"""Group tables as changelogs: compaction, upserts, deletes, custom reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(changelog: DataFrame, *columns: str, key: str = "key", order: str = "offset", tombstone: Column | None = None) -> DataFrame:
    """Latest row per key; keys whose latest row is a tombstone are gone.

    The row is taken as a whole, nulls included, and tombstones are dropped
    only after that: dropping them earlier would bring deleted keys back.
    ``tombstone`` defaults to a null first column.
    """
    columns = columns or ("value",)
    last = changelog.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"))
    rows = last.select(key, *[F.col(f"last.{c}").alias(c) for c in columns])
    return rows.filter(~(tombstone if tombstone is not None else F.col(columns[0]).isNull()))


def reduce_changelog(changelog: DataFrame, reducer: Callable[[], Column], key: str = "key") -> DataFrame:
    """A custom materialisation: ``reducer`` is any aggregate over the changelog's rows of a key."""
    return changelog.groupBy(key).agg(reducer().alias("value"))


def upsert(table: DataFrame, changes: DataFrame, *columns: str, key: str = "key", order: str = "offset") -> DataFrame:
    """A compacted table after more changes: the changes' last row per key wins, a null one deletes."""
    columns = columns or ("value",)
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("new"))
    joined = table.withColumn("_old", F.lit(True)).join(last, key, "full_outer")
    picked = joined.select(key, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    return picked.filter(F.col(columns[0]).isNotNull())
