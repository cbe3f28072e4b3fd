"""Read-only views of a compacted table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class TableView:
    """Point, range and prefix reads of a table by key; every read is a filter that reaches the scan.

    Keys are ordered by their UTF-8 bytes.  ``evict`` hides keys from this
    view only.
    """

    def __init__(self, table: DataFrame, key: str = "key"):
        self.table, self.key = table, key

    def get(self, key: str) -> DataFrame:
        return self.table.filter(F.col(self.key) == key)

    def get_row(self, key: str) -> Row | None:
        return self.get(key).first()

    def has(self, key: str) -> bool:
        return not self.get(key).limit(1).isEmpty()

    def has_keys(self, keys: DataFrame) -> DataFrame:
        """For a table of keys: each with ``present``."""
        there = self.table.select(F.col(self.key).alias("_k")).distinct().withColumn("_p", F.lit(True))
        return keys.join(there, keys[self.key] == there["_k"], "left").select(self.key, F.coalesce("_p", F.lit(False)).alias("present"))

    def iterate(self) -> DataFrame:
        return self.table.orderBy(self.key)

    def range(self, start: str, limit: str = "") -> DataFrame:
        """Keys from ``start`` up to, not with, ``limit``; without a limit, keys that begin with ``start``."""
        k: Column = F.col(self.key)
        rows = self.table.filter((k >= start) & (k < limit) if limit else k.startswith(start))
        return rows.orderBy(self.key)

    def seek(self, key: str) -> DataFrame:
        return self.table.filter(F.col(self.key) >= key).orderBy(self.key)

    def rows(self) -> Iterator[Row]:
        """A cursor, partition by partition."""
        return self.iterate().toLocalIterator()

    def evict(self, keys: DataFrame) -> TableView:
        gone = keys.select(F.col(self.key)).distinct()
        return TableView(self.table.join(gone, self.key, "left_anti"), self.key)
