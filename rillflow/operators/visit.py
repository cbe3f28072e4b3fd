"""Visitors: a named pass over every row of a group table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visit_all(table: DataFrame, change: Callable[[Column], Column], key: str = "key", value: str = "value") -> DataFrame:
    """The table after a visit that sets each row's value (null deletes the row)."""
    return table.withColumn(value, change(F.col(value))).filter(F.col(value).isNotNull())


def visit_changelog(changelog: DataFrame, visits: DataFrame, key: str = "key", order: str = "offset", value: str = "value") -> DataFrame:
    """Messages and visits of a key as one changelog; a visit comes after the message of the same offset."""
    rows = changelog.select(key, F.col(order), F.lit(0).alias("_visit"), F.col(value))
    return rows.unionByName(visits.select(key, F.col(order), F.lit(1).alias("_visit"), F.col(value)))
