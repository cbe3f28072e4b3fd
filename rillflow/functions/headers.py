"""Message headers as map<string, binary> (any value type works)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(*headers: Column) -> Column:
    """One map from several; of equal names the later map's value stays; nothing at all gives null."""
    entries = _entries(headers)
    return F.when(F.size(entries) > 0, F.map_from_entries(_last_of_each(entries)))


def _last_of_each(entries: Column) -> Column:
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))


def _entries(headers: tuple[Column, ...]) -> Column:
    """All maps' entries, one after the other; a null map has none."""
    return F.flatten(F.filter(F.array(*[F.map_entries(h) for h in headers]), lambda x: x.isNotNull()))


def from_pairs(pairs: Column) -> Column:
    """array<struct<key, value>> as a source delivers it; of repeated names the last stays."""
    return F.map_from_entries(_last_of_each(pairs))


def to_pairs(headers: Column) -> Column:
    return F.map_entries(headers)
