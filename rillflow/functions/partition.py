"""Key hashing and partition numbers as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_BASIS, PRIME, WORD = 2166136261, 16777619, 4294967295  # fixed values of 32-bit FNV-1a


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the key's UTF-8 bytes, as an unsigned number in a long."""
    text = F.hex(F.encode(key, "UTF-8"))
    # sequence(1, 0) would count down, so an empty key gets no step at all.
    steps = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(steps, F.lit(OFFSET_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * PRIME).bitwiseAND(F.lit(WORD)))


def fnv1a_of(key: str) -> int:
    """:func:`fnv1a` of one key, in Python."""
    h = OFFSET_BASIS
    for b in key.encode():
        h = ((h ^ b) * PRIME) & WORD
    return h


def partition_number(key: str, partitions: int) -> int:
    """:func:`partition_of` of one key under the default hash."""
    h = fnv1a_of(key)
    return abs(h - (WORD + 1) if h > WORD >> 1 else h) % partitions


def partition_of(key: Column, partitions: int, hasher: Callable[[Column], Column] = fnv1a) -> Column:
    """The hash as a signed 32-bit number, its absolute value (in 64 bits), modulo ``partitions``."""
    h = hasher(key)
    signed = F.when(h > 2147483647, h - 4294967296).otherwise(h)
    return (F.abs(signed) % partitions).cast("int")
