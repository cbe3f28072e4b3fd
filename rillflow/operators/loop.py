"""Loop-back: messages that a group sends to itself under another key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loopback(stream: DataFrame, key: Column, condition: Column | None = None, hop: str = "hop") -> DataFrame:
    """The stream and its re-keyed copies, ordered by (offset, hop): a message is handled before what it loops back."""
    first = stream.withColumn(hop, F.lit(0))
    again = (stream if condition is None else stream.filter(condition)).withColumn("key", key.cast("string")).withColumn(hop, F.lit(1))
    return first.unionByName(again)


def loop_hops(stream: DataFrame, step: Callable[[DataFrame], DataFrame], hops: int, hop: str = "hop") -> DataFrame:
    """All messages of at most ``hops`` rounds of a loop.  Each round is a projection of the one before; nothing shuffles."""
    part = stream.withColumn(hop, F.lit(0))
    out = part
    for i in range(1, hops + 1):
        part = step(part).withColumn(hop, F.lit(i))
        out = out.unionByName(part)
    return out
