"""The canonical message: topic, partition, offset, timestamp, key, value, headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.codec import Codec
from rillflow.functions.partition import fnv1a, partition_of

COLUMNS = ["topic", "partition", "offset", "timestamp", "key", "value", "headers"]
SCHEMA = "topic string, partition int, offset long, timestamp timestamp, key string, value binary, headers map<string,binary>"

NIL_IGNORE, NIL_PROCESS, NIL_DECODE = "ignore", "process", "decode"


def envelope(df: DataFrame, topic: str, key: Column | str, offset: Column | str, value: Column | str, timestamp: Column | str | None = None, headers: Column | None = None, partitions: int = 8, hasher: Callable[[Column], Column] = fnv1a) -> DataFrame:
    """Rows of any table as messages.  ``value`` keeps its type; unused columns are pruned away."""
    key = F.col(key) if isinstance(key, str) else key
    key = key.cast("string")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        F.lit(topic).alias("topic"), partition_of(key, partitions, hasher).alias("partition"), column(offset).cast("long").alias("offset"),
        (column(timestamp) if timestamp is not None else F.lit(None).cast("timestamp")).alias("timestamp"), key.alias("key"), column(value).alias("value"),
        (headers if headers is not None else F.lit(None).cast("map<string,binary>")).alias("headers"),
    )


def decoded(messages: DataFrame, codec: Codec, nil: str = NIL_IGNORE) -> DataFrame:
    """Decodes ``value``; ``nil`` says what becomes of null values: dropped, kept as null, or decoded."""
    if nil == NIL_IGNORE:
        messages = messages.filter(F.col("value").isNotNull())
        return messages.withColumn("value", codec.decode(F.col("value")))
    if nil == NIL_PROCESS:
        return messages.withColumn("value", codec.decode(F.col("value")))
    if nil == NIL_DECODE:
        return messages.withColumn("value", F.coalesce(codec.decode(F.col("value")), codec.null_value()))
    raise ValueError(f"unknown nil handling {nil!r}")


def encoded(messages: DataFrame, codec: Codec) -> DataFrame:
    return messages.withColumn("value", codec.encode(F.col("value")))


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Several topics into one stream of messages (UNION ALL)."""
    if not inputs:
        raise ValueError("no input topic")
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def recover_range(messages: DataFrame, stored: int | None, oldest: int, newest: int) -> DataFrame:
    """The rows that a restart reads: from after the stored offset (never before the oldest) up to the newest.

    ``stored`` is None or a negative sentinel where nothing was stored.
    """
    start = oldest if stored is None or stored < 0 else max(stored + 1, oldest)
    return messages.filter((F.col("offset") >= start) & (F.col("offset") < newest))
