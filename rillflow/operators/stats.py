"""Statistics of inputs and outputs as aggregates over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_stats(messages: DataFrame, hwm: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Per topic and partition: count, bytes of the value's text, last offset; with high-water marks also the lag, with ``now`` the newest message's delay in seconds."""
    size = F.sum(F.octet_length(F.col("value").cast("string")).cast("long"))
    rows = messages.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("count"), F.coalesce(size, F.lit(0)).alias("bytes"), F.max("offset").alias("last_offset"), *([] if now is None else [(now.cast("double") - F.max(F.col("timestamp").cast("timestamp")).cast("double")).alias("delay")]))
    if hwm is None:
        return rows
    return rows.join(hwm, ["topic", "partition"], "left").withColumn("lag", F.greatest(F.lit(0), F.col("hwm") - 1 - F.col("last_offset")))


def output_stats(outputs: DataFrame) -> DataFrame:
    """Per topic: how many messages went out and their bytes."""
    return outputs.groupBy("topic").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.octet_length("value").cast("long")), F.lit(0)).alias("bytes"))


def recovery_stats(log: DataFrame, recovered: Column, topic: str = "topic", partition: str = "partition") -> DataFrame:
    """Per topic and partition of a table that has been read up to, not with, offset ``recovered``.

    count and bytes (keys and values) of the changes read, last_offset read
    (-1 if none), hwm (one after the last there is), lag (changes not read yet)
    and whether the partition is recovered.
    """
    done = F.col("offset") < recovered
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    total = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    rows = log.groupBy(topic, partition).agg(
        F.count_if(done).alias("count"), total(F.when(done, size)).alias("bytes"), F.coalesce(F.max(F.when(done, F.col("offset"))), F.lit(-1)).cast("long").alias("last_offset"),
        (F.max("offset") + 1).alias("hwm"), F.count_if(~done).alias("lag"),
    )
    return rows.withColumn("recovered", F.col("lag") == 0)
