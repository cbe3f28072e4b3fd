"""Which member of a group gets which partitions, so that equal partitions of all topics meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.joins import BROADCAST_ROWS


def copartition_plan(subscriptions: DataFrame, topics: DataFrame, strict: bool = False) -> DataFrame:
    """(member, topic, partition) from subscriptions (member, topic) and topics (topic, partitions).

    Members in order share the partitions in equal stretches, rounded half up;
    each gets its stretch of its own topics.  All topics must have as many
    partitions; ``strict`` also wants all members to have the same topics.
    """
    counts = topics.join(subscriptions.select("topic").distinct(), "topic", "left_semi").select("partitions").distinct().limit(2).collect()
    if len(counts) > 1:
        raise ValueError("topics are not co-partitioned")
    if strict:
        sets = subscriptions.groupBy("member").agg(F.array_sort(F.collect_set("topic")).alias("t")).select("t").distinct().limit(2).collect()
        if len(sets) > 1:
            raise ValueError("members have different topics")
    members = subscriptions.select("member").distinct()  # the members of one group: a handful
    members = members.withColumns({"i": F.row_number().over(Window.orderBy("member")) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    share = F.col("partitions") / F.col("m")
    edge = lambda i: F.floor(i * share + 0.5).cast("int")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = subscriptions.distinct().join(small(members), "member").join(small(topics), "topic").withColumns({"lo": edge(F.col("i")), "hi": edge(F.col("i") + 1)})
    return rows.filter("lo < hi").select("member", "topic", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("partition"))
