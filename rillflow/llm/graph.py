"""Connected components of an edge table by repeated joins: labels shrink to neighbours' and jump to labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b); comp is the component's least node."""
    both = cut(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        less = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        up = less.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = cut(less.join(up, F.col("comp") == F.col("up"), "left").select("node", F.least("comp", "top").alias("comp"), "was"))
        moved = new.filter("comp <> was").limit(1).count()
        drop_cut(labels)
        labels = new.select("node", "comp")
        if not moved:
            drop_cut(both)
            return labels
