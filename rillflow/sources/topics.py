"""Topics as parquet folders: a catalogue, appends with gapless offsets, batch and stream reads.

A topic's folder holds one sub-folder per append, named by its first offset and
the one after its last, so that offsets are known without reading a message;
file sources read them oldest first.  A Kafka source or sink can take its place
(``kafka_source``, ``kafka_sink``); it needs the connector's jar.
"""

from __future__ import annotations

import json
import logging
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.partition import fnv1a, partition_of
from rillflow.sources.envelope import COLUMNS, SCHEMA

IGNORE, WARN, FAIL = "ignore", "warn", "fail"
DEFAULTS = {"replication": 2, "retention_ms": 3_600_000, "timeout_s": 10.0}
log = logging.getLogger("rillflow")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a private folder where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors of a cluster need a folder they share")
        base = getattr(spark, "_rillflow_topics", None) or "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark._rillflow_topics = base
    return base.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """Written once and read back, in the folder all executors share."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: Column, start: int = 0) -> tuple[DataFrame, int]:
    """``rows`` with ``_number``, gapless from ``start`` in the order given, and the next number.

    Sorted over all tasks; a number is its partition's first one plus the
    place within, so no task sees all rows.
    """
    rows = materialised(rows.withColumn("_order", order).orderBy("_order").drop("_order").withColumn("_m", F.monotonically_increasing_id())).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"))  # one row per partition
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")
    return rows.withColumn("_number", (F.col("_before") + F.col("_i") + start).cast("long")).drop("_p", "_i", "_m", "_before"), start + total


class Append(NamedTuple):
    """A sub-folder of a topic: offsets from ``start`` up to, not with, ``end``."""

    name: str
    start: int
    end: int
    tag: str
    modified: int
    done: bool


class TopicManager:
    """Creates and describes topics below ``root``; any path that Spark's file systems know."""

    def __init__(self, spark: SparkSession, root: str, mismatch: str = WARN, create: bool = True):
        if mismatch not in (IGNORE, WARN, FAIL):
            raise ValueError(f"unknown mismatch behaviour {mismatch!r}")
        self.spark, self.root, self.mismatch, self.create = spark, root.rstrip("/"), mismatch, create

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def exists(self, topic: str) -> bool:
        fs, p = self._fs(f"{self.path(topic)}/_topic.json")
        return fs.exists(p)

    def config(self, topic: str) -> dict:
        fs, p = self._fs(f"{self.path(topic)}/_topic.json")
        if not fs.exists(p):
            raise KeyError(f"no topic {topic}")
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def ensure_topic_exists(self, topic: str, partitions: int, replication: int = DEFAULTS["replication"], config: dict | None = None) -> dict:
        want = {"partitions": partitions, "replication": replication, "config": dict(config or {})}
        if self.exists(topic):
            have = self.config(topic)
            if have["partitions"] != partitions:
                raise ValueError(f"topic {topic} has {have['partitions']} partitions instead of {partitions}")
            for k in ("replication", "config"):
                if have[k] != want[k]:
                    self._differs(f"topic {topic} has {k} {have[k]} instead of {want[k]}")
            return have
        if not self.create:
            raise ValueError(f"topic {topic} does not exist and must not be created")
        fs, p = self._fs(f"{self.path(topic)}/_topic.json")
        out = fs.create(p)
        out.write(bytearray(json.dumps(want).encode()))
        out.close()
        return want

    def _differs(self, message: str) -> None:
        if self.mismatch == FAIL:
            raise ValueError(message)
        if self.mismatch == WARN:
            log.warning(message)

    def ensure_stream_exists(self, topic: str, partitions: int, retention_ms: int = DEFAULTS["retention_ms"]) -> dict:
        return self.ensure_topic_exists(topic, partitions, config={"cleanup.policy": "delete", "retention.ms": str(retention_ms)})

    def ensure_table_exists(self, topic: str, partitions: int) -> dict:
        return self.ensure_topic_exists(topic, partitions, config={"cleanup.policy": "compact"})

    def partitions(self, topic: str) -> list[int]:
        return list(range(self.config(topic)["partitions"]))

    def ensure_copartitioned(self, topics: list[str]) -> int:
        counts = {len(self.partitions(t)) for t in topics}
        if len(counts) != 1:
            raise ValueError(f"topics {topics} are not co-partitioned")
        return counts.pop()

    def get_offset(self, topic: str, newest: bool = True) -> int:
        """The next offset to be written, or the oldest there is: from the folders' names alone."""
        parts = self._appends(topic)
        return 0 if not parts else max(x.end for x in parts) if newest else min(x.start for x in parts)

    def append(self, topic: str, rows: DataFrame, start: int | None = None, tag: str = "", hasher: Callable[[Column], Column] = fnv1a) -> int:
        """Appends (key, value and, where there, timestamp and headers) with gapless offsets in ``seq`` order; the next offset.

        With a ``tag``, an append of the same tag takes the earlier one's place.
        """
        config = self.config(topic)
        earlier = [x for x in self._appends(topic, unfinished=True) if tag and x.tag == tag]
        if earlier:
            start = earlier[0].start
        start = self.get_offset(topic) if start is None else start
        has = set(rows.columns)
        rows, end = numbered(rows, F.col("seq") if "seq" in has else F.monotonically_increasing_id(), start)
        out = rows.select(
            F.lit(topic).alias("topic"), partition_of(F.col("key"), config["partitions"], hasher).alias("partition"), F.col("_number").alias("offset"),
            (F.col("timestamp") if "timestamp" in has else F.lit(None)).cast("timestamp").alias("timestamp"), "key", F.col("value").cast("binary").alias("value"),
            (F.col("headers") if "headers" in has else F.lit(None)).cast("map<string,binary>").alias("headers"),
        )
        name = f"from={start:020d},to={end:020d}{'-' + tag if tag else ''}"
        # What an append that failed left at this place, and an earlier one of this tag with other rows, would be read beside it.
        for x in self._appends(topic, unfinished=True):
            if x.name != name and (x in earlier or (not x.done and x.start >= start)):
                self._delete(f"{self.path(topic)}/{x.name}")
        out.write.mode("overwrite").parquet(f"{self.path(topic)}/{name}")
        return end

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _appends(self, topic: str, unfinished: bool = False) -> list[Append]:
        fs, p = self._fs(self.path(topic))
        out = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if s.isDirectory() and name.startswith("from="):
                own, mark = self._fs(f"{self.path(topic)}/{name}/_SUCCESS")
                edges, _, tag = name.partition("-")
                start, end = edges.removeprefix("from=").split(",to=")
                out.append(Append(name, int(start), int(end), tag, s.getModificationTime(), own.exists(mark)))
        return sorted(x for x in out if x.done or unfinished)

    def read(self, topic: str, since: int = 0) -> DataFrame:
        """All messages there are, or those from offset ``since`` on: earlier appends are not read."""
        paths = [f"{self.path(topic)}/{x.name}" for x in self._appends(topic) if x.end > since]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(*paths).select(*COLUMNS)
        return rows.filter(F.col("offset") >= since) if since else rows

    def stream(self, topic: str, files: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        return reader.parquet(self.path(topic)).select(*COLUMNS)

    def compact(self, topic: str, tombstones: bool = True) -> int:
        """Rewrites a table's topic so that each key has its last change only, under its own offset; how many are left.

        Without ``tombstones`` deleted keys go altogether: for topics whose
        readers have all seen the deletion.  One append takes the place of
        those read; what is appended meanwhile stays.
        """
        if self.config(topic)["config"].get("cleanup.policy") != "compact":
            raise ValueError(f"topic {topic} is not a table's")
        parts = self._appends(topic)
        if not parts:
            return 0
        last = self.read(topic).groupBy("key").agg(F.max_by(F.struct(*[c for c in COLUMNS if c != "key"]), F.col("offset")).alias("m"))
        rows = last.select(*[F.col("key") if c == "key" else F.col(f"m.{c}").alias(c) for c in COLUMNS])
        rows = materialised(rows if tombstones else rows.filter(F.col("value").isNotNull()))
        name = f"from={min(x.start for x in parts):020d},to={max(x.end for x in parts):020d}-compact{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path(topic)}/{name}")
        for x in parts:
            self._delete(f"{self.path(topic)}/{x.name}")
        return rows.count()

    def expire(self, topic: str, now_ms: int | None = None) -> int:
        """Deletes a stream's appends that are older than its retention; how many went.  The newest stays: it keeps the offset."""
        config = self.config(topic)["config"]
        if config.get("cleanup.policy") != "delete":
            raise ValueError(f"topic {topic} is not a stream")
        now = time.time() * 1000 if now_ms is None else now_ms
        old = [x for x in self._appends(topic)[:-1] if x.modified < now - int(config["retention.ms"])]
        for x in old:
            self._delete(f"{self.path(topic)}/{x.name}")
        return len(old)


def kafka_source(spark: SparkSession, brokers: str, topics: list[str], oldest: bool = False) -> DataFrame:
    """Envelopes from Kafka; tables start at the oldest offset, streams at the newest."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest" if oldest else "latest").option("includeHeaders", "true").load()
    return rows.select("topic", "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"), "value", F.map_from_entries("headers").alias("headers"))


def kafka_sink(rows: DataFrame, brokers: str, checkpoint: str):
    out = rows.select("topic", F.encode("key", "UTF-8").alias("key"), "value", F.map_entries("headers").alias("headers"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("includeHeaders", "true").option("checkpointLocation", checkpoint)
