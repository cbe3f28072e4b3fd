"""A processor over topic folders: micro-batches through the state store, outputs fanned out per batch."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rillflow.operators.stats import input_stats, recovery_stats
from rillflow.plans.graph import GroupGraph
from rillflow.plans.options import NEWEST, ProcessorOptions
from rillflow.sources.topics import TopicManager, materialised
from rillflow.streaming.processor import LOOP, OUTPUT, TABLE, VISIT, stream_rows, stream_state
from rillflow.streaming.signal import Signal

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE, RECOVERING, RUNNING, STOPPED = range(4)


class StreamProcessor:
    """Runs a group.  State is exactly-once by the checkpoint; a batch that is retried overwrites its own output."""

    def __init__(self, graph: GroupGraph, topics: TopicManager, checkpoint: str, options: ProcessorOptions | None = None, lookups: dict[str, DataFrame] | None = None):
        self.options = options or ProcessorOptions()
        if self.options.graph_hook:
            self.options.graph_hook(graph)
        self.graph, self.topics, self.checkpoint, self.lookups = graph.validate(), topics, checkpoint, lookups
        self.spark = topics.spark
        self.signal = Signal(IDLE, RECOVERING, RUNNING, STOPPED)
        self.error: Exception | None = None
        self.outputs: dict[str, dict[str, int]] = {}
        self._running = False
        n = self.options.partitions
        for t in graph.copartitioned():
            if not topics.exists(t):
                topics.ensure_stream_exists(t, n)
        topics.ensure_copartitioned(graph.copartitioned())
        if graph.loop_stream:
            topics.ensure_stream_exists(graph.loop_stream.topic, n)
        if graph.group_table:
            topics.ensure_table_exists(graph.group_table.topic, n)
        for e in graph.output_streams:
            if not topics.exists(e.topic):
                topics.ensure_stream_exists(e.topic, n)
        for e in graph.visitors:
            topics.ensure_stream_exists(self._visits(e.topic), n)

    def _visits(self, name: str) -> str:
        return f"{self.graph.group}-visit-{name}"

    def _sources(self) -> DataFrame:
        names = self.graph.copartitioned() + ([self.graph.loop_stream.topic] if self.graph.loop_stream else []) + [self._visits(e.topic) for e in self.graph.visitors]
        starts, rows = self._starts(), None
        for name in names:
            part = stream_rows(self.graph, self.topics.stream(name, self.options.channel_size).filter(F.col("offset") >= starts.get(name, 0)))
            for e in self.graph.visitors:
                if name == self._visits(e.topic):
                    part = part.withColumns({"kind": F.lit(VISIT), "topic": F.lit(e.topic)})
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _starts(self) -> dict[str, int]:
        """Where input streams begin: settled when the group first runs, and kept beside its checkpoint."""
        fs, p = self.topics._fs(f"{self.checkpoint.rstrip('/')}-starts.json")
        if fs.exists(p):
            stream = fs.open(p)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return json.loads(text)
        starts = {e.topic: self.topics.get_offset(e.topic) if self.options.start == NEWEST else 0 for e in self.graph.input_streams}
        out = fs.create(p)
        out.write(bytearray(json.dumps(starts).encode()))
        out.close()
        return starts

    def _fan_out(self, batch: DataFrame, batch_id: int) -> None:
        rows = materialised(batch)
        counts = rows.groupBy("kind", "topic").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value").cast("long")), F.lit(0)).alias("bytes")).collect()
        for r in counts:
            if r.kind in (OUTPUT, TABLE, LOOP):
                own = rows.filter((F.col("kind") == r.kind) & (F.col("topic") == r.topic))
                own = own.withColumn("seq", F.struct("offset", "source", "seq"))
                self.topics.append(r.topic, own.select("key", "value", "headers", "seq"), tag=f"{self.graph.group}-{batch_id:010d}", hasher=self.options.hasher)
                s = self.outputs.setdefault(r.topic, {"count": 0, "bytes": 0})
                s["count"], s["bytes"] = s["count"] + r.n, s["bytes"] + r.bytes
        if self.options.before_commit:
            self.options.before_commit(rows, batch_id)
        self._looped = self._looped or any(r.kind == LOOP for r in counts)

    def run_available(self, rounds: int = 100) -> StreamProcessor:
        """Handles all there is, loop-backs included, then rests."""
        if self._running:
            raise RuntimeError(f"group {self.graph.group} is running already")
        self._running = True
        try:
            return self._run(rounds)
        finally:
            self._running = False

    def run_restarting(self, tries: int = 10, rounds: int = 100) -> StreamProcessor:
        """:meth:`run_available`, again after a failure: with the options' backoff, from the last batch that counted as done."""
        return restarting(lambda: self.run_available(rounds), self.options.backoff(), self.options.backoff_reset, tries)

    def wait_for_ready(self, timeout: float | None = None) -> bool:
        """Whether the group has recovered its state and runs, or did."""
        return self.signal.wait_for_state_min(RUNNING, timeout)

    def _run(self, rounds: int) -> StreamProcessor:
        self.options.logger.info("group %s: running", self.graph.group)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        self.signal.set_state(RECOVERING)
        for _ in range(rounds):
            self._looped = False
            out = stream_state(self.graph, self._sources(), self.options, self.lookups)
            query = out.writeStream.queryName(f"{self.options.client_id}-{self.graph.group}".replace("-", "_")).outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(self._fan_out).start()
            self.signal.set_state(RUNNING)
            try:
                query.awaitTermination()
            except Exception as e:
                self.error = e
                self.options.logger.error("group %s: %s", self.graph.group, e)
                self.signal.set_state(STOPPED)
                raise
            if not self._looped:
                return self
        raise RuntimeError(f"the loop did not come to rest in {rounds} rounds")

    def table(self) -> DataFrame:
        """(key, value) of the group table, from the state store."""
        if not self.graph.group_table:
            raise ValueError("stateless group has no table")
        codec = self.graph.group_table.codec
        rows = self.spark.read.format("statestore").option("stateVarName", "table").load(self.checkpoint)
        return rows.select(F.col("key.key").alias("key"), codec.decode(F.col("value.value")).alias("value"))

    def get(self, key: str) -> Row | None:
        return self.table().filter(F.col("key") == key).first()

    def stats(self) -> dict:
        """State, and per topic what came in (all there is), went out (by this run) and is in the group table."""
        inputs = {}
        for e in self.graph.input_streams + self.graph.joint_tables:
            rows = input_stats(self.topics.read(e.topic).withColumn("value", F.base64("value")), now=F.current_timestamp())
            inputs[e.topic] = {r.partition: {"count": r[2], "last_offset": r.last_offset, "delay": r.delay} for r in rows.collect()}
        table = {}
        if self.graph.group_table:
            log = self.topics.read(self.graph.group_table.topic)
            rows = recovery_stats(log, F.lit(self.topics.get_offset(self.graph.group_table.topic)))
            table = {r.partition: {"count": r[2], "bytes": r.bytes, "last_offset": r.last_offset} for r in rows.collect()}
        return {"group": self.graph.group, "state": self.signal.state, "inputs": inputs, "outputs": self.outputs, "table": table, "error": self.error and str(self.error)}

    def visit_all(self, name: str, meta: str | None = None) -> int:
        """Runs a visitor over every key there is; the number of keys visited."""
        if name not in {e.topic for e in self.graph.visitors}:
            raise ValueError(f"no visitor {name} in the group graph")
        keys = self.table().select("key", F.lit(meta).cast("string").cast("binary").alias("value"), F.col("key").alias("seq"))
        start = max(self.topics.get_offset(t) for t in [*self.graph.copartitioned(), self._visits(name)])
        end = self.topics.append(self._visits(name), keys, start=start)
        self.run_available()
        return end - start

    def stop(self) -> None:
        for q in self.spark.streams.active:
            if q.name and q.name.endswith(self.graph.group.replace("-", "_")):
                q.stop()
        self.signal.set_state(STOPPED)


def restarting(run, backoff, reset: float = 60.0, tries: int = 10):
    """Calls ``run`` until it returns; waits between failures as ``backoff`` says, from anew after a long good run."""
    for i in range(tries):
        began = time.monotonic()
        try:
            return run()
        except Exception:
            if i == tries - 1:
                raise
            if time.monotonic() - began > reset:
                backoff.reset()
            time.sleep(backoff.duration())
    return None
