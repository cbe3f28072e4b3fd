"""Views of a group table by name: load, follow, read, evict, reconnect."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rillflow.functions.codec import Codec
from rillflow.functions.partition import partition_of
from rillflow.operators.stats import recovery_stats
from rillflow.operators.view import TableView
from rillflow.plans.options import ViewOptions
from rillflow.sources.topics import TopicManager, materialised
from rillflow.streaming.runner import restarting
from rillflow.streaming.signal import Observer, Signal

STOPPED, INITIALIZING, CONNECTING, RECOVERING, PREPARING, RUNNING = range(6)
FOLD = 16


class View:
    """Loads a table topic, serves it and follows it; while it reconnects, what it has loaded is still served.

    Held as a base (last change per key, sorted by key, so that a read of one
    key touches few row groups) and the changes of later refreshes; a refresh
    reads only what was appended since, and every ``FOLD`` refreshes the
    changes are folded into a new base.  With an ``update_callback`` (an
    aggregate over a key's changes) a refresh reads the whole topic, as such a
    reducer need not take its own results.
    """

    def __init__(self, topics: TopicManager, table: str, codec: Codec, options: ViewOptions | None = None):
        self.topics, self.topic, self.codec, self.options = topics, table, codec, options or ViewOptions()
        self.signal = Signal(STOPPED, INITIALIZING, CONNECTING, RECOVERING, PREPARING, RUNNING)
        self.error: Exception | None = None
        self._base: DataFrame | None = None
        self._later: list[DataFrame] = []
        self._gone: dict[str, int] = {}
        self._next = 0
        self._moved = time.monotonic()
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    @property
    def offset(self) -> int:
        """The last offset that the view knows; -1 before any."""
        return self._next - 1

    def _last(self, rows: DataFrame) -> DataFrame:
        """partition, key, value (bytes), offset of each key's last change; tombstones stay."""
        return rows.groupBy("key").agg(F.max_by(F.struct("value", "partition"), F.col("offset")).alias("m"), F.max("offset").alias("offset")).select("m.partition", "key", "m.value", "offset")

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return materialised(rows.repartitionByRange("key").sortWithinPartitions("key"))

    def _load(self) -> None:
        self.signal.set_state(CONNECTING if self._base is None else self.signal.state)
        end = self.topics.get_offset(self.topic)
        if self._base is not None and end <= self._next:
            return
        if self._base is None:
            self.signal.set_state(RECOVERING)
        if self.options.update_callback:
            log = self.topics.read(self.topic).filter(F.col("offset") < end)
            rows = log.groupBy("key").agg(self.options.update_callback().alias("value"), F.max("offset").alias("offset"), F.first("partition").alias("partition"))
            self._base, self._later = self._sorted(rows.select("partition", "key", "value", "offset")), []
        else:
            new = self._last(self.topics.read(self.topic, self._next).filter(F.col("offset") < end))
            if self._base is None:
                self._base = self._sorted(new.filter(F.col("value").isNotNull()))
            else:
                self._later.append(materialised(new))
            if len(self._later) >= FOLD:
                self._base, self._later = self._sorted(self._known().filter(F.col("value").isNotNull())), []
        self._next, self._moved = end, time.monotonic()

    def run(self) -> View:
        """Loads up to the newest change, or what is new since the last time; again with ``auto_reconnect`` where that fails."""
        if self._base is None:
            self.signal.set_state(INITIALIZING)
            self.options.logger.info("view of %s: loading", self.topic)
        restarting(self._load, self.options.backoff(), self.options.backoff_reset) if self.options.auto_reconnect else self._load()
        self.signal.set_state(RUNNING)
        return self

    refresh = run

    def follow(self, every: float = 1.0) -> View:
        """Refreshes in a thread of its own until :meth:`stop`; after a failure it reconnects with the options' backoff, or ends."""
        self.run()
        self._stop.clear()
        backoff = self.options.backoff()

        def keep_on() -> None:
            while not self._stop.wait(every):
                try:
                    self._load()
                    self.error = None
                    self.signal.set_state(RUNNING)
                    backoff.reset()
                except Exception as e:
                    self.error = e
                    self.options.logger.warning("view of %s: %s", self.topic, e)
                    if not self.options.auto_reconnect:
                        self.signal.set_state(STOPPED)
                        return
                    self.signal.set_state(CONNECTING)
                    self._stop.wait(backoff.duration())

        self._thread = threading.Thread(target=keep_on, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        self.signal.set_state(STOPPED)

    def wait_running(self, timeout: float | None = None) -> bool:
        return self.signal.wait_for_state(RUNNING, timeout)

    def _known(self) -> DataFrame:
        """Last change per key over base and later changes, but for evicted ones."""
        if self._base is None:
            raise RuntimeError("view has not been loaded")
        rows = self._base
        for x in self._later:
            rows = rows.unionByName(x)
        if self._later:
            rows = self._last(rows)
        if self._gone:
            gone = self.topics.spark.createDataFrame(list(self._gone.items()), "key string, until long")
            rows = rows.join(gone, "key", "left").filter(F.col("until").isNull() | (F.col("offset") > F.col("until"))).drop("until")
        return rows

    def table(self) -> DataFrame:
        """(key, value)."""
        value = F.col("value") if self._reduced() else self.codec.decode(F.col("value"))
        return self._known().filter(F.col("value").isNotNull()).select("key", value.alias("value"))

    def _reduced(self) -> bool:
        """Whether values are a reducer's results, of a type of their own."""
        return self._base is not None and self._base.schema["value"].dataType.simpleString() != "binary"

    def partition(self, key: str) -> int:
        """The partition that holds a key, by the options' hash."""
        n = len(self.topics.partitions(self.topic))
        return self.topics.spark.range(1).select(partition_of(F.lit(key), n, self.options.hasher)).first()[0]

    def get(self, key: str) -> object | None:
        row = TableView(self.table()).get_row(key)
        return None if row is None else row.value

    def has(self, key: str) -> bool:
        return TableView(self.table()).has(key)

    def iterate(self) -> DataFrame:
        return TableView(self.table()).iterate()

    def rows(self) -> Iterator[Row]:
        """A cursor in the order of keys."""
        return TableView(self.table()).rows()

    def range(self, start: str, limit: str = "") -> DataFrame:
        return TableView(self.table()).range(start, limit)

    def seek(self, key: str) -> DataFrame:
        return TableView(self.table()).seek(key)

    def evict(self, key: str) -> None:
        """Hides a key until its next change."""
        self._gone[key] = self.offset

    @property
    def recovered(self) -> bool:
        return self.signal.state == RUNNING

    def observe(self) -> Observer:
        return self.signal.observe()

    def stats(self, stall_after: float = 120.0) -> dict:
        """State, offset and, per partition, rows, bytes, last offset and lag behind the topic; stalled: behind, and still for ``stall_after`` seconds."""
        end = self.topics.get_offset(self.topic)
        out = {"table": self.topic, "state": self.signal.state, "offset": self.offset, "hwm": end, "lag": max(0, end - self._next)}
        out["stalled"] = out["lag"] > 0 and time.monotonic() - self._moved > stall_after
        if self._base is not None:
            rows = recovery_stats(self.topics.read(self.topic), F.lit(self._next))
            out["partitions"] = {r.partition: {"count": r.count_, "bytes": r.bytes, "last_offset": r.last_offset, "lag": r.lag} for r in rows.withColumnRenamed("count", "count_").collect()}
        return out
