"""The opaque path: callbacks over keyed state, in batch and in micro-batches.

A callback gets a :class:`Context` and a decoded message, as often as there are
messages, in order, key by key.  Rows go in as one tagged stream per key
(table preset, join-table change, message, visit) and come out tagged (table
change, output, loop-back).  Declarative operators should be preferred; this
is for logic they can't say.

In batch, rows are sorted within partitions and read one after the other: no
key's rows are ever held together.  In streams, ``transformWithState`` keeps
the table; a key's rows of one micro-batch are sorted before they are handled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.functions.codec import Codec
from rillflow.functions.partition import partition_of
from rillflow.plans.graph import GroupGraph, Join
from rillflow.plans.options import ProcessorOptions
from rillflow.sources.envelope import NIL_DECODE, NIL_IGNORE

PRESET, CHANGE, MESSAGE, VISIT = range(4)
IN = "kind int, topic string, key string, offset long, timestamp timestamp, value binary, headers map<string,binary>, partition int"
OUT = "kind string, topic string, key string, value binary, headers map<string,binary>, offset long, seq int, source string"
TABLE, OUTPUT, LOOP, FINAL = "table", "output", "loop", "final"
LOOKUP_ROWS = 1_000_000


class ProcessingError(RuntimeError):
    """A callback failed; the message names topic, key and offset."""


@dataclass
class Context:
    """What a callback sees of one message, and what it may do."""

    graph: GroupGraph
    options: ProcessorOptions
    key: str
    topic: str
    offset: int
    timestamp: datetime | None
    headers: dict[str, bytes]
    partition: int = 0
    _state: list = field(default_factory=lambda: [None])
    _joins: dict = field(default_factory=dict)
    _lookups: dict = field(default_factory=dict)
    _out: list = field(default_factory=list)

    @property
    def group(self) -> str:
        return self.graph.group

    def _table(self) -> Codec:
        if not self.graph.group_table:
            raise ProcessingError("stateless group has no value")
        return self.graph.group_table.codec

    def value(self) -> object | None:
        codec = self._table()
        return None if self._state[0] is None else codec.loads(self._state[0])

    def set_value(self, value: object, headers: dict[str, bytes] | None = None) -> None:
        codec = self._table()
        if value is None:
            raise ProcessingError("a value can't be set to None; use delete()")
        self._state[0] = codec.dumps(value)
        self._add(TABLE, self.graph.group_table.topic, self.key, self._state[0], headers)

    def delete(self, headers: dict[str, bytes] | None = None) -> None:
        self._table()
        self._state[0] = None
        self._add(TABLE, self.graph.group_table.topic, self.key, None, headers)

    def emit(self, topic: str, key: str, value: object, headers: dict[str, bytes] | None = None) -> None:
        """None is emitted as a tombstone, without the codec."""
        if not topic:
            raise ProcessingError("can't emit to an empty topic")
        if self.graph.loop_stream and topic == self.graph.loop_stream.topic:
            raise ProcessingError("can't emit to the loop stream; use loopback()")
        if self.graph.group_table and topic == self.graph.group_table.topic:
            raise ProcessingError("can't emit to the group table; use set_value()")
        codec = next((e.codec for e in self.graph.output_streams if e.topic == topic), None)
        if codec is None:
            raise ProcessingError(f"no output {topic} in the group graph")
        self._add(OUTPUT, topic, key, None if value is None else codec.dumps(value), {**self.options.default_headers, **(headers or {})})

    def loopback(self, key: str, value: object, headers: dict[str, bytes] | None = None) -> None:
        loop = self.graph.loop_stream
        if loop is None:
            raise ProcessingError("no loop stream in the group graph")
        self._add(LOOP, loop.topic, key, loop.codec.dumps(value), {**self.options.default_headers, **(headers or {})})

    def join(self, table: str) -> object | None:
        edge = next((e for e in self.graph.joint_tables if e.topic == table), None)
        if edge is None:
            raise ProcessingError(f"table {table} is not joined by the group graph")
        data = self._joins.get(table)
        return None if data is None else edge.codec.loads(data)

    def lookup(self, table: str, key: str) -> object | None:
        edge = next((e for e in self.graph.lookup_tables if e.topic == table), None)
        if edge is None:
            raise ProcessingError(f"table {table} is not looked up by the group graph")
        data = self._lookups.get(table, {}).get(key)
        return None if data is None else edge.codec.loads(data)

    def fail(self, error: object) -> None:
        raise ProcessingError(str(error))

    def _add(self, kind: str, topic: str, key: str, value: bytes | None, headers: dict[str, bytes] | None) -> None:
        self._out.append((kind, topic, key, value, headers or None))


class KeyRun:
    """One key's rows through the callbacks; ``state`` is the key's table value."""

    def __init__(self, graph: GroupGraph, options: ProcessorOptions, lookups: dict[str, dict[str, bytes]]):
        self.graph, self.options, self.lookups = graph, options, lookups
        self.callbacks = graph.callbacks()
        self.visitors = {e.topic: e.callback for e in graph.visitors}
        self.tables = {e.topic for e in graph.joint_tables}
        self.state: list[bytes | None] = [None]
        self.joins: dict[str, bytes | None] = {}

    def start(self, state: bytes | None, joins: dict[str, bytes | None] | None = None) -> None:
        self.state, self.joins = [state], dict(joins or {})

    def row(self, kind: int, topic: str, key: str, offset: int, timestamp: datetime | None, value: bytes | None, headers: dict | list | None, partition: int | None = 0) -> list[tuple]:
        update = self.options.update_callback
        if kind == PRESET:
            self.state[0] = update(self.graph.group_table.topic, key, self.state[0], value) if update else value
            return []
        if kind == CHANGE:
            self.joins[topic] = update(topic, key, self.joins.get(topic), value) if update else value
            return []
        context = Context(self.graph, self.options, key, topic, offset, timestamp, dict(headers or {}), partition or 0, _state=self.state, _joins=self.joins, _lookups=self.lookups)
        try:
            if kind == VISIT:
                if self.state[0] is None:
                    return []
                message, callback = (value.decode() if value is not None else None), self.visitors[topic]
            else:
                codec, callback = self.callbacks[topic]
                if value is None and self.options.nil_handling == NIL_IGNORE:
                    return []
                message = codec.loads(value) if value is not None or self.options.nil_handling == NIL_DECODE else None
            own = self.options.context_wrapper(context) if self.options.context_wrapper else context
            callback(own, message)
        except Exception as e:
            raise ProcessingError(f"error processing message from topic {topic}, key {key}, offset {offset}: {e}") from e
        return [(*x, offset, i, f"{key}\t{topic}") for i, x in enumerate(context._out)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.binary()), pa.int64(), pa.int32(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    cols = [[None if v is None else list(v.items()) for v in c] if i == 4 else list(c) for i, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "topic", "key", "value", "headers", "offset", "seq", "source"])


def _lookup_rows(tables: dict[str, DataFrame] | None) -> dict[str, dict[str, bytes]]:
    """Replicated tables (key, value) for the callbacks; their size is checked."""
    out = {}
    for name, df in (tables or {}).items():
        rows = df.select("key", "value").limit(LOOKUP_ROWS + 1).collect()
        if len(rows) > LOOKUP_ROWS:
            raise ValueError(f"table {name} has more than {LOOKUP_ROWS} rows: too many for callbacks; use the declarative lookup")
        out[name] = {r.key: None if r.value is None else bytes(r.value) for r in rows}
    return out


def run_batch(graph: GroupGraph, messages: DataFrame, options: ProcessorOptions | None = None, table: DataFrame | None = None, join_changes: DataFrame | None = None, lookups: dict[str, DataFrame] | None = None, visits: DataFrame | None = None) -> DataFrame:
    """One pass over all messages; tagged rows out, with each key's last value as kind ``final``.

    ``messages`` and ``join_changes`` are envelopes; ``table`` presets (key,
    value); ``visits`` has (topic, key, offset, value).
    """
    graph.validate()
    options = options or ProcessorOptions()
    known = messages.sparkSession.sparkContext.broadcast(_lookup_rows(lookups))
    none = F.lit(None).cast("timestamp")

    def tagged(df: DataFrame, kind: int) -> DataFrame:
        has = set(df.columns)
        col = lambda c, otherwise: F.col(c) if c in has else otherwise
        partition = partition_of(F.col("key"), options.partitions, options.hasher)
        return df.select(F.lit(kind).alias("kind"), col("topic", F.lit("")).alias("topic"), "key", col("offset", F.lit(-1)).cast("long").alias("offset"), col("timestamp", none).cast("timestamp").alias("timestamp"), "value", col("headers", F.lit(None)).cast("map<string,binary>").alias("headers"), col("partition", partition).cast("int").alias("partition"))

    parts = [tagged(messages, MESSAGE)]
    parts += [tagged(df, k) for df, k in ((table, PRESET), (join_changes, CHANGE), (visits, VISIT)) if df is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = F.when(F.col("kind") == PRESET, F.lit(-(2**62))).otherwise(F.col("offset"))
    ranks = {e.topic: i for i, e in enumerate(graph.input_streams)}
    rank = F.coalesce(*[F.when(F.col("topic") == t, F.lit(i)) for t, i in ranks.items()], F.lit(len(ranks)))
    rows = rows.withColumns({"_o": order, "_r": rank}).repartition("key").sortWithinPartitions("key", "_o", "kind", "_r").drop("_o", "_r")

    def handle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = KeyRun(graph, options, known.value), None
        for b in it:
            out = []
            for kind, topic, key, offset, timestamp, value, headers, partition in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None or key != last[0]:
                    if last is not None and run.state[0] is not None:
                        out.append((FINAL, "", last[0], run.state[0], None, last[1], 0, last[0]))
                    run.start(None)
                last = (key, offset)
                out += run.row(kind, topic, key, offset, timestamp, value, headers, partition)
            yield _batch(out)
        if last is not None and run.state[0] is not None:
            yield _batch([(FINAL, "", last[0], run.state[0], None, last[1], 0, last[0])])

    return rows.mapInArrow(handle, OUT)


def run_until_quiet(graph: GroupGraph, messages: DataFrame, options: ProcessorOptions | None = None, table: DataFrame | None = None, rounds: int = 1000, join_changes: DataFrame | None = None, lookups: dict[str, DataFrame] | None = None, visits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the group and feeds loop-backs in again until none is left: (all outputs and table changes, final table).

    Visits and changes of joined tables belong to the first round; later ones
    see the joined tables as these left them.  A round's messages are the loop-backs
    of the one before, numbered from 0 in the order in which they were sent.
    """
    from rillflow.sources.topics import materialised, numbered

    done = None
    for i in range(rounds):
        out = materialised(run_batch(graph, messages, options, table, join_changes, lookups, visits))
        some = out.filter(F.col("kind").isin(OUTPUT, TABLE)).withColumn("round", F.lit(i))
        done = some if done is None else done.unionByName(some)
        if i % 50 == 49:
            done = materialised(done)  # a plan of as many parts as there were rounds is slow to read
        table = out.filter(F.col("kind") == FINAL).select("key", "value")
        loops = out.filter(F.col("kind") == LOOP)
        if loops.isEmpty():
            return done, table
        if i == 0 and join_changes is not None:
            last = join_changes.groupBy("topic", "key").agg(F.max_by(F.struct("value"), F.col("offset")).alias("last"))
            join_changes = materialised(last.select("topic", "key", F.lit(-1).cast("long").alias("offset"), "last.value"))
        visits = None
        messages, _ = numbered(loops.select("topic", F.col("key").alias("_to"), "value", "headers", "offset", "seq", "source"), F.struct("offset", "source", "seq"))
        messages = messages.select("topic", F.col("_to").alias("key"), F.col("_number").alias("offset"), "value", "headers")
    raise ProcessingError(f"the loop did not come to rest in {rounds} rounds")


class KeyedState(StatefulProcessor):
    """The group table as a value state; joined tables as a map state."""

    def __init__(self, graph: GroupGraph, options: ProcessorOptions, lookups: dict[str, dict[str, bytes]]):
        self.graph, self.options, self.lookups = graph, options, lookups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getValueState("table", "value binary", self.options.state_ttl_ms)
        self.joined = handle.getMapState("joined", "topic string", "value binary", self.options.state_ttl_ms)
        self.run = KeyRun(self.graph, self.options, self.lookups)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.table.get() if self.table.exists() else None
        before = None if had is None or had[0] is None else bytes(had[0])
        names = [e.topic for e in self.graph.joint_tables]
        joins = {n: bytes(self.joined.getValue((n,))[0]) for n in names if self.joined.containsKey((n,))}
        self.run.start(before, joins)
        ranks = {e.topic: i for i, e in enumerate(self.graph.input_streams)}
        out = []
        for r in sorted(rows, key=lambda r: (r.offset, r.kind, ranks.get(r.topic, len(ranks)))):
            value = None if r.value is None else bytes(r.value)
            out += self.run.row(r.kind, r.topic, r.key, r.offset, r.timestamp, value, r.headers, r.partition)
        after = self.run.state[0]
        if after is None:
            self.table.clear()
        elif after != before:
            self.table.update((after,))
        for n, v in self.run.joins.items():
            if v is None:
                if self.joined.containsKey((n,)):
                    self.joined.removeKey((n,))
            elif v != joins.get(n):
                self.joined.updateValue((n,), (v,))
        for kind, topic, k, value, headers, offset, seq, source in out:
            yield Row(kind=kind, topic=topic, key=k, value=value, headers=headers, offset=offset, seq=seq, source=source)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.table.update((bytes(initialState.value),))

    def close(self) -> None:
        pass


def stream_state(graph: GroupGraph, rows: DataFrame, options: ProcessorOptions | None = None, lookups: dict[str, DataFrame] | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Tagged rows of a streaming (or batch) table of rows as in ``IN``; the table lives in the state store."""
    graph.validate()
    state = KeyedState(graph, options or ProcessorOptions(), _lookup_rows(lookups))
    more = {"initialState": initial.groupBy("key")} if initial is not None else {}
    return rows.groupBy("key").transformWithState(statefulProcessor=state, outputStructType=OUT, outputMode="Update", timeMode="None" if state.options.state_ttl_ms is None else "ProcessingTime", **more)


def stream_rows(graph: GroupGraph, messages: DataFrame) -> DataFrame:
    """Envelopes tagged for :func:`stream_state`: changes of joined tables, messages of all else."""
    names = [e.topic for e in graph.edges if type(e) is Join]
    kind = F.when(F.col("topic").isin(names), F.lit(CHANGE)).otherwise(F.lit(MESSAGE)) if names else F.lit(MESSAGE)
    return messages.select(kind.alias("kind"), "topic", "key", "offset", F.col("timestamp").cast("timestamp").alias("timestamp"), "value", "headers", "partition")


# --- a small ready-made group ----------------------------------------------


def count_handler(context: Context, message: object) -> None:
    context.set_value((context.value() or 0) + 1)


def run_state(messages: DataFrame, handler: Callable[[Context, object], None]) -> DataFrame:
    """The final table (key, value as text) of a group with an Int64 table and one input that takes nulls."""
    from rillflow.functions.codec import Bytes, Int64
    from rillflow.plans.graph import Input, Persist, define_group
    from rillflow.sources.envelope import NIL_PROCESS

    graph = define_group("state", Input("input", Bytes(), handler), Persist(Int64()))
    rows = run_batch(graph, messages.withColumn("topic", F.lit("input")), ProcessorOptions(nil_handling=NIL_PROCESS))
    return rows.filter(F.col("kind") == FINAL).select("key", F.decode("value", "UTF-8").alias("value"))


__all__ = ["Context", "KeyRun", "ProcessingError", "ProcessorOptions", "count_handler", "run_batch", "run_state", "run_until_quiet", "stream_rows", "stream_state"]
