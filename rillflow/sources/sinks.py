"""Where results go besides topics: text files, nowhere, memory tables, external key-value stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


class Store(Protocol):
    """An external key-value store, e.g. a Redis hash; opened once per partition."""

    def get(self, key: str) -> bytes | None: ...

    def set(self, key: str, value: bytes) -> None: ...

    def delete(self, key: str) -> None: ...

    def close(self) -> None: ...


def append_text(messages: DataFrame, path: str) -> None:
    """One line per value; keys are dropped, and nothing reads the files back as a table."""
    messages.select(F.decode("value", "UTF-8").alias("value")).write.mode("append").text(path)


def discard(rows: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()


def to_memory(rows: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """A stream into a table of the session, for tests and small results."""
    return rows.writeStream.format("memory").queryName(name).outputMode(mode)


def write_store(changes: DataFrame, open_store: Callable[[], Store]) -> None:
    """Applies the last change per key (null deletes): keys are independent, so a retried task repeats itself harmlessly."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), F.col("offset")).alias("last")).select("key", "last.value")

    def apply(rows) -> None:
        store = open_store()
        try:
            for r in rows:
                if r.value is None:
                    store.delete(r.key)
                else:
                    store.set(r.key, bytes(r.value))
        finally:
            store.close()

    last.foreachPartition(apply)


def read_store(keys: DataFrame, open_store: Callable[[], Store]) -> DataFrame:
    """(key, value) for a table of keys, as the store has them; keys that it lacks are left out."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store()
        try:
            for b in batches:
                found = [(k, store.get(k)) for k in b.column("key").to_pylist()]
                found = [(k, v) for k, v in found if v is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], ["key", "value"])
        finally:
            store.close()

    return keys.select("key").filter("key is not null").distinct().mapInArrow(look_up, "key string, value binary")


def namespaced(namespace: str, topic: str, partition: int) -> str:
    """The name of a table partition's hash in an external store."""
    return f"{namespace}:{topic}:{partition}"
