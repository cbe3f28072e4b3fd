"""Emitters: producers into one topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.codec import Codec
from rillflow.plans.options import EmitterOptions
from rillflow.sources.topics import TopicManager
from rillflow.streaming.signal import Promise


class EmitterClosed(RuntimeError):
    pass


class Emitter:
    """Single messages are buffered and appended by ``flush``; whole tables go straight to the topic."""

    def __init__(self, topics: TopicManager, topic: str, codec: Codec, options: EmitterOptions | None = None):
        self.topics, self.topic, self.codec, self.options = topics, topic, codec, options or EmitterOptions()
        self._waiting: list[tuple[str, bytes | None, dict | None, Promise]] = []
        self._closed = False
        topics.ensure_stream_exists(topic, self.options.partitions)

    def emit(self, key: str, message: object, headers: dict[str, bytes] | None = None) -> Promise:
        promise = Promise()
        if self._closed:
            return promise.finish(EmitterClosed("emitter is finished"))
        value = None if message is None else self.codec.dumps(message)
        self._waiting.append((key, value, {**self.options.default_headers, **(headers or {})} or None, promise))
        return promise

    def emit_sync(self, key: str, message: object, headers: dict[str, bytes] | None = None) -> None:
        promise = self.emit(key, message, headers)
        self.flush()
        if promise.error:
            raise promise.error

    def flush(self) -> None:
        batch, self._waiting = self._waiting, []
        if not batch:
            return
        try:
            rows = [(i, k, v, h) for i, (k, v, h, _) in enumerate(batch)]
            self.topics.append(self.topic, self.topics.spark.createDataFrame(rows, "seq long, key string, value binary, headers map<string,binary>"), hasher=self.options.hasher)
        except Exception as e:
            for *_, p in batch:
                p.finish(e)
            return
        for *_, p in batch:
            p.finish()

    def emit_table(self, df: DataFrame) -> int:
        """Appends (key, value typed as the codec's); the next offset."""
        if self._closed:
            raise EmitterClosed("emitter is finished")
        return self.topics.append(self.topic, df.withColumn("value", self.codec.encode(F.col("value"))), hasher=self.options.hasher)

    def finish(self) -> None:
        self._closed = True
        self.flush()

    def __enter__(self) -> Emitter:
        return self

    def __exit__(self, *_) -> None:
        self.finish()
