"""A stream cut into any micro-batches gives what the batch gives; sinks."""

import os
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.functions.codec import Int64
from rillflow.operators import fold, joins
from rillflow.plans.graph import Input, Join, Output, Persist, define_group
from rillflow.plans.options import ProcessorOptions
from rillflow.sources import sinks
from rillflow.sources.topics import TopicManager
from rillflow.streaming.processor import FINAL, OUTPUT, run_batch
from rillflow.streaming.runner import StreamProcessor


def handle(ctx, msg):
    if msg < 0:
        ctx.delete()
        return
    ctx.set_value((ctx.value() or 0) + msg)
    ctx.emit("out", ctx.key, ctx.value() * 1000 + (ctx.join("limits") or 0))


GRAPH = define_group("grp", Input("nums", Int64(), handle), Join("limits", Int64()), Persist(Int64()), Output("out", Int64()))
MESSAGES = [(f"k{i * 7 % 4}", (i * 13) % 11 - 2) for i in range(24)]


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 23), min_size=1, max_size=2, unique=True))
def test_any_micro_batches_equal_the_batch(spark, tmp_path_factory, cuts):
    root = tmp_path_factory.mktemp("stream")
    topics = TopicManager(spark, f"file://{root}/topics")
    edges = [0, *sorted(cuts), len(MESSAGES)]
    run = StreamProcessor(GRAPH, topics, f"file://{root}/cp", ProcessorOptions(partitions=8))
    topics.append("limits", spark.createDataFrame([(0, "k1", b"5"), (1, "k2", b"6")], "seq int, key string, value binary"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        rows = [(i, k, str(v).encode()) for i, (k, v) in enumerate(MESSAGES[lo:hi])]
        topics.append("nums", spark.createDataFrame(rows, "seq int, key string, value binary"))
        run.run_available()
    batch = run_batch(GRAPH, topics.read("nums"), join_changes=topics.read("limits").withColumn("offset", F.lit(-1)))
    table = {r.key: int(bytes(r.value)) for r in batch.filter(F.col("kind") == FINAL).collect()}
    assert {r.key: r.value for r in run.table().collect()} == table
    want = sorted((r.key, r.offset, bytes(r.value)) for r in batch.filter(F.col("kind") == OUTPUT).collect())
    got = topics.read("out").orderBy("offset").collect()
    assert sorted((r.key, bytes(r.value)) for r in got) == sorted((k, v) for k, _, v in want)
    for key in {k for k, _, _ in want}:
        assert [bytes(r.value) for r in got if r.key == key] == [v for k, _, v in want if k == key]


class FileStore:
    def __init__(self, path):
        self.path = path

    def get(self, key):
        path = os.path.join(self.path, key)
        return open(path, "rb").read() if os.path.exists(path) else None

    def set(self, key, value):
        with open(os.path.join(self.path, key), "wb") as f:
            f.write(value)

    def delete(self, key):
        if os.path.exists(os.path.join(self.path, key)):
            os.remove(os.path.join(self.path, key))

    def close(self):
        pass


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, b"x"), ("a", 2, b"y"), ("b", 1, b"z"), ("b", 2, None)], "key string, offset long, value binary")
    sinks.append_text(rows.filter("value is not null"), f"file://{tmp_path}/text")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/text").collect()) == ["x", "y", "z"]
    sinks.discard(rows)
    (tmp_path / "store").mkdir()
    path = str(tmp_path / "store")
    (tmp_path / "store" / "b").write_bytes(b"old")
    sinks.write_store(rows, lambda: FileStore(path))
    assert os.listdir(path) == ["a"] and (tmp_path / "store" / "a").read_bytes() == b"y"
    assert sinks.namespaced("n", "t", 3) == "n:t:3"
    keys = spark.createDataFrame([("a",), ("zz",), ("a",), (None,)], "key string")
    assert [(r.key, bytes(r.value)) for r in sinks.read_store(keys, lambda: FileStore(path)).collect()] == [("a", b"y")]


def test_memory_table_of_a_stream(spark, tmp_path):
    topics = TopicManager(spark, f"file://{tmp_path}")
    topics.ensure_stream_exists("s", 2)
    topics.append("s", spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, value binary"))
    query = sinks.to_memory(topics.stream("s").select("key", "offset"), "in_memory").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("in_memory").collect()) == [("a", 0), ("b", 1)]


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from rillflow.sources import topics

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, otherwise: otherwise)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        topics.shared_folder(Cluster())


def test_bucketed_forms_keep_null_keys_and_orders(spark):
    rows = [(k, o, None if o == 7 or k == "c" else (o or 5) * 3) for k in ("a", None, "c") for o in (None, 0, 3, 7, 12, 31)]
    df = spark.createDataFrame(rows, "key string, offset long, v long")
    counted = lambda x: Counter(tuple(r) for r in x.select("key", "offset", "value").collect())
    want = counted(df.withColumn("value", fold.running_sum(F.col("v"), fold.history())))
    assert counted(fold.running_sum_in_buckets(df, F.col("v"), 10)) == want and sum(want.values()) == len(rows)
    changelog = spark.createDataFrame([("a", None, 1), (None, None, 2), (None, 12, None), ("c", 3, 4), ("c", 30, 5)], "key string, offset long, value long")
    counted = lambda x: Counter(tuple(r) for r in x.collect())
    want = counted(joins.join_asof(df, changelog))
    assert counted(joins.join_asof_in_buckets(df, changelog, 10)) == want and sum(want.values()) == len(rows)
