import pytest
from pyspark.sql import functions as F

from rillflow.functions import headers
from rillflow.functions.codec import Bytes, Int64, Json, String
from rillflow.functions.partition import fnv1a, partition_of
from rillflow.operators.assignment import copartition_plan
from rillflow.operators.table import compact
from rillflow.operators.view import TableView


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_hash(spark):
    keys = ["", "key1", "key2", "a", "é", "日本", "x" * 50]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fnv1a(F.col("k")).alias("h"), partition_of(F.col("k"), 7).alias("p")).collect()
    for r in rows:
        h = fnv(r.k.encode())
        assert r.h == h
        assert r.p == abs(h - 2**32 if h >= 2**31 else h) % 7
    assert fnv(b"key1") == 927623783 and fnv(b"key2") == 944401402


def test_headers(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3', 'c', '4') as y, cast(null as map<string,string>) as z")
    r = df.select(headers.merged(F.col("x"), F.col("y")).alias("m"), headers.merged(F.col("z"), F.col("z")).alias("n"), headers.merged(F.col("z"), F.col("x")).alias("o"), F.col("x").alias("x")).first()
    assert r.m == {"a": "1", "b": "3", "c": "4"} and r.n is None and r.o == r.x == {"a": "1", "b": "2"}


def test_codecs(spark):
    assert Int64().dumps(-12) == b"-12" and Int64().loads(b"-12") == -12
    for codec, bad in ((Int64(), "x"), (String(), 1), (Bytes(), "x"), (Int64(), True)):
        with pytest.raises(TypeError):
            codec.dumps(bad)
    with pytest.raises(ValueError):
        Int64().loads(b"a")
    df = spark.sql("select encode('{\"k\": 3}', 'UTF-8') as j, encode('17', 'UTF-8') as n")
    r = df.select(Json("k int").decode(F.col("j")).alias("j"), Int64().decode(F.col("n")).alias("n")).first()
    assert r.j.k == 3 and r.n == 17
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.sql("select encode('x', 'UTF-8') as n").select(Int64().decode(F.col("n"))).collect()


def test_copartition_plan(spark):
    subs = spark.createDataFrame([("M1", "T1"), ("M1", "T2"), ("M2", "T2")], "member string, topic string")
    topics = spark.createDataFrame([("T1", 3), ("T2", 3)], "topic string, partitions int")
    got = {(r.member, r.topic, r.partition) for r in copartition_plan(subs, topics).collect()}
    assert got == {("M1", "T1", 0), ("M1", "T1", 1), ("M1", "T2", 0), ("M1", "T2", 1), ("M2", "T2", 2)}
    with pytest.raises(ValueError):
        copartition_plan(subs, topics, strict=True)
    with pytest.raises(ValueError):
        copartition_plan(subs, spark.createDataFrame([("T1", 3), ("T2", 4)], "topic string, partitions int"))


def test_tombstones_do_not_bring_keys_back(spark):
    log = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, None), ("b", 2, 7), ("é", 1, 1), ("z", 1, 2), ("Z", 1, 3)], "key string, offset long, value int")
    view = TableView(compact(log))
    assert [r.key for r in view.iterate().collect()] == ["Z", "b", "z", "é"]
    assert view.get_row("b").value == 7 and view.get_row("a") is None and view.has("z") and not view.has("a")
    assert [r.key for r in view.range("Z", "z").collect()] == ["Z", "b"]
    assert [r.key for r in view.range("", "").collect()] == ["Z", "b", "z", "é"]
    assert [r.key for r in view.seek("c").collect()] == ["z", "é"]
    assert not view.evict(spark.createDataFrame([("z",)], "key string")).has("z")


def test_package_is_sent_once(spark):
    from rillflow.ship import ship

    ship(spark)
    sent = list(spark.sparkContext.listArchives) + list(spark.sparkContext._python_includes)
    ship(spark)
    assert [x for x in sent if "rillflow" in x] and list(spark.sparkContext.listArchives) + list(spark.sparkContext._python_includes) == sent
