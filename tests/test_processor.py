import time

import pytest
from pyspark.sql import functions as F

from rillflow.functions.codec import Int64, String
from rillflow.functions.partition import partition_number
from rillflow.plans.graph import Input, Join, Lookup, Loop, Output, Persist, Visitor, define_group
from rillflow.plans.options import NEWEST, Backoff, EmitterOptions, ProcessorOptions, ViewOptions
from rillflow.sources.emitter import Emitter, EmitterClosed
from rillflow.sources.topics import FAIL, TopicManager
from rillflow.streaming.processor import FINAL, OUTPUT, run_batch, run_until_quiet
from rillflow.streaming.runner import StreamProcessor
from rillflow.streaming.serve import Action, Pages
from rillflow.streaming.signal import Promise, Signal
from rillflow.streaming.testing import Tester
from rillflow.streaming.view import View


def add(ctx, msg):
    ctx.set_value((ctx.value() or 0) + msg)


def test_tester_scenarios():
    t = Tester()
    g = define_group("sum", Input("in", Int64(), add), Persist(Int64()))
    t.register(g)
    t.set_table_value("sum-table", "value", 10)
    t.consume("in", "value", 2)
    assert t.table_value("sum-table", "value") == 12 and t.table_keys("sum-table") == ["value"]
    t.consume("in", "value", None)
    assert t.table_value("sum-table", "value") == 12
    t.clear_values()
    assert t.table_value("sum-table", "value") is None

    t = Tester()
    chain = define_group("p1", Input("input", String(), lambda c, m: c.loopback(c.key, "loop: " + m)), Loop(String(), lambda c, m: c.emit("proc1-out", c.key, "proc1-out: " + m)), Output("proc1-out", String()))
    t.register(chain)
    t.register(define_group("p2", Input("proc1-out", String(), lambda c, m: c.set_value("persist: " + m)), Persist(String())))
    q = t.tracker("proc1-out")
    t.consume("input", "bob", "hello world")
    assert t.table_value("p2-table", "bob") == "persist: proc1-out: loop: hello world"
    assert q.next() == ("bob", "proc1-out: loop: hello world") and q.next() is None and q.hwm() == q.next_offset() == 1


def test_tester_headers_visits_and_errors():
    t = Tester()

    def visit(ctx, meta):
        ctx.emit("out", ctx.key, int(meta))
        ctx.set_value(int(meta))

    g = define_group("g", Input("in", Int64(), add), Persist(Int64()), Visitor("reset", visit), Output("out", Int64()))
    t.register(g, ProcessorOptions(default_headers={"h": b"1", "d": b"0"}))
    t.set_table_value("g-table", "a", 123)
    q = t.tracker("out")
    assert t.visit(g, "reset", "15") == 1 and q.next_with_headers() == ({"h": b"1", "d": b"0"}, "a", 15) and t.table_value("g-table", "a") == 15
    with pytest.raises(ValueError):
        t.visit(g, "other")
    bad = {
        "empty topic": lambda c, m: c.emit("", "k", 1), "no output": lambda c, m: c.emit("zzz", "k", 1), "use set_value": lambda c, m: c.emit("e-table", "k", 1), "no loop": lambda c, m: c.loopback("k", 1),
        "not joined": lambda c, m: c.join("x"), "not looked up": lambda c, m: c.lookup("x", "k"), "use delete": lambda c, m: c.set_value(None), "boom": lambda c, m: c.fail("boom"), "division": lambda c, m: 1 // 0,
    }
    for message, callback in bad.items():
        t = Tester()
        t.register(define_group("e", Input("in", Int64(), callback), Persist(Int64())))
        with pytest.raises(RuntimeError, match=f"error processing message.*{message}"):
            t.consume("in", "k", 1)
    t = Tester()
    t.register(define_group("s", Input("in", Int64(), lambda c, m: c.set_value(1))))
    with pytest.raises(RuntimeError, match="stateless"):
        t.consume("in", "k", 1)


def messages(spark, rows):
    return spark.createDataFrame(rows, "topic string, key string, offset long, value string").withColumn("value", F.encode("value", "UTF-8"))


def test_batch_run_with_join_lookup_and_loop(spark):
    def handle(ctx, msg):
        joined, found = ctx.join("limits") or 0, ctx.lookup("names", ctx.key) or "?"
        ctx.set_value((ctx.value() or 0) + msg)
        ctx.emit("out", ctx.key, f"{found}:{joined}:{ctx.value()}")
        if msg > 10:
            ctx.loopback("total", msg)

    g = define_group("g", Input("in", Int64(), handle), Loop(Int64(), add), Persist(Int64()), Join("limits", Int64()), Lookup("names", String()), Output("out", String()))
    rows = messages(spark, [("in", "a", 5, "1"), ("in", "a", 1, "20"), ("in", "b", 2, "30"), ("in", "a", 9, None)])
    changes = messages(spark, [("limits", "a", 3, "7"), ("limits", "a", 6, None)])
    names = spark.createDataFrame([("a", "Ann")], "key string, value string").withColumn("value", F.encode("value", "UTF-8"))
    out, table = run_until_quiet(g, rows, join_changes=changes, lookups={"names": names})
    got = {(r.key, r.offset, bytes(r.value).decode()) for r in out.filter(F.col("kind") == OUTPUT).collect()}
    assert got == {("a", 1, "Ann:0:20"), ("a", 5, "Ann:7:21"), ("b", 2, "?:0:30")}
    assert {r.key: int(bytes(r.value)) for r in table.collect()} == {"a": 21, "b": 30, "total": 50}
    with pytest.raises(Exception, match="error processing message"):
        run_batch(define_group("x", Input("in", Int64(), lambda c, m: 1 // 0)), rows).collect()


def test_batch_presets_and_visits(spark):
    g = define_group("g", Input("in", Int64(), add), Persist(Int64()), Visitor("reset", lambda c, m: c.set_value(int(m))))
    preset = spark.createDataFrame([("a", "10"), ("q", "4")], "key string, value string").withColumn("value", F.encode("value", "UTF-8"))
    visits = messages(spark, [("reset", "a", 3, "100"), ("reset", "zz", 3, "100")])
    rows = run_batch(g, messages(spark, [("in", "a", 1, "2"), ("in", "a", 5, "1")]), table=preset, visits=visits)
    assert {r.key: int(bytes(r.value)) for r in rows.filter(F.col("kind") == FINAL).collect()} == {"a": 101, "q": 4}


def test_stream_restart_loop_and_visit(spark, tmp_path):
    topics = TopicManager(spark, f"file://{tmp_path}/topics")

    def handle(ctx, msg):
        ctx.set_value((ctx.value() or 0) + msg)
        ctx.emit("out", ctx.key, msg * 2, {"from": ctx.key.encode()})
        if msg == 7:
            ctx.loopback("seven", 1)

    g = define_group("grp", Input("nums", Int64(), handle), Loop(Int64(), add), Persist(Int64()), Output("out", Int64()), Visitor("reset", lambda c, m: c.set_value(int(m))))
    options = ProcessorOptions(partitions=2)
    with Emitter(topics, "nums", Int64()) as e:
        e.options.partitions = 8
        for i in range(10):
            e.emit(f"k{i % 3}", i)
    with pytest.raises(EmitterClosed):
        e.emit_sync("k", 1)
    options = ProcessorOptions(partitions=8)
    run = StreamProcessor(g, topics, f"file://{tmp_path}/cp", options)
    run.run_available()
    want = {"k0": 0 + 3 + 6 + 9, "k1": 1 + 4 + 7, "k2": 2 + 5 + 8, "seven": 1}
    assert {r.key: r.value for r in run.table().collect()} == want
    out = topics.read("out")
    assert sorted(int(bytes(r.value)) for r in out.collect()) == [2 * i for i in range(10)] and out.filter("headers is not null").count() == 10
    assert sorted(r.offset for r in out.collect()) == list(range(10))
    StreamProcessor(g, topics, f"file://{tmp_path}/cp", options).run_available()
    assert topics.read("out").count() == 10
    view = View(topics, "grp-table", Int64()).run()
    assert {r.key: r.value for r in view.iterate().collect()} == want and view.get("seven") == 1 and not view.has("nope") and view.recovered
    view.evict("seven")
    assert not view.has("seven") and view.has("k0")
    assert view.partition("seven") == partition_number("seven", 8) and [r.key for r in view.rows()] == ["k0", "k1", "k2"]
    state = view.stats()
    assert state["lag"] == 0 and not state["stalled"] and sum(p["count"] for p in state["partitions"].values()) == state["hwm"] == 11
    stats = run.stats()
    assert sum(p["count"] for p in stats["inputs"]["nums"].values()) == 10 and stats["outputs"]["out"]["count"] == 10 and sum(p["count"] for p in stats["table"].values()) == 11 and run.wait_for_ready(1)
    run.visit_all("reset", "5")
    assert {r.key: r.value for r in run.table().collect()} == dict.fromkeys(want, 5) and run.get("k0").value == 5
    with pytest.raises(ValueError):
        run.visit_all("nothing")
    view.refresh()
    assert view.get("seven") == 5 and {r.key: r.value for r in view.iterate().collect()} == dict.fromkeys(want, 5)


def test_topics(spark, tmp_path):
    topics = TopicManager(spark, f"file://{tmp_path}", mismatch=FAIL)
    topics.ensure_table_exists("t", 3)
    assert topics.partitions("t") == [0, 1, 2] and topics.get_offset("t") == 0
    for call in (lambda: topics.ensure_table_exists("t", 4), lambda: topics.ensure_stream_exists("t", 3), lambda: TopicManager(spark, f"file://{tmp_path}", create=False).ensure_table_exists("u", 1), lambda: TopicManager(spark, "x", mismatch="y")):
        with pytest.raises(ValueError):
            call()
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, value binary")
    assert topics.append("t", rows) == 2 and topics.append("t", rows, tag="x") == 4 and topics.append("t", rows, tag="x") == 4
    assert topics.read("t").count() == 4 and topics.get_offset("t") == 4 and topics.get_offset("t", newest=False) == 0


def hop(ctx, n):
    ctx.set_value((ctx.value() or 0) + 1)
    if n:
        ctx.loopback(f"k{(int(ctx.key[1:]) + 1) % 5}", n - 1)


def test_fifty_hops_with_visits_and_joins_once(spark):
    """Offsets of any size; visits and changes of joined tables count in the first round only."""

    def handle(ctx, n):
        hop(ctx, n)
        ctx.emit("out", ctx.key, ctx.join("limits") or 0)

    g = define_group("g", Input("in", Int64(), handle), Loop(Int64(), handle), Persist(Int64()), Join("limits", Int64()), Output("out", Int64()), Visitor("add", lambda c, m: c.set_value(c.value() + int(m))))
    rows = messages(spark, [("in", "k0", 2**61, "50")])
    changes = messages(spark, [("limits", "k1", 3, "7"), ("limits", "k1", 2**62, "8")])
    preset = spark.createDataFrame([("k0", "3")], "key string, value string").withColumn("value", F.encode("value", "UTF-8"))
    visits = messages(spark, [("add", "k0", 5, "100")])
    out, table = run_until_quiet(g, rows, table=preset, join_changes=changes, visits=visits)
    assert {r.key: int(bytes(r.value)) for r in table.collect()} == {"k0": 3 + 100 + 11, "k1": 10, "k2": 10, "k3": 10, "k4": 10}
    seen = out.filter(F.col("kind") == OUTPUT).collect()
    assert len(seen) == 51 and {int(bytes(r.value)) for r in seen if r.key == "k1"} == {8}
    with pytest.raises(RuntimeError, match="did not come to rest"):
        run_until_quiet(g, rows, rounds=3)


def test_a_thousand_loop_backs_of_one_message_keep_their_order(spark):
    def handle(ctx, n):
        for i in range(n):
            ctx.loopback("all", i)

    def last(ctx, i):
        ctx.set_value((ctx.value() or 0) * 3 % 1_000_003 + i)

    g = define_group("g", Input("in", Int64(), handle), Loop(Int64(), last), Persist(Int64()))
    _, table = run_until_quiet(g, messages(spark, [("in", "a", 7, "1500"), ("in", "b", 7, "2"), ("in", "c", 1, "1200")]))
    want = 0
    for i in [*range(1200), *range(1500), *range(2)]:
        want = want * 3 % 1_000_003 + i
    assert {r.key: int(bytes(r.value)) for r in table.collect()} == {"all": want}


def test_options_have_their_effects(spark, tmp_path):
    topics = TopicManager(spark, f"file://{tmp_path}/topics")
    by_length = lambda k: F.length(k).cast("long")
    with Emitter(topics, "nums", Int64(), EmitterOptions(hasher=by_length, partitions=4)) as e:
        e.emit("a", 1)
        e.emit("bb", 2)
    assert {r.key: r.partition for r in topics.read("nums").collect()} == {"a": 1, "bb": 2}
    done, fails = [], []

    def commit(rows, number):
        if fails.pop() if fails else False:
            raise ValueError("not yet")
        done.append((number, rows.filter("kind = 'table'").count()))

    def handle(ctx, n):
        ctx.set_value(n * 10 + ctx.partition)

    options = ProcessorOptions(partitions=4, hasher=by_length, before_commit=commit, backoff=lambda: Backoff(step=0.01), start=NEWEST)
    g = define_group("late", Input("nums", Int64(), handle), Persist(Int64()))
    run = StreamProcessor(g, topics, f"file://{tmp_path}/cp", options).run_available()
    assert topics.read("late-table").count() == 0  # what was there before the group first ran
    topics.append("nums", spark.createDataFrame([("ccc", b"3")], "key string, value binary"), hasher=by_length)
    fails.append(True)
    run.run_restarting(tries=3)
    assert {r.key: r.value for r in run.table().collect()} == {"ccc": 33} and [n for _, n in done] == [0, 1]
    assert [r.partition for r in topics.read("late-table").collect()] == [3]
    view = View(topics, "late-table", Int64(), ViewOptions(hasher=by_length)).run()
    assert view.partition("ccc") == 3
    most = View(topics, "late-table", Int64(), ViewOptions(update_callback=lambda: F.max(F.decode("value", "UTF-8").cast("long")))).run()
    assert most.get("ccc") == 33


def test_view_follows_its_table(spark, tmp_path, monkeypatch):
    from rillflow.streaming import view as views

    monkeypatch.setattr(views, "FOLD", 2)
    topics = TopicManager(spark, f"file://{tmp_path}")
    topics.ensure_table_exists("t", 4)
    put = lambda *rows: topics.append("t", spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "seq int, key string, value binary"))
    put(("a", b"1"), ("b", b"2"), ("c", b"3"))
    view = View(topics, "t", Int64()).run()
    reads = []
    read = topics.read
    monkeypatch.setattr(topics, "read", lambda topic, since=0: (reads.append(since), read(topic, since))[1])
    view.evict("a")
    put(("b", None), ("d", b"4"))
    assert {r.key: r.value for r in view.refresh().table().collect()} == {"c": 3, "d": 4}
    put(("a", b"9"), ("c", b"5"))
    put(("e", b"6"))
    assert {r.key: r.value for r in view.refresh().table().collect()} == {"a": 9, "c": 5, "d": 4, "e": 6}
    assert view.refresh().get("e") == 6 and reads == [3, 5] and view.offset == 7
    put(("a", None))
    assert [r.key for r in view.refresh().rows()] == ["c", "d", "e"] and [r.key for r in view.seek("d").collect()] == ["d", "e"]
    assert topics.compact("t") == 5 and {r.key: r.value for r in View(topics, "t", Int64()).run().table().collect()} == {"c": 5, "d": 4, "e": 6}
    view.follow(every=0.05)
    try:
        put(("z", b"1"))
        for _ in range(600):
            if view.offset == 9 or view.error:
                break
            time.sleep(0.1)
        assert view.error is None and view.offset == 9 and view.has("z") and view.wait_running(1)
    finally:
        view.stop()
    broken = View(topics, "no-such", Int64())
    monkeypatch.setattr(broken, "_load", lambda: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        broken.run()


def test_retention_and_offsets_from_names(spark, tmp_path):
    topics = TopicManager(spark, f"file://{tmp_path}")
    topics.ensure_stream_exists("s", 2)
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, value binary")
    for _ in range(3):
        topics.append("s", rows)
    assert topics.get_offset("s") == 6 and topics.read("s", since=4).count() == 2
    assert topics.expire("s") == 0 and topics.expire("s", int(time.time() * 1000) + 7_200_000) == 2
    assert topics.get_offset("s") == 6 and topics.get_offset("s", newest=False) == 4 and topics.read("s").count() == 2
    with pytest.raises(ValueError):
        topics.compact("s")
    topics.ensure_table_exists("t", 2)
    with pytest.raises(ValueError):
        topics.expire("t")
    # An append that never finished leaves a folder without its mark: it counts for nothing and goes with the next one.
    (tmp_path / "s" / "from=00000000000000000006,to=00000000000000000009").mkdir()
    assert topics.get_offset("s") == 6 and topics.append("s", rows) == 8 and topics.read("s").count() == 4


def test_signals_promises_and_pages():
    s = Signal(0, 1, 2)
    o = s.observe()
    s.set_state(2)
    assert s.wait_for_state_min(1, 1) and s.is_state(2) and not s.wait_for_state(1, 0.01) and [o.changes.get(), o.changes.get()] == [0, 2]
    o.stop()
    with pytest.raises(ValueError):
        s.set_state(9)
    seen, p = [], Promise()
    p.then(seen.append)
    p.finish()
    p.finish(ValueError())
    p.then(seen.append)
    assert seen == [None, None]
    pages = Pages()
    pages.attach_source("t", {"a": {"x": 1}}.get)
    pages.processors["p"] = lambda: {"n": 1}
    assert pages.answer("/query/t/a") == (200, '{"x": 1}') and pages.answer("/query/t/b")[0] == 404 and pages.answer("/x")[0] == 404 and '"n": 1' in pages.answer("/monitor")[1]
    done = []
    pages.attach_action("job", Action("d", lambda stop, v: done.append(v)))
    pages.answer("/actions/job/start/5")
    pages.answer("/actions/job/stop")
    assert done == ["5"]
    with pytest.raises(ValueError):
        pages.attach_source("t", str)
