import pytest

from rillflow.functions.codec import Int64, String
from rillflow.plans.graph import Input, Join, Lookup, Loop, Output, Persist, Visitor, define_group, inputs, table_name
from rillflow.plans.options import Backoff


def cb(ctx, msg):
    pass


def test_names_and_getters():
    g = define_group("g", inputs(["a", "b"], String(), cb), Loop(String(), cb), Persist(Int64()), Join("j", Int64()), Lookup("l", Int64()), Output("o", String()), Visitor("v", cb)).validate()
    assert [e.topic for e in g.input_streams] == ["a", "b"]
    assert g.loop_stream.topic == "g-loop" and g.group_table.topic == table_name("g") == "g-table"
    assert g.copartitioned() == ["a", "b", "j"]
    assert len(g.all_edges()) == 8
    assert define_group("g", Input("a", String(), cb), Persist(Int64()), table_suffix=".t").group_table.topic == "g.t"


@pytest.mark.parametrize(
    ("edges", "message"),
    [
        ([Persist(Int64())], "no input"),
        ([Input("a", String(), cb), Loop(String(), cb), Loop(String(), cb)], "more than one loop"),
        ([Input("a", String(), cb), Persist(Int64()), Persist(Int64())], "more than one group table"),
        ([Input("a", String(), cb), Join("g-table", Int64())], "group table"),
        ([Input("g-loop", String(), cb)], "loop stream"),
        ([Input("a", String(), cb), Output("g-loop", String())], "loop stream"),
        ([Input("a", String(), cb), Visitor("v", cb)], "visitors"),
    ],
)
def test_validation(edges, message):
    with pytest.raises(ValueError, match=message):
        define_group("g", *edges).validate()


def test_definition_errors():
    for edges in ([Input("", String(), cb)], [Input("a", String(), cb), Input("a", String(), cb)], [None]):
        with pytest.raises(ValueError):
            define_group("g", *edges)
    with pytest.raises(ValueError):
        inputs([], String(), cb)


def test_backoff_grows_within_its_limit():
    b = Backoff(step=10, most=30)
    assert [b.duration() for _ in range(6)] == [0, 10, 20, 30, 30, 30]
    b.reset()
    assert b.duration() == 0
