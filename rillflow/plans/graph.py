"""The declaration of a processor: its inputs, joins, state, loop, outputs and visitors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from rillflow.functions.codec import Codec

Callback = Callable[..., None]


@dataclass(frozen=True)
class Edge:
    topic: str
    codec: Codec | None = None
    callback: Callback | None = None


class Input(Edge):
    """A stream, read from its newest messages on."""


class Loop(Edge):
    """The group's own feedback stream."""

    def __init__(self, codec: Codec, callback: Callback):
        super().__init__("", codec, callback)


class Persist(Edge):
    """The group's table."""

    def __init__(self, codec: Codec):
        super().__init__("", codec)


class Join(Edge):
    """A co-partitioned table, read by the message's key."""


class Lookup(Edge):
    """A replicated table, read by any key."""


class Output(Edge):
    """A stream the group may emit to."""


class Visitor(Edge):
    """A named pass over the table."""

    def __init__(self, name: str, callback: Callback):
        super().__init__(name, None, callback)


def inputs(topics: list[str], codec: Codec, callback: Callback) -> list[Input]:
    """Several topics with one codec and callback."""
    if not topics:
        raise ValueError("inputs needs at least one topic")
    return [Input(t, codec, callback) for t in topics]


def topics_of(edges: list[Edge]) -> list[str]:
    return [e.topic for e in edges]


@dataclass(frozen=True)
class GroupGraph:
    group: str
    edges: tuple[Edge, ...]
    table_suffix: str = "-table"
    loop_suffix: str = "-loop"

    def of(self, kind: type) -> list[Edge]:
        return [e for e in self.edges if type(e) is kind]

    @property
    def input_streams(self) -> list[Edge]:
        return self.of(Input)

    @property
    def joint_tables(self) -> list[Edge]:
        return self.of(Join)

    @property
    def lookup_tables(self) -> list[Edge]:
        return self.of(Lookup)

    @property
    def output_streams(self) -> list[Edge]:
        return self.of(Output)

    @property
    def visitors(self) -> list[Edge]:
        return self.of(Visitor)

    @property
    def loop_stream(self) -> Edge | None:
        found = self.of(Loop)
        return replace_topic(found[0], loop_name(self.group, self.loop_suffix)) if found else None

    @property
    def group_table(self) -> Edge | None:
        found = self.of(Persist)
        return replace_topic(found[0], table_name(self.group, self.table_suffix)) if found else None

    def all_edges(self) -> list[Edge]:
        return list(self.edges)

    def copartitioned(self) -> list[str]:
        """Topics that must have equally many partitions."""
        return topics_of(self.input_streams) + topics_of(self.joint_tables)

    def callbacks(self) -> dict[str, tuple[Codec | None, Callback | None]]:
        out = {e.topic: (e.codec, e.callback) for e in self.input_streams}
        if self.loop_stream:
            out[self.loop_stream.topic] = (self.loop_stream.codec, self.loop_stream.callback)
        return out

    def validate(self) -> GroupGraph:
        if len(self.of(Loop)) > 1:
            raise ValueError("more than one loop stream in group graph")
        if len(self.of(Persist)) > 1:
            raise ValueError("more than one group table in group graph")
        if not self.input_streams:
            raise ValueError("no input in group graph")
        own_loop, own_table = loop_name(self.group, self.loop_suffix), table_name(self.group, self.table_suffix)
        for e in self.input_streams + self.output_streams + self.joint_tables + self.lookup_tables:
            if e.topic == own_loop:
                raise ValueError(f"{e.topic} is the group's loop stream; use Loop")
            if e.topic == own_table and type(e) is not Lookup:
                raise ValueError(f"{e.topic} is the group table; use Persist")
            if e.topic == own_table:
                raise ValueError(f"{e.topic} is the group table; it can't be looked up by its own group")
        if self.visitors and not self.group_table:
            raise ValueError("visitors need a group table")
        return self


def replace_topic(edge: Edge, topic: str) -> Edge:
    out = object.__new__(type(edge))
    for name, value in (("topic", topic), ("codec", edge.codec), ("callback", edge.callback)):
        object.__setattr__(out, name, value)
    return out


def table_name(group: str, suffix: str = "-table") -> str:
    return group + suffix


def loop_name(group: str, suffix: str = "-loop") -> str:
    return group + suffix


def define_group(group: str, *edges: Edge | list[Edge], table_suffix: str = "-table", loop_suffix: str = "-loop") -> GroupGraph:
    """Collects the edges; an input topic must be named and be consumed once."""
    flat = [e for x in edges for e in (x if isinstance(x, list) else [x])]
    if any(not isinstance(e, Edge) for e in flat):
        raise ValueError("edges must be made by the edge constructors")
    seen: set[str] = set()
    for e in flat:
        if type(e) is Input:
            if not e.topic:
                raise ValueError("empty input topic")
            if e.topic in seen:
                raise ValueError(f"topic {e.topic} is consumed twice")
            seen.add(e.topic)
    return GroupGraph(group, tuple(flat), table_suffix, loop_suffix)


__all__ = ["Edge", "GroupGraph", "Input", "Join", "Lookup", "Loop", "Output", "Persist", "Visitor", "define_group", "inputs", "loop_name", "table_name", "topics_of"]
