"""Options of processors, views and emitters.

Options that steer what Spark's runtime owns (hot standby, recover-ahead,
rebalance callbacks, client builders) are accepted and have no effect; all
others have one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from rillflow.functions.partition import fnv1a
from rillflow.sources.envelope import NIL_IGNORE


@dataclass
class Backoff:
    """Waits that grow by ``step`` while they stay within ``most``; the first is none."""

    step: float = 10.0
    most: float = 120.0
    current: float = 0.0

    def duration(self) -> float:
        out = self.current
        if self.current + self.step <= self.most:
            self.current += self.step
        return out

    def reset(self) -> None:
        self.current = 0.0


OLDEST, NEWEST = "oldest", "newest"


@dataclass
class ProcessorOptions:
    nil_handling: str = NIL_IGNORE
    partitions: int = 8
    hasher: Callable[[Column], Column] = fnv1a
    default_headers: dict[str, bytes] = field(default_factory=dict)
    context_wrapper: Callable | None = None
    #: (topic, key, stored bytes or None, change's bytes or None) -> bytes or None, for presets and changes of joined tables
    update_callback: Callable | None = None
    #: (rows of the batch, its number), after its outputs are written and before it counts as done; an error undoes the batch
    before_commit: Callable | None = None
    start: str = OLDEST  # or NEWEST: where input streams begin when there is no checkpoint yet
    graph_hook: Callable | None = None
    client_id: str = "rillflow"
    channel_size: int | None = None  # files per micro-batch
    backoff: Callable[[], Backoff] = Backoff
    backoff_reset: float = 60.0
    rebalance_callback: Callable | None = None  # no effect
    hot_standby: bool = False  # no effect
    recover_ahead: bool = False  # no effect
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("rillflow"))
    state_ttl_ms: int | None = None  # beyond plain tables: rows that expire


@dataclass
class ViewOptions:
    update_callback: Callable | None = None
    hasher: Callable[[Column], Column] = fnv1a
    client_id: str = "rillflow"
    auto_reconnect: bool = False
    backoff: Callable[[], Backoff] = Backoff
    backoff_reset: float = 60.0
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("rillflow"))


@dataclass
class EmitterOptions:
    partitions: int = 8
    hasher: Callable[[Column], Column] = fnv1a
    default_headers: dict[str, bytes] = field(default_factory=dict)
    client_id: str = "rillflow"
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("rillflow"))
