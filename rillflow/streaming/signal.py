"""Observable states, promises and lifecycle errors."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable


class Signal:
    """A state out of ``states`` (in order); waiters for a state or a least state; observers of changes."""

    def __init__(self, *states: int):
        self._order = {s: i for i, s in enumerate(states)}
        self._state = states[0] if states else None
        self._changed = threading.Condition()
        self._observers: list[Observer] = []

    @property
    def state(self) -> int:
        return self._state

    def is_state(self, state: int) -> bool:
        return self._state == state

    def set_state(self, state: int) -> Signal:
        if state not in self._order:
            raise ValueError(f"state {state} is not one of this signal's")
        with self._changed:
            changed, self._state = state != self._state, state
            if changed:
                for o in self._observers:
                    o.changes.put(state)
            self._changed.notify_all()
        return self

    def wait_for_state(self, state: int, timeout: float | None = None) -> bool:
        with self._changed:
            return self._changed.wait_for(lambda: self._state == state, timeout)

    def wait_for_state_min(self, state: int, timeout: float | None = None) -> bool:
        with self._changed:
            return self._changed.wait_for(lambda: self._order[self._state] >= self._order[state], timeout)

    def observe(self) -> Observer:
        o = Observer(self)
        with self._changed:
            self._observers.append(o)
            o.changes.put(self._state)
        return o


class Observer:
    def __init__(self, signal: Signal):
        self.signal, self.changes = signal, queue.Queue()

    def stop(self) -> None:
        with self.signal._changed:
            if self in self.signal._observers:
                self.signal._observers.remove(self)


class Promise:
    """The outcome of an emit; callbacks run once, whether added before or after it is known."""

    def __init__(self) -> None:
        self._lock, self._done, self._error, self._callbacks = threading.Lock(), False, None, []

    def then(self, callback: Callable[[Exception | None], None]) -> Promise:
        with self._lock:
            if not self._done:
                self._callbacks.append(callback)
                return self
        callback(self._error)
        return self

    def finish(self, error: Exception | None = None) -> Promise:
        with self._lock:
            if self._done:
                return self
            self._done, self._error, waiting = True, error, self._callbacks
            self._callbacks = []
        for c in waiting:
            c(error)
        return self

    @property
    def done(self) -> bool:
        return self._done

    @property
    def error(self) -> Exception | None:
        return self._error
