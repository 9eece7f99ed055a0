"""Run arguments that stand for task arguments: a task built with one is constructed when a run gives its value."""

from __future__ import annotations

import functools
from dataclasses import dataclass


@dataclass(frozen=True)
class Argument:
    """A typed run argument; may stand for a task argument, also inside a list or dict."""

    name: str
    kind: str


def _waits(x) -> bool:
    return isinstance(x, Argument) or isinstance(x, (list, tuple)) and any(map(_waits, x)) or isinstance(x, dict) and any(map(_waits, x.values()))


def _given(x, values: dict):
    if isinstance(x, Argument):
        return values[x.name]
    if isinstance(x, (list, tuple)):
        return type(x)(_given(y, values) for y in x)
    return {k: _given(v, values) for k, v in x.items()} if isinstance(x, dict) else x


class Deferred:
    """Base of tasks: a constructor that gets run arguments only remembers them until ``resolved``."""

    _waiting: tuple | None = None

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if init := cls.__dict__.get("__init__"):

            @functools.wraps(init)
            def later(self, *args, **named):
                if _waits(args) or _waits(named):
                    self._waiting = args, named
                else:
                    init(self, *args, **named)

            cls.__init__ = later


def waiting(task) -> bool:
    return getattr(task, "_waiting", None) is not None


def resolved(task, values: dict):
    """The task with these arguments, if it waits for some."""
    if not waiting(task):
        return task
    args, named = task._waiting
    return type(task)(*_given(args, values), **_given(named, values))
