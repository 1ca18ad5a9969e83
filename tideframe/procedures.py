"""Named queries and mutations with validation and middleware, and hooks around writes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from tideframe.builder import QueryBuilder, Session


class InvalidInput(ValueError):
    """Lists what is wrong with an input as `path: message`."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__(", ".join(f"{path}: {message}" if path else message for path, message in problems))
        self.problems = problems


class OneShot(ValueError):
    """A query whose result is a plain value cannot be subscribed to."""


def fields(**kinds: type | Callable[[Any], bool]) -> Callable[[Any], list[tuple[str, str]]]:
    """A validator of dictionaries: each named entry must be of a type, or pass a test."""

    def check(value: Any) -> list[tuple[str, str]]:
        if not isinstance(value, dict):
            return [("", "must be a dictionary")]
        out = []
        for name, kind in kinds.items():
            if name not in value:
                out.append((name, "is missing"))
            elif isinstance(kind, type):
                if not isinstance(value[name], kind):
                    out.append((name, f"must be {kind.__name__}"))
            elif not kind(value[name]):
                out.append((name, "is invalid"))
        return out

    return check


class Procedures:
    """A registry: queries return a builder (which can be tracked) or any other value (which cannot); mutations write through the session."""

    def __init__(self):
        self._queries: dict[str, tuple] = {}
        self._mutations: dict[str, tuple] = {}
        self._middleware: list[Callable] = []

    def use(self, middleware: Callable) -> Procedures:
        """Adds `middleware(request, call_next)`; the first added is the outermost."""
        self._middleware.append(middleware)
        return self

    def query(self, name: str, validate: Callable | None = None, middleware: tuple[Callable, ...] = ()):
        return self._add(self._queries, name, validate, middleware)

    def mutation(self, name: str, validate: Callable | None = None, middleware: tuple[Callable, ...] = ()):
        return self._add(self._mutations, name, validate, middleware)

    def _add(self, registry: dict, name: str, validate, middleware):
        if name in registry:
            raise ValueError(f"{name!r} is registered already")

        def keep(handler):
            registry[name] = (handler, validate, tuple(middleware))
            return handler

        return keep

    def call_query(self, session: Session, name: str, data: Any = None, context: dict | None = None) -> Any:
        """The handler's value; a builder is run and gives a DataFrame."""
        got = self._call(self._queries, session, name, data, context)
        return got.df() if isinstance(got, QueryBuilder) else got

    def subscribe(self, session: Session, live, name: str, listener: Callable, data: Any = None, context: dict | None = None) -> Callable[[], None]:
        got = self._call(self._queries, session, name, data, context)
        if not isinstance(got, QueryBuilder):
            raise OneShot(f"{name!r} returns a plain value and cannot be subscribed to")
        return got.subscribe(live, listener)

    def call_mutation(self, session: Session, name: str, data: Any = None, context: dict | None = None) -> Any:
        """Runs a mutation as one transaction."""
        with session.transaction():
            return self._call(self._mutations, session, name, data, context)

    def _call(self, registry: dict, session: Session, name: str, data: Any, context: dict | None) -> Any:
        if name not in registry:
            raise KeyError(f"unknown procedure {name!r}")
        handler, validate, middleware = registry[name]
        if validate and (problems := validate(data)):
            raise InvalidInput(problems)
        request = {"name": name, "input": data, "context": dict(context or {}), "session": session}
        call = reduce(lambda after, m: lambda r: m(r, after), reversed((*self._middleware, *middleware)), lambda r: handler(r["session"], r["input"], r["context"]))
        return call(request)


class Hooks:
    """Callables around writes: before_insert, after_insert, before_update, after_update. A before-hook may return another row; several run in the order added."""

    WHEN = ("before_insert", "after_insert", "before_update", "after_update")

    def __init__(self):
        self._hooks: dict[tuple[str, str], list[Callable[[dict], dict | None]]] = {}

    def on(self, when: str, collection: str, hook: Callable[[dict], dict | None]) -> Hooks:
        if when not in self.WHEN:
            raise ValueError(f"{when!r} is none of {', '.join(self.WHEN)}")
        self._hooks.setdefault((when, collection), []).append(hook)
        return self

    def merged(self, other: Hooks) -> Hooks:
        out = Hooks()
        for source in (self, other):
            for key, hooks in source._hooks.items():
                out._hooks.setdefault(key, []).extend(hooks)
        return out

    def has(self, collection: str, *when: str) -> bool:
        return any((w, collection) in self._hooks for w in when)

    def run(self, when: str, collection: str, row: dict) -> dict:
        for hook in self._hooks.get((when, collection), ()):
            got = hook(dict(row))
            if got is not None and when.startswith("before"):
                row = got
        return row
