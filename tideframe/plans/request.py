"""Query requests: what the builder makes and the planner reads."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

OPTIONS = ("where", "include", "order_by", "limit", "offset", "after")


@dataclass(frozen=True)
class SortKey:
    """A field, or a path of one-relations to a field ("author.name"). nulls: "first" or "last"; by default first ascending, last descending."""

    key: str
    direction: str = "asc"
    nulls: str | None = None

    def __post_init__(self):
        if self.direction not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, not {self.direction!r}")

    @property
    def nulls_first(self) -> bool:
        return self.nulls == "first" if self.nulls else self.direction == "asc"

    @classmethod
    def of(cls, key: SortKey | str | tuple | dict) -> SortKey:
        if isinstance(key, SortKey):
            return key
        return cls(key) if isinstance(key, str) else cls(**key) if isinstance(key, dict) else cls(*key)


@dataclass(frozen=True)
class QueryRequest:
    resource: str
    where: dict[str, Any] = field(default_factory=dict)
    include: dict[str, Any] = field(default_factory=dict)
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    after: tuple | None = None

    def __post_init__(self):
        for name in ("limit", "offset"):
            n = getattr(self, name)
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
                raise ValueError(f"{name} must be a whole number from 0, not {n!r}")

    def to_json(self) -> dict:
        """The request as plain data; request_from_json reads it back."""
        return {"resource": self.resource, **self.options()}

    def options(self) -> dict:
        """All but the resource, as the options of an include are written."""
        return {
            "where": self.where,
            "include": {k: v if v is False else sub_query("", v).options() for k, v in self.include.items()},
            "order_by": [{"key": s.key, "direction": s.direction, "nulls": "first" if s.nulls_first else "last"} for s in self.order_by],
            "limit": self.limit,
            "offset": self.offset,
            "after": list(self.after) if self.after is not None else None,
        }

    def key(self) -> str:
        """One name per distinct request: limit, sort and include options count."""
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True, default=str).encode()).hexdigest()[:16]


def sub_query(resource: str, value: Any) -> QueryRequest:
    """An include's value as a request: True, options, or (the older form) a nested include map."""
    if value is True or value is None:
        return QueryRequest(resource)
    if isinstance(value, QueryRequest):
        return QueryRequest(resource, value.where, value.include, value.order_by, value.limit, value.offset, value.after)
    if not isinstance(value, dict):
        raise ValueError(f"an include is True, options or a map, not {value!r}")
    if not set(value) & set(OPTIONS):
        return QueryRequest(resource, include=value)
    if unknown := set(value) - set(OPTIONS):
        raise ValueError(f"unknown include options {sorted(unknown)}")
    order = value.get("order_by", ())
    order = [order] if isinstance(order, (str, SortKey, dict)) or (isinstance(order, tuple) and order and all(isinstance(x, str) for x in order) and order[-1] in ("asc", "desc")) else order
    after = value.get("after")
    return QueryRequest(resource, value.get("where") or {}, value.get("include") or {}, tuple(map(SortKey.of, order or ())), value.get("limit"), value.get("offset") or 0, None if after is None else tuple(after))


def merged_where(*wheres: dict | None) -> dict:
    """All of the wheres at once: none gives {}, one itself, more {"$and": [...]}."""
    real = [w for w in wheres if w]
    return {} if not real else real[0] if len(real) == 1 else {"$and": real}


def relations_in(catalog, resource: str, where: dict) -> dict:
    """The relations that a where names, as an include map."""
    out: dict[str, Any] = {}
    for key, value in where.items():
        if key in ("$and", "$or"):
            for part in value:
                _deep_merge(out, relations_in(catalog, resource, part))
        elif key in catalog[resource].relations:
            inner = value.get("$not", value) if isinstance(value, dict) else {}
            _deep_merge(out, {key: relations_in(catalog, catalog[resource].relations[key].target, inner or {})})
    return out


def _deep_merge(into: dict, other: dict) -> None:
    for key, value in other.items():
        _deep_merge(into.setdefault(key, {}), value)


def relation_tree(catalog, request: QueryRequest) -> dict:
    """Every relation a request reads, through where, sort keys and includes: relation name → tree below it."""
    out = relations_in(catalog, request.resource, request.where)
    for s in request.order_by:
        node = out
        for name in s.key.split(".")[:-1]:
            node = node.setdefault(name, {})
    for name, value in request.include.items():
        if value is not False:
            target = catalog[request.resource].relation(name).target
            _deep_merge(out, {name: relation_tree(catalog, sub_query(target, value))})
    return out


def dependencies(catalog, request: QueryRequest) -> set[str]:
    """Collections whose changes may change the result."""

    def walk(resource, tree):
        out = {resource}
        for name, below in tree.items():
            out |= walk(catalog[resource].relation(name).target, below)
        return out

    return walk(request.resource, relation_tree(catalog, request))
