"""Filters: a where clause as columns and joins."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.schema import Catalog, Collection


#: Foreign keys of related rows that fit; no field may have this name.
KEY = "__relation_key"


def _compare(op: str, column: Column, value: Any) -> Column:
    if op == "$eq":
        return column.isNull() if value is None else column == F.lit(value)
    if op == "$in":
        return column.isin(list(value)) if value else F.lit(False)
    if op == "$not":
        if isinstance(value, dict):
            return ~field_predicate(column, value)
        return column.isNotNull() if value is None else column != F.lit(value)
    if op == "$gt":
        return column > F.lit(value)
    if op == "$gte":
        return column >= F.lit(value)
    if op == "$lt":
        return column < F.lit(value)
    if op == "$lte":
        return column <= F.lit(value)
    if op == "$like":
        return column.like(value)
    if op == "$ilike":
        return column.ilike(value)
    if op == "$contains":
        return F.contains(column, F.lit(value))
    if op == "$icontains":
        return F.contains(F.lower(column), F.lit(value.lower()))
    if op == "$startsWith":
        return F.startswith(column, F.lit(value))
    if op == "$istartsWith":
        return F.startswith(F.lower(column), F.lit(value.lower()))
    if op == "$endsWith":
        return F.endswith(column, F.lit(value))
    if op == "$iendsWith":
        return F.endswith(F.lower(column), F.lit(value.lower()))
    if op == "$path":
        return _all(field_predicate(_json_value(column, path, test), test) for path, test in value.items())
    raise ValueError(f"unknown operator {op!r}")


def _json_value(column: Column, path: str, test: Any) -> Column:
    """The value at a path of a JSON column, in the type that the test compares with: number, truth value or text."""
    text = F.get_json_object(column, path)
    values = [test]
    while any(isinstance(v, (dict, list, tuple)) for v in values):
        values = [x for v in values for x in (v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else [v])]
    values = [v for v in values if v is not None]
    if values and all(isinstance(v, bool) for v in values):
        return text.try_cast("boolean")
    if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return text.try_cast("double")
    return text


def field_predicate(column: Column, test: Any) -> Column:
    """A field's test: a value (equality, null as IS NULL) or operators, all of which must hold. Nulls follow SQL: a comparison with null is not true."""
    if isinstance(test, dict):
        if not test:
            raise ValueError("a field's test is empty")
        return _all(_compare(op, column, value) for op, value in test.items())
    return _compare("$eq", column, test)


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class Joined:
    """A frame of a collection to which relations are joined under names of their own, one join for each path."""

    def __init__(self, catalog: Catalog, tables, df: DataFrame, collection: Collection):
        self.catalog, self.tables, self.df, self.collection = catalog, tables, df, collection
        self._prefixes: dict[tuple[str, ...], str] = {(): ""}
        self._marks = 0

    def column(self, path: tuple[str, ...], name: str) -> Column:
        return F.col(f"`{self._prefixes[path]}{self.at(path).require(name)}`")

    def at(self, path: tuple[str, ...]) -> Collection:
        c = self.collection
        for name in path:
            c = self.catalog[c.relation(name).target]
        return c

    def one(self, path: tuple[str, ...]) -> tuple[str, ...]:
        """Left-joins the one-relation at the end of path (and those before it)."""
        if path not in self._prefixes:
            self.one(path[:-1])
            source = self.at(path[:-1])
            relation = source.relation(path[-1])
            if relation.kind != "one":
                raise ValueError(f"{source.name}.{path[-1]} is a many-relation")
            target = self.catalog[relation.target]
            key = self.column(path[:-1], relation.key)
            prefix = self._prefixes[path] = f"__{'.'.join(path)}__"
            other = self.tables[target.name]
            other = other.select(*(F.col(n).alias(prefix + n) for n in target.fields))
            self.df = self.df.join(other, key == F.col(f"`{prefix}{target.pk}`"), "left")
        return path

    def some(self, path: tuple[str, ...], name: str, where: dict) -> Column:
        """Whether a row of the many-relation fits, as a mark joined by distinct keys: usable under any connective."""
        self._marks += 1
        mark, key = f"__mark{self._marks}", f"__key{self._marks}"
        keys = self.matching_keys(path, name, where).select(F.col(KEY).alias(key)).distinct().withColumn(mark, F.lit(True))
        self.df = self.df.join(keys, self.column(path, self.at(path).pk) == F.col(key), "left")
        return F.col(mark).isNotNull()

    def matching_keys(self, path: tuple[str, ...], name: str, where: dict) -> DataFrame:
        relation = self.at(path).relation(name)
        child = self.catalog[relation.target]
        fit = filtered(self.catalog, self.tables, self.tables[child.name], child, where)
        return fit.where(F.col(relation.key).isNotNull()).select(F.col(relation.key).alias(KEY))

    def predicate(self, where: dict, path: tuple[str, ...] = ()) -> Column:
        parts = []
        for key, test in where.items():
            c = self.at(path)
            if key == "$and":
                parts.append(_all([self.predicate(w, path) for w in test]))
            elif key == "$or":
                parts.append(_any([self.predicate(w, path) for w in test]))
            elif key in c.fields:
                parts.append(field_predicate(self.column(path, key), test))
            elif key in c.relations:
                parts.append(self._relation(key, test, path))
            else:
                raise ValueError(f"{c.name} has no field or relation {key!r}")
        return _all(parts)

    def _relation(self, name: str, test: Any, path: tuple[str, ...]) -> Column:
        if not isinstance(test, dict):
            raise ValueError(f"a relation's test is a where clause, not {test!r}")
        if set(test) == {"$not"}:
            return ~F.coalesce(self._relation(name, test["$not"], path), F.lit(False))
        if self.at(path).relation(name).kind == "many":
            return self.some(path, name, test)
        return self.predicate(test, self.one((*path, name)))


def _conjuncts(where: dict):
    for key, test in where.items():
        if key == "$and":
            for w in test:
                yield from _conjuncts(w)
        else:
            yield key, test


def filtered(catalog: Catalog, tables, df: DataFrame, collection: Collection, where: dict) -> DataFrame:
    """The rows of df that fit. Its columns stay; each row stays once, however many related rows fit.

    A many-relation that must hold is a left-semi join, its negation a left-anti join; under `$or`, or below a one-relation, it is a mark.
    A one-relation is a left join, which Catalyst makes an inner one where the test rejects nulls.
    """
    if not where:
        return df
    joined, parts = Joined(catalog, tables, df, collection), []
    columns = [F.col(f"`{c}`") for c in df.columns]
    for key, test in _conjuncts(where):
        relation = collection.relations.get(key)
        if relation and relation.kind == "many" and isinstance(test, dict):
            negated = set(test) == {"$not"}
            keys = joined.matching_keys((), key, test["$not"] if negated else test)
            joined.df = joined.df.join(keys, F.col(f"`{collection.pk}`") == F.col(KEY), "left_anti" if negated else "left_semi")
        else:
            parts.append((key, test))
    own = [(k, t) for k, t in parts if k in collection.fields]
    joined.df = joined.df.where(_all(field_predicate(F.col(f"`{k}`"), t) for k, t in own)) if own else joined.df
    rest = [joined.predicate({k: t}) for k, t in parts if k not in collection.fields]
    out = joined.df.where(_all(rest)) if rest else joined.df
    return out.select(*columns)
