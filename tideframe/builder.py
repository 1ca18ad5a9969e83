"""The query builder, and sessions that read and write collections."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from tideframe.operators import aggregates
from tideframe.operators.merge import LOG_SCHEMA, Overlaid, empty_log, log_rows
from tideframe.operators.ordering import sorted_by
from tideframe.plans.planner import plan, steps
from tideframe.plans.request import QueryRequest, SortKey, merged_where
from tideframe.schema import Catalog
from tideframe.sources.tables import Cached


#: Log rows of single writes that are held as one local table before they become a part of the log's plan.
BUFFERED = 2000


class QueryBuilder:
    """Immutable: every call gives a new builder. Nothing is read before a terminal call."""

    def __init__(self, session: Session, request: QueryRequest, single: bool = False):
        self.session, self.request, self.single = session, request, single

    def _with(self, single: bool | None = None, **changes) -> QueryBuilder:
        return QueryBuilder(self.session, replace(self.request, **changes), self.single if single is None else single)

    def where(self, clause: dict[str, Any]) -> QueryBuilder:
        """Merges the clause into the where so far; a key that is there already is replaced."""
        return self._with(where={**self.request.where, **clause})

    def and_where(self, clause: dict[str, Any]) -> QueryBuilder:
        """Both the where so far and the clause must hold."""
        return self._with(where=merged_where(self.request.where, clause))

    def include(self, relations: dict[str, Any]) -> QueryBuilder:
        for name in relations:
            self.session.catalog[self.request.resource].relation(name)
        return self._with(include={**self.request.include, **relations})

    def order_by(self, key: str, direction: str = "asc", nulls: str | None = None) -> QueryBuilder:
        return self._with(order_by=(*self.request.order_by, SortKey(key, direction, nulls)))

    def limit(self, n: int) -> QueryBuilder:
        return self._with(limit=n)

    def offset(self, n: int) -> QueryBuilder:
        return self._with(offset=n)

    def after(self, *values) -> QueryBuilder:
        """Only rows after a boundary: a value for each sort key, then (unless it is one of them) the primary key."""
        return self._with(after=values)

    def first(self, where: dict[str, Any] | None = None) -> QueryBuilder:
        """The first row; a where given here takes the place of the one so far."""
        return self._with(single=True, limit=1, **({} if where is None else {"where": where}))

    def one(self, key: Any) -> QueryBuilder:
        return self.first({self.session.catalog[self.request.resource].pk: key})

    def df(self) -> DataFrame:
        """The rows as a DataFrame, includes nested."""
        return plan(self.session.catalog, self.session.tables, self.request)

    def levels(self) -> dict[tuple[str, ...], DataFrame]:
        """The root rows and each level of includes as flat tables of their own."""
        return steps(self.session.catalog, self.session.tables, self.request)

    def select(self, *fields: str) -> DataFrame:
        return self.df().select(*fields)

    def get(self):
        """The rows on the driver: a list, or for first() and one() a row or None. For results of a screen's size; df() is for more."""
        rows = self.df().collect()
        return (rows[0] if rows else None) if self.single else rows

    def page(self, size: int) -> tuple[list, tuple | None]:
        """One page and the cursor of the next (None after the last): asks for one row more than it returns. Sort keys may be related fields; the cursor holds their values."""
        c = self.session.catalog[self.request.resource]
        request = self.limit(size + 1).request
        rows = plan(self.session.catalog, self.session.tables, request, keep=True).collect()
        names = [f"__sort{i}" if "." in k.key else k.key for i, k in enumerate(request.order_by)]
        names = names if c.pk in names else [*names, c.pk]
        cursor = tuple(rows[size - 1][n] for n in names) if len(rows) > size and size else None
        return [Row(**{n: r[n] for n in r.__fields__ if not n.startswith("__sort")}) for r in rows[:size]], cursor

    def count(self) -> int:
        return self.df().count()

    def exists(self) -> bool:
        return bool(self.limit(1).df().take(1))

    def aggregate(self, by: list[str] | None = None, having: dict | None = None, **measures) -> DataFrame:
        """name=("sum", "field") and the like, over all rows or by fields."""
        return aggregates.grouped(plan(self.session.catalog, self.session.tables, replace(self.request, include={}, order_by=())), by or [], measures, having)

    def with_relation(self, relation: str, where: dict | None = None, order_by: list | None = None, **measures) -> DataFrame:
        """The rows with measures of a many-relation as columns; rows without related ones count 0 and have null sums.

        order_by: measures or own fields to sort by, in the place of the request's sort; then its limit and offset cut the rows by them.
        """
        s = self.session
        c = s.catalog[self.request.resource]
        if order_by is None:
            return aggregates.over_relation(s.catalog, s.tables, self.df(), c, relation, where or {}, measures)
        request = replace(self.request, order_by=(), limit=None, offset=0)
        df = aggregates.over_relation(s.catalog, s.tables, plan(s.catalog, s.tables, request), c, relation, where or {}, measures)
        return sorted_by(df, c, tuple(map(SortKey.of, order_by)), self.request.limit, self.request.offset)

    def subscribe(self, live, listener: Callable[[DataFrame], None], first: bool = True) -> Callable[[], None]:
        """Tracks this query; the listener first gets its present rows, as inserts, then every batch's deltas. Returns what ends it."""
        key = live.track(self.request, listener, first)
        return lambda: live.untrack(key, listener)

    def to_json(self) -> dict:
        return self.request.to_json()


class Session:
    """Collections to read (as a base with the session's writes over it) and to write."""

    def __init__(self, spark: SparkSession, catalog: Catalog, base, hooks=None, clock: Callable[[], str] | None = None):
        self.spark, self.catalog, self.base, self.hooks = spark, catalog, base, hooks
        self.clock = clock or (lambda: datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"))
        self._stored = empty_log(spark)
        self._buffer: list[tuple] = []
        self.listeners: list[Callable[[DataFrame], None]] = []
        self._seq = 0
        self._dirty: set[str] = set()
        self._open: list[list[tuple]] = []

    @property
    def log(self) -> DataFrame:
        """All writes so far; within a transaction its own too."""
        rows = self._buffer + [r for part in self._open for r in part]
        return self._stored.unionByName(self.spark.createDataFrame(rows, LOG_SCHEMA)) if rows else self._stored

    @property
    def tables(self):
        dirty = self._dirty | {r[1] for part in self._open for r in part}
        return Cached(Overlaid(self.catalog, self.base, self.log, dirty) if dirty else self.base)

    def collection(self, name: str) -> QueryBuilder:
        return QueryBuilder(self, QueryRequest(self.catalog[name].name))

    def __getattr__(self, name: str) -> QueryBuilder:
        if name.startswith("_") or name not in self.__dict__.get("catalog", {}):
            raise AttributeError(name)
        return self.collection(name)

    def sql(self, text: str) -> DataFrame:
        """Plain SQL over the collections as views; not tracked."""
        for name in self.catalog:
            self.tables[name].createOrReplaceTempView(name)
        return self.spark.sql(text)

    def insert(self, name: str, values: dict[str, Any], ts: str | None = None, origin: str | None = None) -> dict:
        """Writes a row; fields with a default get it, required ones must be there, an id is made where there is none."""
        c = self.catalog[name]
        row = {n: f.default for n, f in c.fields.items() if f.default is not None} | dict(values)
        if row.get(c.pk) is None:
            row[c.pk] = uuid.uuid4().hex
        row = self._hooked("before_insert", name, row)
        if missing := [n for n, f in c.fields.items() if f.required and n != c.pk and row.get(n) is None]:
            raise ValueError(f"{name}: missing {', '.join(missing)}")
        self._write(name, row, ts, origin)
        self._hooked("after_insert", name, row)
        return row

    def update(self, name: str, key: Any, values: dict[str, Any], ts: str | None = None, origin: str | None = None) -> dict:
        """Writes the given fields of one row; returns them. A key without a row makes one, since writes may come in any order.

        Hooks on updates see the whole row with the new values in place, which reads it; fields that they change are written too.
        """
        c = self.catalog[name]
        row, now = {**values, c.pk: key}, {}
        if self.hooks and self.hooks.has(name, "before_update", "after_update"):
            found = self.collection(name).one(key).get()
            now = found.asDict() if found else {}
            whole = self._hooked("before_update", name, {**now, **row})
            row = {n: v for n, v in whole.items() if n == c.pk or n in values or v != now.get(n)}
        self._write(name, row, ts, origin)
        self._hooked("after_update", name, {**now, **row})
        return {n: v for n, v in row.items() if n != c.pk or n in values}

    def _hooked(self, when: str, name: str, row: dict) -> dict:
        return self.hooks.run(when, name, row) if self.hooks else row

    def _write(self, name: str, row: dict, ts: str | None, origin: str | None) -> None:
        c = self.catalog[name]
        for n, v in row.items():
            allowed = c.fields[c.require(n)].values
            if allowed and v is not None and v not in allowed:
                raise ValueError(f"{name}.{n}: {v!r} is none of {', '.join(allowed)}")
        self._seq += 1
        rows = log_rows(c, row, ts or self.clock(), self._seq, origin)
        if self._open:
            self._open[-1] += rows
        else:
            self._commit(rows)

    def _commit(self, rows: list[tuple]) -> None:
        if rows:
            self._buffer += rows
            self._dirty |= {r[1] for r in rows}
            if len(self._buffer) > BUFFERED:
                self._stored, self._buffer = self._stored.unionByName(self.spark.createDataFrame(self._buffer, LOG_SCHEMA)), []
            if self.listeners:
                self._tell(self.spark.createDataFrame(rows, LOG_SCHEMA))

    def append(self, rows: DataFrame, resources: set[str] | None = None) -> None:
        """Adds log rows, of any number, as one step; listeners get them as one DataFrame."""
        self._stored = self._stored.unionByName(rows)
        self._dirty |= set(self.catalog) if resources is None else resources
        self._tell(rows)

    def _tell(self, rows: DataFrame) -> None:
        for listener in self.listeners:
            listener(rows)

    @contextmanager
    def transaction(self):
        """Writes within are seen by the session at once and told together at the end, or taken back; one inside another joins it when it ends well."""
        self._open.append([])
        try:
            yield self
        except BaseException:
            self._open.pop()
            raise
        rows = self._open.pop()
        if self._open:
            self._open[-1] += rows
        else:
            self._commit(rows)


class Optimistic(Session):
    """A session whose writes are pending until confirmed: they lie over the confirmed log and can be taken back by origin."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.confirmed = empty_log(self.spark)
        self.pending: dict[str, list[tuple]] = {}
        self._fresh: set[str] = set()

    def propose(self, origin: str, handler: Callable[[Session], Any]) -> Any:
        """Runs a handler whose writes are pending under an origin."""
        before = len(self._open)
        self._open.append([])
        try:
            got = handler(self)
        finally:
            rows = self._open.pop()
        assert len(self._open) == before
        self.pending.setdefault(origin, []).extend((*r[:6], origin) for r in rows)
        self._refold()
        return got

    def confirm(self, origin: str, rows: DataFrame | None = None) -> None:
        """The server's rows (or else the pending ones) become confirmed."""
        mine = self.pending.pop(origin, [])
        if rows is None and mine:
            rows = self.spark.createDataFrame(mine, LOG_SCHEMA)
        if rows is not None:
            self.confirmed = self.confirmed.unionByName(rows)
        self._refold()

    def reject(self, origin: str) -> None:
        """Takes an origin's pending writes back."""
        self.pending.pop(origin, None)
        self._refold()

    def replay(self) -> list[tuple]:
        """All pending writes in their order, to be sent (again)."""
        return sorted((r for rows in self.pending.values() for r in rows), key=lambda r: r[0])

    def _refold(self) -> None:
        rows = self.replay()
        self._stored = self.confirmed.unionByName(self.spark.createDataFrame(rows, LOG_SCHEMA)) if rows else self.confirmed
        self._dirty = set(self.catalog)
