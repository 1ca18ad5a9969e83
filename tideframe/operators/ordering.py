"""Sorting by own and related fields, limits, and pages by key."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.predicates import Joined
from tideframe.plans.request import SortKey
from tideframe.schema import Catalog, Collection


def sort_columns(catalog: Catalog, tables, df: DataFrame, collection: Collection, keys: tuple[SortKey, ...]) -> tuple[DataFrame, list[str]]:
    """df with a column for each sort key (an own field's is the field), and their names. Related fields come by left joins along one-relations, unless df has their columns already."""
    joined, names, extra = Joined(catalog, tables, df, collection), [], []
    columns = df.columns
    for i, k in enumerate(keys):
        *path, name = k.key.split(".")
        if not path:
            names.append(name if name in df.columns else collection.require(name))
            continue
        names.append(f"__sort{i}")
        if names[-1] in columns:
            continue
        joined.one(tuple(path))
        extra.append(joined.column(tuple(path), name).alias(names[-1]))
    return (joined.df.select(*(F.col(f"`{c}`") for c in columns), *extra) if extra else df), names


def ordered(column: Column | str, key: SortKey) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if key.direction == "asc":
        return c.asc_nulls_first() if key.nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if key.nulls_first else c.desc_nulls_last()


def with_tiebreak(keys: tuple[SortKey, ...], collection: Collection) -> tuple[SortKey, ...]:
    """A total order: the primary key, ascending, comes last."""
    return keys if any(k.key == collection.pk for k in keys) else (*keys, SortKey(collection.pk))


def beyond(column: Column, key: SortKey, value: Any) -> Column:
    """Rows strictly after a value in the key's order, nulls in their place."""
    if value is None:
        return column.isNotNull() if key.nulls_first else F.lit(False)
    after = column > F.lit(value) if key.direction == "asc" else column < F.lit(value)
    return F.coalesce(after, F.lit(False)) if key.nulls_first else F.coalesce(after, F.lit(True))


def after_cursor(columns: list[str], keys: tuple[SortKey, ...], values: tuple) -> Column:
    """Rows strictly after a boundary: equal on the first keys and beyond it on the next."""
    if len(values) != len(keys):
        raise ValueError(f"a cursor needs {len(keys)} values: {[k.key for k in keys]}")
    out = F.lit(False)
    for i, (c, k, v) in enumerate(zip(columns, keys, values)):
        same = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.lit(w)) for d, w in zip(columns[:i], values)), F.lit(True))
        out = out | (same & beyond(F.col(c), k, v))
    return out


def arranged(catalog: Catalog, tables, df: DataFrame, collection: Collection, keys: tuple[SortKey, ...], limit: int | None = None, offset: int = 0, after: tuple | None = None, keep: bool = False) -> DataFrame:
    """df sorted, after the cursor, from offset, cut to limit. Whatever cuts rows off works in a total order; sort and limit together become one top-k.

    A cursor holds a value for each sort key, a related field's too, and, where they are not unique alone, the primary key. keep: the columns of related sort keys stay.
    """
    if limit is not None or offset or after is not None:
        keys = with_tiebreak(keys, collection)
    if not keys:
        return df
    columns = df.columns
    df, names = sort_columns(catalog, tables, df, collection, keys)
    if after is not None:
        df = df.where(after_cursor(names, keys, after))
    df = df.orderBy(*(ordered(n, k) for n, k in zip(names, keys)))
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df if keep else df.select(*columns)


def sorted_by(df: DataFrame, collection: Collection, keys: tuple[SortKey, ...], limit: int | None = None, offset: int = 0) -> DataFrame:
    """df sorted by columns that it has, measures too, then by primary key, and cut."""
    df = df.orderBy(*(ordered(k.key, k) for k in with_tiebreak(keys, collection)))
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
