"""Includes: related rows nested below their parents, or flat, one table for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.ordering import after_cursor, ordered, sort_columns, with_tiebreak
from tideframe.operators.predicates import filtered
from tideframe.plans.request import QueryRequest, sub_query
from tideframe.schema import Catalog, Collection


def top_per_parent(catalog: Catalog, tables, df: DataFrame, collection: Collection, parent: str, request: QueryRequest, rank: str = "__rank") -> DataFrame:
    """df with each row's place among those of one parent, after the cursor; only places offset+1 to offset+limit where there is a limit.

    The cut is by row_number, so Spark keeps at most that many rows of a parent before it shuffles.
    """
    keys = with_tiebreak(request.order_by, collection)
    columns = df.columns
    df, names = sort_columns(catalog, tables, df, collection, keys)
    if request.after is not None:
        df = df.where(after_cursor(names, keys, request.after))
    w = Window.partitionBy(parent).orderBy(*(ordered(n, k) for n, k in zip(names, keys)))
    df = df.withColumn(rank, F.row_number().over(w))
    if request.limit is not None:
        df = df.where(F.col(rank) <= request.offset + request.limit)
    if request.offset:
        df = df.where(F.col(rank) > request.offset)
    return df.select(*columns, rank)


def included(catalog: Catalog, tables, df: DataFrame, collection: Collection, include: dict, part: bool = False) -> DataFrame:
    """df with a column for each include: a struct (or null) for a one-relation, an array of structs (empty where there are none) for a many-relation.

    Levels are built from the bottom; each many-relation is cut to its limit and grouped by its foreign key before it meets its parent, so
    siblings never multiply. part: df is only some of the collection's rows, so children are kept to those of its rows before they are ranked and grouped.
    Arrays are in the include's order, then by primary key. An array lies in one row: for parents with more children than a row can hold, use `flattened`.
    """
    parents = df.select(F.col(collection.pk).alias("__parent")) if part else None
    links = df
    for name, value in include.items():
        if value is False:
            continue
        relation = collection.relation(name)
        target = catalog[relation.target]
        request = sub_query(target.name, value)
        child = filtered(catalog, tables, tables[target.name], target, request.where)
        if relation.kind == "one":
            if part and request.include:
                child = child.join(links.select(F.col(relation.key).alias("__parent")), F.col(target.pk) == F.col("__parent"), "left_semi")
            child = included(catalog, tables, child, target, request.include, part or bool(request.where))
            nested = child.select(F.col(target.pk).alias("__pk"), F.struct(*child.columns).alias(name))
            df = df.join(nested, F.col(relation.key) == F.col("__pk"), "left").drop("__pk")
            continue
        child = child.where(F.col(relation.key).isNotNull())
        if parents is not None:
            child = child.join(parents, F.col(relation.key) == F.col("__parent"), "left_semi")
        cut = request.limit is not None or bool(request.offset) or request.after is not None
        if cut or request.order_by:
            child = top_per_parent(catalog, tables, child, target, relation.key, request)
        else:
            child = child.withColumn("__rank", F.col(target.pk))
        child = included(catalog, tables, child, target, request.include, part or cut or bool(request.where))
        row = F.struct(*(c for c in child.columns if c != "__rank"))
        arrays = child.groupBy(F.col(relation.key).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct("__rank", row.alias("row")))).alias("__rows"))
        df = df.join(arrays, F.col(collection.pk) == F.col("__fk"), "left")
        df = df.withColumn(name, F.coalesce(F.transform("__rows", lambda x: x["row"]), F.array())).drop("__fk", "__rows")
    return df


def flattened(catalog: Catalog, tables, roots: DataFrame, collection: Collection, include: dict, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], DataFrame]:
    """The levels below roots, each a table of its own: path → rows with a column `parent` (the primary key of the row above)."""
    out = {}
    for name, value in include.items():
        if value is False:
            continue
        relation = collection.relation(name)
        target = catalog[relation.target]
        request = sub_query(target.name, value)
        child = filtered(catalog, tables, tables[target.name], target, request.where)
        if relation.kind == "one":
            links = roots.select(F.col(collection.pk).alias("parent"), F.col(relation.key).alias("__link")).distinct()
            rows = links.join(child, F.col("__link") == F.col(target.pk)).drop("__link")
        else:
            links = roots.select(F.col(collection.pk).alias("parent")).distinct()
            rows = links.join(child, F.col("parent") == F.col(relation.key))
            if request.limit is not None or request.offset or request.after is not None:
                rows = top_per_parent(catalog, tables, rows, target, "parent", request).drop("__rank")
        out[*path, name] = rows
        out |= flattened(catalog, tables, rows, target, request.include, (*path, name))
    return out
