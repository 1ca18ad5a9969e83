"""Requests as DataFrames: filter, order and cut, then nest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideframe.operators.includes import flattened, included
from tideframe.operators.ordering import arranged
from tideframe.operators.predicates import filtered
from tideframe.plans.request import QueryRequest, SortKey, sub_query
from tideframe.schema import Catalog

ROOT = ()


def selected(catalog: Catalog, tables, request: QueryRequest, roots: DataFrame | None = None, order: bool = True, keep: bool = False) -> DataFrame:
    """The root rows of a request, without includes. roots (one column `id`): only those primary keys are looked at. keep: see arranged."""
    collection = catalog[request.resource]
    df = tables[collection.name].select(*collection.fields)
    if roots is not None:
        df = df.join(roots, df[collection.pk] == roots["id"], "left_semi")
    df = filtered(catalog, tables, df, collection, request.where)
    cut = request.limit is not None or request.offset or request.after is not None
    return arranged(catalog, tables, df, collection, request.order_by, request.limit, request.offset, request.after, keep) if order or cut else df


def plan(catalog: Catalog, tables, request: QueryRequest, keep: bool = False) -> DataFrame:
    """The rows of a request with its includes nested. Rows are cut before relations are nested, and sorted last."""
    collection = catalog[request.resource]
    if not request.include:
        return selected(catalog, tables, request, keep=keep)
    cut = request.limit is not None or bool(request.offset) or request.after is not None
    df = selected(catalog, tables, request, order=False, keep=keep or cut)
    df = included(catalog, tables, df, collection, request.include, cut or bool(request.where))
    if request.order_by:
        df = arranged(catalog, tables, df, collection, request.order_by, keep=True)
    return df if keep else df.select(*(c for c in df.columns if not c.startswith("__sort")))


def steps(catalog: Catalog, tables, request: QueryRequest, roots: DataFrame | None = None) -> dict[tuple[str, ...], DataFrame]:
    """The scope of a request: its root rows at path (), and every level of includes as a flat table with a column `parent`."""
    root = selected(catalog, tables, request, roots, order=False)
    return {ROOT: root, **flattened(catalog, tables, root, catalog[request.resource], request.include)}


def resource_at(catalog: Catalog, request: QueryRequest, path: tuple[str, ...]) -> str:
    name = request.resource
    for step in path:
        name = catalog[name].relation(step).target
    return name


def request_from_json(data: dict) -> QueryRequest:
    """The request that to_json wrote: resource, and the options of sub_query."""
    return sub_query(data["resource"], {"where": {}, **{k: v for k, v in data.items() if k != "resource"}})
