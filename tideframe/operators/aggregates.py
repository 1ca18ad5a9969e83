"""Aggregates over a query's rows, by group, and over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.predicates import field_predicate, filtered
from tideframe.schema import Catalog, Collection

_FUNCTIONS = {
    "count": lambda c: F.count(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "approx_count_distinct": lambda c: F.approx_count_distinct(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def measure(spec: str | tuple[str, str]) -> Column:
    """"count", or ("sum", field) and the like."""
    name, column = (spec, "*") if isinstance(spec, str) else spec
    if name not in _FUNCTIONS:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(_FUNCTIONS)}")
    return _FUNCTIONS[name](F.lit(1) if column == "*" else F.col(column))


def grouped(df: DataFrame, by: list[str], measures: dict, having: dict | None = None) -> DataFrame:
    """Measures by the named fields (none: over all rows); having holds tests of measures, written as in a where."""
    out = df.groupBy(*by).agg(*(measure(m).alias(n) for n, m in measures.items()))
    for name, test in (having or {}).items():
        out = out.where(field_predicate(F.col(name), test))
    return out


def over_relation(catalog: Catalog, tables, df: DataFrame, collection: Collection, relation: str, where: dict, measures: dict) -> DataFrame:
    """df with measures of each row's related rows: these are summed by foreign key first, so no row of df is multiplied. Counts of none are 0."""
    r = collection.relation(relation)
    if r.kind != "many":
        raise ValueError(f"{collection.name}.{relation} is a one-relation")
    child = catalog[r.target]
    rows = filtered(catalog, tables, tables[child.name], child, where).where(F.col(r.key).isNotNull())
    sums = grouped(rows, [r.key], measures).withColumnRenamed(r.key, "__fk")
    out = df.join(sums, F.col(collection.pk) == F.col("__fk"), "left").drop("__fk")
    counts = [n for n, m in measures.items() if (m if isinstance(m, str) else m[0]).endswith(("count", "count_distinct"))]
    return out.fillna(0, counts) if counts else out
