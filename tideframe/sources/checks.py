"""What a table's rows break of its declaration: keys and unique fields that stand there twice, references to rows that are not there, missing and foreign values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.schema import Catalog


def duplicates(catalog: Catalog, tables, name: str) -> DataFrame:
    """(field, value, n): values of the primary key and of unique fields that more than one row has. Counted with partial sums, so a hot value is no hot task."""
    c = catalog[name]
    fields = [c.pk, *(n for n, f in c.fields.items() if f.unique and n != c.pk)]
    counts = [tables[name].where(F.col(n).isNotNull()).groupBy(F.col(n).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(n).alias("field"), "value", "n") for n in fields]
    return reduce(DataFrame.unionByName, counts)


def orphans(catalog: Catalog, tables, name: str) -> DataFrame:
    """(field, id, value): foreign keys, of one-relations or declared by `references`, whose row is not there. Null refers to nothing and is no orphan."""
    c = catalog[name]
    targets = {f.references: n for n, f in c.fields.items() if f.references}
    pairs = dict.fromkeys([(r.key, r.target) for r in c.relations.values() if r.kind == "one"] + [(n, t) for t, n in targets.items()])
    out = tables[name].where("false").select(F.lit("").alias("field"), F.col(c.pk).cast("string").alias("id"), F.lit("").alias("value"))
    for key, target in pairs:
        there = tables[target].select(F.col(catalog[target].pk).alias("__there"))
        lost = tables[name].where(F.col(key).isNotNull()).join(there, F.col(key) == F.col("__there"), "left_anti")
        out = out.unionByName(lost.select(F.lit(key).alias("field"), F.col(c.pk).cast("string").alias("id"), F.col(key).cast("string").alias("value")))
    return out


def invalid(catalog: Catalog, tables, name: str) -> DataFrame:
    """(field, id, value): required fields that are null, and values that an enumeration does not list."""
    c = catalog[name]
    bad = [F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value"), (F.col(n).isNull() if f.required else F.lit(False)).alias("missing"), (~F.col(n).isin(*f.values) if f.values else F.lit(False)).alias("foreign")) for n, f in c.fields.items() if f.required or f.values]
    rows = tables[name].select(F.col(c.pk).cast("string").alias("id"), F.explode(F.array(*bad)).alias("x")) if bad else tables[name].where("false").select(F.col(c.pk).cast("string").alias("id"), F.struct(F.lit("").alias("field"), F.lit("").alias("value"), F.lit(False).alias("missing"), F.lit(False).alias("foreign")).alias("x"))
    return rows.where("x.missing or coalesce(x.foreign, false)").select("x.field", "id", "x.value")
