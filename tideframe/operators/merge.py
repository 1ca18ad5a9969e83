"""Writes as a log of field values, folded by last writer wins, and laid over base tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.schema import Catalog, Collection

#: One written field. seq orders writes with equal ts (the later wins); origin names the request that wrote; values are strings.
LOG_SCHEMA = "seq long, resource string, id string, field string, value string, ts string, origin string"


def log_of(df: DataFrame, collection: Collection, ts: str | Column, seq: str | Column, origin: str | Column | None = None, fields: list[str] | None = None) -> DataFrame:
    """Log rows of a frame of written rows: one for each field that the frame has (pk included, so that a write of the key alone is a row)."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    names = [n for n in (fields or df.columns) if n in collection.fields]
    cells = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(
        column(seq).cast("long").alias("seq"),
        F.lit(collection.name).alias("resource"),
        F.col(collection.pk).cast("string").alias("id"),
        F.explode(cells).alias("cell"),
        column(ts).cast("string").alias("ts"),
        (F.lit(None) if origin is None else column(origin)).cast("string").alias("origin"),
    ).select("seq", "resource", "id", "cell.field", "cell.value", "ts", "origin")


def log_rows(collection: Collection, values: dict[str, Any], ts: str, seq: int, origin: str | None = None) -> list[tuple]:
    """Log rows of one write, given as Python values."""
    key = values[collection.pk]

    def text(v):
        return None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)

    return [(seq, collection.name, str(key), collection.require(n), text(v), ts, origin) for n, v in values.items()]


def fold(log: DataFrame, collection: Collection) -> DataFrame:
    """The last write of each field of each row: (key, one struct (ts, seq, value) per field, null where it was never written).

    One aggregation by id with partial maxima; the order of the log, and repeated log rows, do not matter. A write without ts is older than any with one.
    """
    cell = F.struct(F.coalesce("ts", F.lit("")).alias("ts"), F.col("seq"), F.col("value"))
    mine = log.where((F.col("resource") == collection.name) & F.col("field").isin(list(collection.fields)))
    return mine.groupBy(F.col("id").alias("key")).agg(*(F.max(F.when(F.col("field") == n, cell)).alias(n) for n in collection.fields))


def converted(value: Column, kind) -> Column:
    """A logged string as the field's type; null where it is none."""
    return value.try_cast(kind)


def overlaid(base: DataFrame, log: DataFrame, collection: Collection) -> DataFrame:
    """base with the log's last writes in place, and the rows that only the log has. Base values are older than every logged one.

    Rows that only the log has get the defaults of fields that were not written. Base rows are looked up by key in the folded log, a broadcast while that is small, and keep their
    key as it is, so that what a query asks of keys reaches base; only keys of written rows are looked for in base to tell which are new.
    """
    folded = fold(log, collection).select(F.col("key").alias("__key"), *(F.col(n).alias(f"__{n}") for n in collection.fields))
    pk_type = collection.fields[collection.pk].spark_type
    folded = folded.withColumn("__key", converted(F.col("__key"), pk_type)).where("__key is not null")
    here = base.select(F.col(collection.pk).alias("__here"))
    new = folded.join(here.join(folded.select("__key"), F.col("__here") == F.col("__key"), "left_semi"), F.col("__key") == F.col("__here"), "left_anti")

    def cell(name, old):
        return F.when(F.col(f"__{name}").isNotNull(), converted(F.col(f"__{name}.value"), collection.fields[name].spark_type)).otherwise(old).alias(name)

    def made(old, pk):
        return [F.col(pk).alias(n) if n == collection.pk else cell(n, old(n, f)) for n, f in collection.fields.items()]

    both = base.select(*collection.fields).join(folded, F.col(collection.pk) == F.col("__key"), "left")
    kept = both.select(*made(lambda n, f: F.col(n), collection.pk))
    return kept.unionByName(new.select(*made(lambda n, f: F.lit(f.default).cast(f.spark_type), "__key")))


def write_times(log: DataFrame, collection: Collection) -> DataFrame:
    """When each field of each row was last written: (key, a string per field)."""
    return fold(log, collection).select("key", *(F.col(f"{n}.ts").alias(n) for n in collection.fields))


def accepted(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of incoming that do not lose to what log holds: stored ts later than theirs rejects, an equal one does not."""
    stored = log.groupBy("resource", "id", "field").agg(F.max(F.coalesce("ts", F.lit(""))).alias("stored"))
    return incoming.join(stored, ["resource", "id", "field"], "left").where(F.col("stored").isNull() | F.col("ts").isNull() | (F.col("stored") <= F.col("ts"))).drop("stored")


class Overlaid(Mapping):
    """A source with a log laid over it; collections that the log cannot touch are given as they are."""

    def __init__(self, catalog: Catalog, base, log: DataFrame, resources: set[str] | None = None):
        self.catalog, self.base, self.log, self.resources = catalog, base, log, resources
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            untouched = self.resources is not None and name not in self.resources
            self._made[name] = self.base[name] if untouched else overlaid(self.base[name], self.log, self.catalog[name])
        return self._made[name]

    def __iter__(self):
        return iter(self.catalog)

    def __len__(self):
        return len(self.catalog)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def exploded_loads(nested: DataFrame, catalog: Catalog, resource: str, include: dict) -> list[tuple[str, DataFrame]]:
    """A nested result as flat rows for each collection, deepest level first, each row once."""
    from tideframe.plans.request import sub_query

    c, out = catalog[resource], []
    for name, value in include.items():
        relation = c.relation(name)
        rows = nested.select(F.explode(name).alias("row")) if relation.kind == "many" else nested.select(F.col(name).alias("row")).where("row is not null")
        out += exploded_loads(rows.select("row.*"), catalog, relation.target, sub_query(relation.target, value).include)
    return [*out, (resource, nested.select(*c.fields).dropDuplicates([c.pk]))]
