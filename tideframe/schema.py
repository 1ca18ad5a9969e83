"""Collections, their fields and their one/many relations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

_TYPES = {
    "id": T.StringType(),
    "string": T.StringType(),
    "reference": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "enum": T.StringType(),
    "json": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    """A typed field. `type` is one of the kinds above or any Spark type; values holds what an enum allows."""

    type: str | T.DataType = "string"
    null: bool = True
    default: Any = None
    values: tuple[str, ...] = ()
    unique: bool = False
    index: bool = False
    references: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return _TYPES[self.type] if isinstance(self.type, str) else self.type

    @property
    def required(self) -> bool:
        """Whether an insert must give a value."""
        return not self.null and self.default is None

    def nullable(self) -> Field:
        return replace(self, null=True)

    def defaulting(self, value: Any) -> Field:
        return replace(self, default=value)


@dataclass(frozen=True)
class Relation:
    """`one`: key is the source's foreign key. `many`: key is the target's foreign key to the source."""

    kind: str
    target: str
    key: str


def one(target: str, key: str) -> Relation:
    return Relation("one", target, key)


def many(target: str, key: str) -> Relation:
    return Relation("many", target, key)


@dataclass(frozen=True)
class Collection:
    name: str
    fields: dict[str, Field]
    pk: str = "id"
    relations: dict[str, Relation] = field(default_factory=dict)

    def __post_init__(self):
        if self.pk not in self.fields:
            raise ValueError(f"{self.name} has no field {self.pk!r}")
        if clash := set(self.fields) & set(self.relations):
            raise ValueError(f"{self.name} has fields and relations of one name: {sorted(clash)}")

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, f.spark_type, True) for n, f in self.fields.items()])

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise ValueError(f"{self.name} has no relation {name!r}")
        return self.relations[name]

    def require(self, name: str) -> str:
        if name not in self.fields:
            raise ValueError(f"{self.name} has no field {name!r}")
        return name


class Catalog(dict):
    """Collections by name; every relation's target and key are checked."""

    def __init__(self, *collections: Collection):
        super().__init__({c.name: c for c in collections})
        for c in collections:
            for name, r in c.relations.items():
                if r.target not in self:
                    raise ValueError(f"{c.name}.{name} refers to unknown collection {r.target!r}")
                (c if r.kind == "one" else self[r.target]).require(r.key)

    def __missing__(self, name: str) -> Collection:
        raise ValueError(f"unknown collection {name!r}")


def evolved(df, collection: Collection):
    """df with the collection's columns: missing ones as null (or their default), others dropped. Types that differ are cast, and null where they cannot be."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(n).try_cast(f.spark_type) if n in have else F.lit(f.default).cast(f.spark_type)).alias(n) for n, f in collection.fields.items()))


def mismatches(df, collection: Collection) -> list[str]:
    """What differs between a table and its declaration: missing columns, and types."""
    have = dict(df.dtypes)
    out = [f"{n}: missing" for n in collection.fields if n not in have]
    return out + [f"{n}: {have[n]}, declared {f.spark_type.simpleString()}" for n, f in collection.fields.items() if n in have and have[n] != f.spark_type.simpleString()]
