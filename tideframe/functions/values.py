"""Coercions of written values, and small helpers on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A number, null where there is none."""
    return c.try_cast("double")


def to_boolean(c: Column) -> Column:
    """True for the text "true" in any case."""
    return F.lower(c.cast("string")) == "true"


def to_moment(c: Column) -> Column:
    """A timestamp from ISO text, null where it is none."""
    return F.try_to_timestamp(c)


def json_field(c: Column, path: str) -> Column:
    """The text at a path of a JSON column."""
    return F.get_json_object(c, path)


def starts_with(c: Column, prefix: str) -> Column:
    """Prefix test without regard to case."""
    return F.lower(c).startswith(prefix.lower())


def contains(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def ends_with(c: Column, suffix: str) -> Column:
    return F.lower(c).endswith(suffix.lower())


def same(a: list[str], b: list[str]) -> Column:
    """Whether two lists of columns are equal one by one; null equals null."""
    return reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b)), F.lit(True))


def structural_hash(*columns: str) -> Column:
    """A 64-bit hash of whole values, nested ones too."""
    return F.xxhash64(F.to_json(F.struct(*columns)))
