"""Where collections come from. A source is anything with `source[name]` → DataFrame; these are the usual ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tideframe.schema import Catalog, evolved


class Files(Mapping):
    """One file or folder for each collection, in any format that Spark reads. Only declared columns are read."""

    def __init__(self, spark: SparkSession, catalog: Catalog, folder: str, format: str = "parquet", suffix: str | None = None, **options):
        self.spark, self.catalog, self.folder, self.format, self.options = spark, catalog, folder.rstrip("/"), format, options
        self.suffix = f".{format}" if suffix is None else suffix

    def __getitem__(self, name: str) -> DataFrame:
        c = self.catalog[name]
        reader = self.spark.read.format(self.format).options(**self.options)
        if self.format in ("csv", "json"):
            reader = reader.schema(c.spark_schema)
        return reader.load(f"{self.folder}/{name}{self.suffix}").select(*c.fields)

    def __iter__(self):
        return iter(self.catalog)

    def __len__(self):
        return len(self.catalog)


class Frames(dict):
    """Frames that are there already; evolve adds columns that a collection declares and its frame lacks."""

    @classmethod
    def evolve(cls, catalog: Catalog, frames: dict[str, DataFrame]) -> Frames:
        return cls({n: evolved(df, catalog[n]) for n, df in frames.items()})

    @classmethod
    def empty(cls, spark: SparkSession, catalog: Catalog) -> Frames:
        return cls({n: spark.createDataFrame([], c.spark_schema) for n, c in catalog.items()})

    @classmethod
    def of_rows(cls, spark: SparkSession, catalog: Catalog, rows: dict[str, list[dict]]) -> Frames:
        return cls({n: spark.createDataFrame([tuple(r.get(f) for f in c.fields) for r in rows.get(n, [])], c.spark_schema) for n, c in catalog.items()})


class Jdbc(Mapping):
    """Tables of a database; filters and columns are pushed down to it by Spark's own source."""

    def __init__(self, spark: SparkSession, catalog: Catalog, url: str, **options):
        self.spark, self.catalog, self.url, self.options = spark, catalog, url, options

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load().select(*self.catalog[name].fields)

    def __iter__(self):
        return iter(self.catalog)

    def __len__(self):
        return len(self.catalog)


class Cached(Mapping):
    """Frames of another source, each made once: one plan has one frame for each collection, so equal exchanges are reused."""

    def __init__(self, source):
        self.source, self._made = source, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.source[name]
        return self._made[name]

    def __iter__(self):
        return iter(self.source)

    def __len__(self):
        return len(self.source)


def register_views(source, names) -> None:
    """Temporary views, for plain SQL beside the builder."""
    for name in names:
        source[name].createOrReplaceTempView(name)
