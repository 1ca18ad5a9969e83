"""Tracked queries over a stream of writes: each micro-batch is one step from one state to the next."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators.merge import LOG_SCHEMA, Overlaid, empty_log, overlaid
from tideframe.plans.planner import plan
from tideframe.plans.request import QueryRequest, dependencies
from tideframe.schema import Catalog
from tideframe.sources.tables import Cached
from tideframe.streaming.scope import DELTA_SCHEMA, deltas, inserts

log = logging.getLogger(__name__)


class LiveQueries:
    """Tracks requests over base tables and a log of writes kept in a folder that driver and executors share.

    Batch k is written to `log/batch=k` and its deltas to `deltas/batch=k`, both by overwriting, so a batch that runs again after a failure
    gives the same files. Every `fold_every` batches the log so far is written as its last writes only, `folded/upto=k`, so that a batch reads one fold and a few
    batches, whatever came before. Equal requests are tracked once and counted. A batch's deltas are net: what lies between its ends is not told.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, base, folder: str, fold_every: int = 16):
        self.spark, self.catalog, self.base, self.folder, self.fold_every = spark, catalog, base, folder.rstrip("/"), fold_every
        self.requests: dict[str, QueryRequest] = {}
        self._listeners: dict[str, list[Callable[[DataFrame], None]]] = {}
        self._batches = 0

    def track(self, request: QueryRequest, listener: Callable[[DataFrame], None] | None = None, first: bool = False) -> str:
        """Starts to track a request; returns its key. Every batch's deltas go to the listener as a DataFrame; with first, the present rows before them, as inserts."""
        key = request.key()
        self.requests[key] = request
        if first and listener:
            listener(inserts(self.catalog, request, Cached(self.state(1 << 62)), key))
        self._listeners.setdefault(key, []).append(listener)
        return key

    def untrack(self, key: str, listener: Callable[[DataFrame], None] | None = None) -> None:
        """Takes a listener off; the request goes with its last one."""
        self._listeners[key].remove(listener)
        if not self._listeners[key]:
            del self._listeners[key], self.requests[key]

    def log_before(self, batch: int) -> DataFrame:
        """The writes of earlier batches; of those that are folded only the last of each field."""
        if not self._exists(f"{self.folder}/log"):
            return empty_log(self.spark)
        upto = max((k for k in self._folds() if k <= batch), default=0)
        rest = self.spark.read.schema(f"{LOG_SCHEMA}, batch long").parquet(f"{self.folder}/log").where((F.col("batch") >= upto) & (F.col("batch") < batch)).drop("batch")
        return rest.unionByName(self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.folder}/folded/upto={upto}")) if upto else rest

    def fold_log(self, upto: int) -> None:
        """Writes the last write of each field before a batch; the fold before it and the batches since are all that is read."""
        cell = F.max(F.struct(F.coalesce("ts", F.lit("")).alias("at"), "seq", "value", "ts", "origin")).alias("x")
        last = self.log_before(upto).groupBy("resource", "id", "field").agg(cell)
        last.select("x.seq", "resource", "id", "field", "x.value", "x.ts", "x.origin").write.mode("overwrite").parquet(f"{self.folder}/folded/upto={upto}")

    def _folds(self) -> list[int]:
        """The folds that are written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/folded")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return [int(f.getPath().getName().removeprefix("upto=")) for f in files.listStatus(path) if self._exists(f"{f.getPath()}/_SUCCESS")]

    def state(self, batch: int) -> Overlaid:
        """The tables as they are before a batch."""
        return Overlaid(self.catalog, self.base, self.log_before(batch))

    def result(self, key: str) -> DataFrame:
        """A tracked request's rows as of now."""
        return plan(self.catalog, self.state(1 << 62), self.requests[key])

    def process(self, batch_rows: DataFrame, batch: int) -> DataFrame:
        """One batch of writes (LOG_SCHEMA): extends the log, writes the deltas, tells the listeners; returns the deltas."""
        batch_rows.select(*(c.split()[0] for c in LOG_SCHEMA.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        written = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.folder}/log/batch={batch}")
        touched = {r["resource"]: written.where(F.col("resource") == r["resource"]).select("id").distinct() for r in written.select("resource").distinct().collect() if r["resource"] in self.catalog}
        if batch and batch % self.fold_every == 0 and batch not in self._folds():
            self.fold_log(batch)
        earlier = self.log_before(batch)
        before = Overlaid(self.catalog, self.base, earlier)
        after = Overlaid(self.catalog, self.base, earlier.unionByName(written))
        out = f"{self.folder}/deltas/batch={batch}"
        found = None
        for key, request in self.requests.items():
            if not dependencies(self.catalog, request) & set(touched):
                continue
            mine = deltas(self.catalog, request, Cached(before), Cached(after), touched, key)
            found = mine if found is None else found.unionByName(mine)
        (found if found is not None else self.spark.createDataFrame([], DELTA_SCHEMA)).write.mode("overwrite").parquet(out)
        told = self.spark.read.schema(DELTA_SCHEMA).parquet(out)
        for key, listeners in list(self._listeners.items()):
            for listener in filter(None, listeners):
                try:
                    listener(told.where(F.col("query") == key))
                except Exception:  # one listener's failure must not stop the others
                    log.exception("a listener of %s failed", key)
        return told

    def start(self, writes: DataFrame, checkpoint: str, **trigger):
        """Follows a stream of writes; every micro-batch is processed as one step."""
        return writes.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def compact(self, upto: int, folder: str) -> None:
        """Writes the state before a batch as new base tables, so that the log need not be read from its start; the caller then opens LiveQueries on them."""
        for name, c in self.catalog.items():
            overlaid(self.base[name], self.log_before(upto), c).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)


def write_stream(spark: SparkSession, folder: str, format: str = "json", **options) -> DataFrame:
    """A stream of writes from files that are appended to a folder; one file for each transaction keeps it in one batch."""
    return spark.readStream.schema(LOG_SCHEMA).format(format).options(**options).load(folder)
