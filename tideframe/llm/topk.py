"""Exact top-k search: matrix products of query tiles and shards, selection per tile, merging up a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import spool

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
STRIP_ROWS = 128
FAN_IN = 16
ROUND_BYTES = 8_000_000


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, vector array<long>): floor(scale * component); vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.where(F.col(vec_id).isNotNull() & fine & (F.size(x) > 0)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("vector"))


_BLOCK = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("matrix", pa.binary())])
_BLOCK_DDL = "dim int, kind string, ids binary, matrix binary"


def _blocks(rows: int):
    """Packs rows into blocks of at most so many vectors of one length, as bytes of the narrowest whole numbers that hold them."""

    def pack(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids = np.concatenate([i for i, _ in held[dim]])
            matrix = np.concatenate([m for _, m in held.pop(dim)])
            order = np.argsort(ids, kind="stable")
            kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((dim, kind, ids[order].tobytes(), matrix[order].astype(kind).tobytes()), _BLOCK)], schema=_BLOCK)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            dims = np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for k in range(0, len(mine), rows):
                    part = mine[k : k + rows]
                    held.setdefault(int(dim), []).append((ids[part], flat[starts[part][:, None] + np.arange(dim)]))
                    if sum(len(i) for i, _ in held[int(dim)]) >= rows:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return pack


def unpacked(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a block."""
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["matrix"], block["kind"]).reshape(-1, block["dim"])


def products(left: np.ndarray, right: np.ndarray, strip: int):
    """Strips of inner products as 64-bit integers: by floats as long as every sum stays exact in them."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    largest = most(left) * most(right) * right.shape[1]
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    left, right = left.astype(kind), right.astype(kind).T
    for at in range(0, len(left), strip):
        yield at, (left[at : at + strip] @ right).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids (which are ascending)."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(ids) - k)[len(ids) - k]
        keep = np.flatnonzero(scores >= cut)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_TOP = pa.schema([("query_id", pa.int64()), ("twin", pa.int64()), ("shard", pa.int64()), ("top", pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())])))])
_TOP_DDL = "query_id long, twin long, shard long, top array<struct<minus: long, vec_id: long>>"


def _tiles(asked: list[dict], k: int):
    """Each shard of a task against every block of queries; of all its shards the task keeps k hits for a query and gives them as one list."""
    def run(batches):
        queries = [unpacked(block) for block in asked]
        tops: list[list] = [[None] * len(ids) for ids, _ in queries]
        for batch in batches:
            for shard in batch.to_pylist():
                ids, right = unpacked(shard)
                for n, (own, left) in enumerate(queries):
                    if asked[n]["dim"] != shard["dim"]:
                        continue
                    for at, scores in products(left, right, STRIP_ROWS):
                        for i, row in enumerate(scores, at):
                            mine = ids != own[i]
                            s, v = best(row[mine], ids[mine], k)
                            if tops[n][i] is not None:
                                s, v = np.concatenate([tops[n][i][0], s]), np.concatenate([tops[n][i][1], v])
                                order = np.lexsort((v, -s))[:k]
                                s, v = s[order], v[order]
                            tops[n][i] = (s, v)
        part = TaskContext.get().partitionId()
        for n, (own, _) in enumerate(queries):
            rows = [(int(own[i]), n << 32 | i, part, [{"minus": -int(a), "vec_id": int(b)} for a, b in zip(*top)]) for i, top in enumerate(tops[n]) if top is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOP)], schema=_TOP)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """For each query (vec_id, vector) its k highest inner products over candidates (vec_id, vector): (query_id, rank, vec_id, score).

    Candidates are packed into shards where they lie, as a written table of narrow integers, and are never shuffled. Queries go to them, in rounds of about `round_bytes` each, so what
    the driver holds and sends does not grow. A tile, one block of queries against one shard, is one matrix product, of which each query keeps its k best;
    a task merges its shards' lists, and the tasks' lists are merged up a tree of fan-in 16. Each round's answers are a written table.
    Ties go to the smaller vec_id. A candidate with the query's own vec_id is left out. Vectors meet only those of their own length. Scores are exact: products run in
    floats while every sum is exact in them, in 64-bit integers (wrapping) beyond. Repeated candidate rows each count; repeated queries are answered once;
    different query vectors with one vec_id each get their list. Only vec_id and vector are read. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    shards = spool(candidates.select("vec_id", "vector").mapInArrow(_blocks(block_rows), _BLOCK_DDL))
    asked = spool(queries.select("vec_id", "vector").distinct().mapInArrow(_blocks(query_rows), _BLOCK_DDL))
    size = asked.agg(F.sum(F.length("matrix") + F.length("ids"))).first()[0] or 0
    rounds, out = -(-size // round_bytes), None
    for turn in range(rounds):
        blocks = [r.asDict() for r in asked.where(F.pmod(F.xxhash64("ids", "matrix"), F.lit(rounds)) == turn).collect()]
        if not blocks:
            continue
        tiles = shards.mapInArrow(_tiles(blocks, k), _TOP_DDL)
        tops, parts = tiles, tiles.rdd.getNumPartitions()
        while True:
            tops = tops.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("query_id", "twin", "shard").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
            parts = -(-parts // FAN_IN)
            if parts <= 1:
                break
        found = spool(tops.select("query_id", F.posexplode("top").alias("place", "hit")))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all rows; k = 20, components as floor(64 * x)."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
