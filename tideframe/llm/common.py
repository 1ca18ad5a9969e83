"""Pieces that several corpus operators share: word hashes, spooled tables, bounded bitmaps, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, for bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MULTIPLIER = 0x9E3779B97F4A7C15
_CACHED_WORDS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spool-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spool(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives lost executors.

    What was shuffled to make it is not needed any more; Spark deletes such files when the driver's JVM collects the plan, which is asked for here, as it may else take half an hour.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default of 10,000, which would take too much memory beside the heap; a setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def slices(batches, rows: int = 1000):
    """The batches in parts of at most so many rows: what a task holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hashes of words (bytes); holds a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHED_WORDS:
            self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """x with all bits spread (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n items, by doubling; empty where there are fewer."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, done, width, power = None, 0, 1, h
    while True:
        if n & width:
            part = power[done : done + count]
            out = part if out is None else out * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + part
            done += width
        if done == n:
            return mixed(out)
        power = power[:-width] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + power[width:]
        width *= 2


def bitmap(keys: DataFrame, key: str, log2_bits: int) -> np.ndarray:
    """A bitmap (uint64 words) of fixed size with the top bits of every 64-bit key set; at most 2**log2_bits / 64 rows reach the driver."""
    place = F.shiftrightunsigned(F.col(key), 64 - log2_bits)
    words = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class Chosen:
    """Part of a set of keys as a bitmap of fixed size: those of one round, at most about one bit in eight."""

    def __init__(self, bits: np.ndarray, rounds: int, turn: int):
        self.bits, self.rounds, self.turn = bits, rounds, turn

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be in the set and are of this round; never false for one that is."""
        found = in_bitmap(self.bits, h)
        return found & (h % np.uint64(self.rounds) == self.turn) if self.rounds > 1 else found


def chosen(keys: DataFrame, key: str, log2_bits: int) -> list[Chosen]:
    """Distinct 64-bit keys as bitmaps, in as many rounds as it takes to keep each sparse, however many keys there are."""
    rounds = max(1, -(-keys.count() // (1 << (log2_bits - 3))))
    unsigned = F.expr(f"cast(conv(hex({key}), 16, 10) as decimal(20))")
    return [Chosen(bitmap(keys if rounds == 1 else keys.where(unsigned % rounds == turn), key, log2_bits), rounds, turn) for turn in range(rounds)]


def over_rounds(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def id_hash(column: str | Column) -> Column:
    """The 64-bit hash by which ids are put into bitmaps."""
    return F.xxhash64(column)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links by alternating large and small stars: (node, root), root the smallest node.

    Each round is two joins and two aggregations with partial sums; the graph's nodes never meet in one task.
    """
    edges = spool(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = spool(small.select("e.u", "e.v").where("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
