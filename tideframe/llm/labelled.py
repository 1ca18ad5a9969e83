"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import spool

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 200_000
SAMPLE_TOTAL = 64_000_000


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(doc_id, text, label, fold) of at most `rows` labelled documents that are not held out, one row for each id, of at most `total` characters together.

    The rows are those of the smallest id hashes, so the choice neither depends on the labels nor on the partitions; labels that are null
    or contradict each other are left out, as are texts over `chars` characters. Of rows that share an id the least text counts, a null one as empty.
    The sampled ids, at most `rows`, are broadcast; of the documents only theirs are shuffled, one for each task and id. The sample is a written table.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    ids = one.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
    sample = spool(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    # Running sums of at most `rows` lengths, in one task.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    inside = sample.select("doc_id", F.sum(F.length("text")).over(order).alias("upto")).where(F.col("upto") <= total).select("doc_id")
    return sample.join(F.broadcast(inside), "doc_id", "left_semi").select("doc_id", "text", "label", fold().alias("fold"))
