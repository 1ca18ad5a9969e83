"""A corpus pipeline: quality, near duplicates, benchmark decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import spool
from tideframe.llm.decontam import matched
from tideframe.llm.jaccard import near_duplicates
from tideframe.llm.packing import pack
from tideframe.llm.quality import QualityModel
from tideframe.llm.secrets import redacted, scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects (score under the threshold). Learns from the labelled rows of docs outside the held-out fold.

    Null and empty texts are judged as an empty text; repeated rows, and rows that share an id, each by their own text; without labels all stay.
    Other columns than those of documents go. An empty table stays empty.
    """
    model = QualityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(docs.select(*COLUMNS)).where(F.col("score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def once_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that have one doc_id (null counts as one) and one text. Only rows whose id stands there twice are moved; copies meet by digest, after one of each task has been kept."""
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    row = F.struct(*(F.col(c) for c in docs.columns))
    kept = docs.join(again, same, "left_semi").groupBy("doc_id", F.md5("text").alias("digest")).agg(F.first(row).alias("row")).select("row.*")
    return spool(docs.join(again, same, "left_anti").unionByName(kept))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, and of repeated rows one.

    Null texts and those without words are linked with nothing and stay, as do rows without a doc_id. Rows that share an id but not the text are one document: they stay or go together.
    Other columns than those of documents go. An empty table stays empty.
    """
    docs = once_each(docs.select(*COLUMNS))
    gone = near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, within its error budget.

    Null and empty texts hold none and stay; repeated rows each stay or go; null and empty items are in no text. Other columns than those of documents go. An empty table stays empty.
    """
    return matched(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("benchmark_matches") == 0).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every stretch that secrets cover in a text by a mark; n_chars follows where a text changed.

    No row goes. Null texts stay null, empty ones empty; repeated rows are changed alike. Other columns than those of documents go. An empty table stays empty.
    """
    text = redacted(F.col("text"), F.col("secret_spans"))
    clean = scan(docs.select(*COLUMNS)).withColumn("clean", text).withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")))
    return clean.withColumn("text", F.col("clean")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens: one row per piece. Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Classifier, edit matching and tokenizer cannot be put in SQL; tests/llm/test_pipeline.py holds each stage against a plain computation of what it must keep and change.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written as a table in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
