"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import slices, small_batches, spool
from tideframe.llm.labelled import SAMPLE_CHARS, SAMPLE_ROWS, fold, labelled_sample

# Insults that seed the lexicon, and words of the second person.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting dumb jerk fool filth garbage imbecile".split()
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tuyo usted ustedes vosotros".split())

LEXICON_ENTRIES = 600
PREFIXES = (5, 6, 7, 8)
CACHED_TOKENS = 200_000
_WORD = re.compile(r"\S+")
_TRIM = re.compile(r"^\W+|\W+$")
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ("words", "seed density", "lexicon density", "stem density", "densest window", "second person near", "second person", "capitals", "exclamation", "punctuation", "obfuscation", "plain form hits", "weighted density")


def forms(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its longer prefixes (marked by a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> list[str]:
    return [w for x in _WORD.findall(text.lower()) if (w := _TRIM.sub("", x))]


def learn_lexicon(sample: DataFrame, entries: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Log odds of forms that toxic rows of the sample use far more often, weighted by how much they tell; at most `entries`."""
    def count(batches):
        for pdf in batches:
            used: dict[tuple[str, int], int] = Counter()
            docs: dict[tuple[str, int], int] = Counter()
            for text, label in zip(pdf["text"], pdf["label"]):
                mine = Counter(f for w in words_of(text) for f in forms(w))
                for f, n in mine.items():
                    used[f, label] += n
                    docs[f, label] += 1
                used["", label] += sum(n for f, n in mine.items() if not f.endswith("*"))
            yield pd.DataFrame([(f, int(y), n, docs[f, y]) for (f, y), n in used.items()], columns=["form", "label", "n", "docs"])

    sums = sample.select("text", "label").mapInPandas(count, "form string, label int, n long, docs long")
    one = lambda what, y: F.sum(F.when(F.col("label") == y, F.col(what)).otherwise(0))
    both = spool(sums.groupBy("form").agg(one("n", 1).alias("bad"), one("n", 0).alias("good"), one("docs", 1).alias("bad_docs")).where("form = '' or bad_docs >= 3"))
    totals = both.where("form = ''").first()
    if totals is None or not totals["bad"]:
        return {}
    odds = F.log((F.col("bad") + 0.5) / F.lit(float(totals["bad"]))) - F.log((F.col("good") + 0.5) / F.lit(float(max(1, totals["good"]))))
    top = both.where("form <> ''").withColumn("odds", odds).where("odds > 1.8").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "form").limit(entries).toPandas()
    return {f: float(o) for f, o in zip(top["form"], top["odds"])}


class TokenFacts(dict):
    """What one token adds to the features: None, or (capitals, second person, seed, strange, plain, stem, weight); holds a bounded number of tokens."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        found = self.of(token)
        found = found if any(found) else None
        if len(self) < CACHED_TOKENS:
            self[token] = found
        return found

    def of(self, token: str) -> tuple:
        word = _TRIM.sub("", token.lower())
        best, stem, strange, plain = self.lexicon.get(word, 0.0), False, False, False
        for k in PREFIXES:
            if len(word) > k and (o := self.lexicon.get(word[:k] + "*", 0.0)) > best:
                best, stem = o, True
        seed = word in _SEEDS
        if seed:
            best = max(best, 3.0)
        elif word and not word.isalpha():
            bare = "".join(c for c in word.translate(_PLAIN) if c.isalpha())
            strange = any(c.isalpha() for c in word)
            if bare != word and (bare in _SEEDS or self.lexicon.get(bare, 0.0) > 2):
                plain, best = True, max(best, 3.0)
        return token.isupper() and len(token) > 1, word in SECOND_PERSON, seed, strange, plain, stem, best


def features(text: str, facts: TokenFacts) -> list[float]:
    raw = _WORD.findall(text)
    n = len(raw) or 1
    hits, seed, stems, plain, weight, strange, caps, second = [], 0, 0, 0, 0.0, 0, 0, []
    for i, found in enumerate(map(facts.__getitem__, raw)):
        if found is None:
            continue
        caps, seed, strange, plain = caps + found[0], seed + found[2], strange + found[3], plain + found[4]
        if found[1]:
            second.append(i)
        if found[6] > 0:
            hits.append(i)
            stems += found[5]
            weight += found[6]
    near = densest = 0
    if hits:
        at = np.array(hits)
        densest = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
        if second:
            near = _near(at, np.array(second))
    chars = len(text) or 1
    return [math.log1p(len(raw)), seed / n, (len(hits) - stems) / n, stems / n, float(densest), near / n, len(second) / n, caps / n, text.count("!") / chars, sum(text.count(c) for c in ".,;:?#$%&*|") / chars, strange / n, plain / n, weight / n]


def _near(at: np.ndarray, second: np.ndarray, reach: int = 6) -> int:
    """How many of the (ascending) places second have one of the (ascending) places at within reach."""
    return int((np.searchsorted(at, second + reach, "right") > np.searchsorted(at, second - reach)).sum())


_SEEDS = frozenset(INSULTS)


def featured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """docs with a column `features`, a vector; a null text counts as empty."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    keep = [i for i, c in enumerate(docs.columns) if c != "text"]
    names = [docs.columns[i] for i in keep] + ["x"]
    schema = f"{', '.join(f'`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}' for i in keep)}, x array<double>"

    def run(batches):
        facts = TokenFacts(lexicon)
        for batch in slices(batches):
            x = [features(t or "", facts) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(x, pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(run, schema).withColumn("features", array_to_vector("x")).drop("x")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, trees: int = 20, depth: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: score is the calibrated chance that `toxic` is 1.

    Learned from at most `rows` labelled rows that are not held out: folds 2 to 4 make the lexicon and the trees, fold 1 the isotonic calibration.
    Texts are read whole. Null and empty texts get the score of an empty text; repeated rows each get one; with one class only (or no
    labels) every score is that class's share (0 without labels). Only doc_id and text are read, so other columns may have any name.
    """
    sample = spool(labelled_sample(docs, labels, "toxic", rows, chars).coalesce(8))
    out = docs.select("doc_id", "text")
    counts = {(r["learn"], r["label"]): r["count"] for r in sample.groupBy((F.col("fold") != 1).alias("learn"), "label").count().collect()}
    has = [[counts.get((k, y), 0) for y in (0, 1)] for k in (True, False)]
    good, bad = (has[0][y] + has[1][y] for y in (0, 1))
    if not good or not bad:
        scored = out.select("doc_id", F.lit(float(bool(bad))).alias("score"))
    else:
        split = min(has[0]) > 0 and min(has[1]) > 4
        learn, check = (sample.where("fold <> 1"), sample.where("fold = 1")) if split else (sample, sample)
        lexicon = learn_lexicon(learn)
        # The lexicon fits the rows it was learned from too well; the trees see features by that lexicon all the same, and the calibration does not.
        train = spool(featured(learn.select("text", F.col("label").cast("double").alias("label")), lexicon))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=11).fit(train)
        chance = lambda df: model.transform(df).withColumn("chance", vector_to_array("probability")[1])
        curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(chance(featured(check.select("text", F.col("label").cast("double").alias("label")), lexicon)).select("chance", "label"))
        scored = curve.transform(chance(featured(out, lexicon)).select("doc_id", "chance")).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
