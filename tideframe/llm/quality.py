"""Quality classifier by compression with dictionaries built from good and bad text."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import slices, small_batches
from tideframe.llm.labelled import SAMPLE_CHARS, SAMPLE_ROWS, fold, labelled_sample

DICTIONARY_BYTES = 112_640
CHUNK_BYTES = 2048
LEVEL = 3


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the texts' chunks; their plain bytes where there are too few to train on."""
    chunks = [b[k : k + 1024] for t in texts if (b := t.encode()) for k in range(0, len(b), 1024)]
    random.Random(5).shuffle(chunks)
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(chunks)[-size:] or b" "


class Compressors:
    """Sizes of a text under either dictionary and under none, in chunks, so that a long text cannot serve as its own dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    def features(self, text: str) -> tuple[float, float, float]:
        """Normalised difference, compressed share, and a term for short texts."""
        raw = text.encode()
        good = bad = plain = 0
        for k in range(0, max(1, len(raw)), CHUNK_BYTES):
            part = raw[k : k + CHUNK_BYTES]
            good, bad, plain = good + len(self.both[0].compress(part)), bad + len(self.both[1].compress(part)), plain + len(self.plain.compress(part))
        return (bad - good) / plain, plain / (len(raw) + 20), 1 / np.sqrt(len(raw) + 20)


class Calibration:
    """Logistic calibration over difference and compressed share, both piecewise linear between quantiles of the rows it learns from, and shortness."""

    QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.01):
        """Learns weights by Newton steps. Inputs outside the range of x count as its ends."""
        self.least, self.most = x.min(0), x.max(0)
        self.knots = np.quantile(x[:, :2], self.QUANTILES, axis=0)
        t = self.terms(x)
        penalty = np.full(t.shape[1], ridge)
        penalty[0] = 1e-6
        self.weights = np.zeros(t.shape[1])
        for _ in range(100):
            p = self.chance(x)
            step = np.linalg.solve((t * (p * (1 - p))[:, None]).T @ t + np.diag(penalty), t.T @ (y - p) - penalty * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def terms(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.least, self.most)
        bends = [np.maximum(x[:, i] - k, 0) for row in self.knots for i, k in enumerate(row)]
        return np.stack([np.ones(len(x)), *x.T, *bends], 1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(x) @ self.weights, -30, 30)))


class Constant:
    """The share of good rows, where there is nothing to tell them by."""

    def __init__(self, share: float):
        self.share = share

    def chance(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


class QualityModel:
    """Two dictionaries and a calibration; small enough to go with each task (about 0.2 MB)."""

    def __init__(self, good: bytes, bad: bytes, calibration: Calibration | Constant):
        self.good, self.bad, self.calibration = good, bad, calibration

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
        """Learns from the bounded sample of labelled rows that are not held out: all texts of folds 2 to 4 make the dictionaries, fold 1 the calibration. With one class only (or none) scores are constant."""
        sample = labelled_sample(docs, labels, "quality", rows, chars).toPandas().sort_values("doc_id", kind="stable")
        learn, check = sample[sample["fold"] != 1], sample[sample["fold"] == 1]
        if len(check) < 20 or check["label"].nunique() < 2 or learn["label"].nunique() < 2:
            learn = check = sample
        if sample["label"].nunique() < 2:
            return cls(b" ", b" ", Constant(float(sample["label"].mean()) if len(sample) else 0.5))
        good, bad = (dictionary(list(learn["text"][learn["label"] == k])) for k in (1, 0))
        sizes = Compressors(good, bad)
        return cls(good, bad, Calibration(np.array([sizes.features(t) for t in check["text"]]), check["label"].to_numpy(float)))

    def scored(self, docs: DataFrame) -> DataFrame:
        """docs with a column `score`, in the place of any that has this name; a null text counts as empty. All other columns stay as they are."""
        small_batches(docs.sparkSession)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema if f.name != 'score')}, score double"
        at, keep, model = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if c != "score"], self
        names = [docs.columns[i] for i in keep] + ["score"]

        def score(batches):
            sizes = Compressors(model.good, model.bad)
            for batch in slices(batches):
                x = np.array([sizes.features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.calibration.chance(x))], names=names)

        return docs.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: score is the calibrated chance that `quality` is 1.

    Texts are compressed whole, chunk by chunk, with a dictionary of good text, one of bad text and none; the difference of the first two,
    divided by the third, goes through a logistic calibration together with the compressed share (repetition compresses far better than
    prose under any dictionary). The model learns from a bounded sample: see labelled_sample for its bounds, which are parameters. Null and empty texts get the score of an empty text; repeated rows each get one; without labels every
    score is 0.5. Only doc_id and text are read, so other columns may have any name.
    """
    model = QualityModel.fit(docs, labels)
    return model.scored(docs.select("doc_id", "text")).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
