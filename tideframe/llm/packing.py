"""Packing of token pieces into sequences: first-fit decreasing in randomised groups, with a tournament tree of capacities."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import slices, small_batches, spool

LENGTH = 2048
GROUP_DOCS = 2048
END = 1
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


# The ranks' library backtracks over a run of white space and fails on a very long one.
_LONG_BLANK = re.compile(r"\s{1000}")


class Encoder:
    """Ids of a byte-level BPE vocabulary, as its tokenizers file gives them (the special token's text becomes its one id).

    The same vocabulary as ranks takes a third of the time and gives the same ids; texts with long white space, which it cannot take, go to the tokenizers file itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={SPECIAL: SPECIAL_ID})
        self.whole = tokenizers.Tokenizer.from_file(vocabulary)

    def encode(self, text: str) -> np.ndarray:
        if _LONG_BLANK.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if SPECIAL in text:
            return np.array(self.bpe.encode(text, allowed_special={SPECIAL}), np.uint32)
        return np.array(self.bpe.encode_ordinary(text), np.uint32)


class TournamentTree:
    """Free room of bins at the leaves, the most of any bin below at each node; finds the first bin with enough room."""

    def __init__(self, bins: int, room: int):
        self.base = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.most = [room] * (2 * self.base)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin that has room: (bin, room it had)."""
        most, at = self.most, 1
        while at < self.base:
            at *= 2
            if most[at] < size:
                at += 1
        had = most[at]
        bin_, most[at] = at - self.base, had - size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size (all at most room), largest first."""
    tree = TournamentTree(len(sizes), room)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = room - had
    return bins, offsets


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long, place long"


def token_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Each document's ids (and the end id) cut into pieces of at most `length`: no ids are shuffled, only where they are and their checksum."""
    small_batches(docs.sparkSession)
    vocabulary, ranks = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        encoder = Encoder(vocabulary, ranks)
        for batch in slices(batches):
            out = [[] for _ in range(7)]
            for doc_id, text, group, place in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.append(encoder.encode(text or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for column, value in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), group, place)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group", "place"])

    return docs.mapInArrow(run, _PIECES)


def pack(docs: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, vocabulary: str | None = None, ranks: str | None = None, seed: int = 17) -> DataFrame:
    """Packs every document's ids into sequences of at most `length`: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Documents are dealt at random to groups of about `group_docs`; each group is packed on its own by first-fit decreasing, so the memory of a
    task does not grow with the input, nor does a hot source or a group of copies share a task. The pieces, with the groups they were dealt to, are written as a
    table before they meet, so a task that runs again deals nothing anew. Only pieces at a document's end are shorter than a sequence. Null and empty texts are the end id alone; repeated rows are packed as rows of their own; an empty table gives no rows.
    Only doc_id and text are read, so other columns may have any name.
    """
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(F.rand(seed) * groups).alias("pack_group"), F.monotonically_increasing_id().alias("place"))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=(pdf["pack_group"].to_numpy(np.int64) << 32) + bins, offset=offsets)

    return spool(token_pieces(dealt, length, vocabulary, ranks)).groupBy("pack_group").applyInPandas(pack_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
