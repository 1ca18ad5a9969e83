"""Benchmark decontamination: pieces of test items found exactly, items verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import slices, small_batches

#: Edits allowed for each character of an item: about one changed word in 16 of six letters. Pieces are then 15 characters or so, long enough to be rare by chance.
ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, with every run of anything but letters and digits as one space."""
    return _OTHER.sub(" ", text.lower()).strip(" ")


def normal_places(text: str) -> tuple[str, list[int]]:
    """normal(text) and where each of its characters stands in text."""
    out, places, gap = [], [], -1
    for i, c in enumerate(text):
        for x in c.lower():
            if _OTHER.match(x):
                gap = i if gap < 0 else gap
            else:
                if gap >= 0 and out:
                    out.append(" ")
                    places.append(gap)
                gap = -1
                out.append(x)
                places.append(i)
    return "".join(out), places


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern of length m that ends in text, the first of the best; anchored: it starts at text's start."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly one length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Matcher:
    """Finds items (id, normalised text, how often it stands in the benchmark) with at most rate * length edits."""

    def __init__(self, items: list[tuple[int, str, int]], rate: float = ERROR_RATE):
        self.items = [(i, t, int(len(t) * rate)) for i, t, _ in items if t]
        self.times = [n for _, t, n in items if t]
        self.peq: dict[int, tuple[dict, dict]] = {}
        at: dict[str, list] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in split(t, k):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The best match of each item in a text, if within its budget: item_id, distance, start, end (code points of text)."""
        if not self.items:
            return []
        plain = normal(text)
        windows: dict[int, list] = {}
        for last, (size, where) in self.automaton.iter(plain):
            for n, offset in where:
                m, k = len(self.items[n][1]), self.items[n][2]
                low = last + 1 - size - offset - k
                mine = windows.setdefault(n, [])
                if mine and low <= mine[-1][1]:
                    mine[-1] = (min(low, mine[-1][0]), max(mine[-1][1], low + m + 2 * k))
                else:
                    mine.append((low, low + m + 2 * k))
        out, places = [], None
        for n, mine in windows.items():
            item_id, t, k = self.items[n]
            if n not in self.peq:
                self.peq[n] = (masks(t), masks(t[::-1]))
            best = None
            for low, high in mine:
                low = max(0, low)
                distance, end = myers(self.peq[n][0], len(t), plain[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                distance, end = best
                length = myers(self.peq[n][1], len(t), plain[max(0, end - len(t) - k) : end][::-1], anchored=True)[1]
                if places is None:
                    places = normal_places(text)[1]
                out += [{"item_id": item_id, "distance": distance, "start": places[end - length], "end": places[end - 1] + 1}] * self.times[n]
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"]))


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_MATCH_DDL = "array<struct<item_id: long, distance: long, start: long, end: long>>"


def matched(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with a column `benchmark_matches`: array of (item_id, distance, start, end), one for each item of benchmark found in the text.

    Item and text are compared in lower case with every run of other characters than letters and digits as one space. An item of n such characters is
    found where some part of the text is within floor(rate * n) insertions, deletions and replacements: of its pieces, one more than that many, at least one must occur exactly.
    Of an item's matches the one with the least distance counts, of equal ones the one that ends first. Texts are read whole, however long.
    Items go to the tasks in blocks of about block_chars characters, equal rows once, whose size is summed beforehand; a longer benchmark takes more passes. Distances run
    character by character in Python, over the stretches around piece hits only. Columns of docs stay, whatever their names; one named benchmark_matches is replaced.
    Null and empty texts have no match; null and empty items, and those without a letter or digit, are in no text; repeated rows and items each count. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).groupBy("item_id", "text").agg(F.count("*").alias("times"))
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    at = docs.columns.index("text")
    for block in range(blocks):
        mine = [(r["item_id"], normal(r["text"]), r["times"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        keep = [i for i, c in enumerate(docs.columns) if c != "benchmark_matches"]
        schema = f"{', '.join(f'`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}' for i in keep)}, benchmark_matches {_MATCH_DDL}"

        def run(batches, mine=mine, keep=keep, names=tuple(docs.columns), earlier="benchmark_matches" in docs.columns if block else False):
            matcher = Matcher(mine, rate)
            for batch in slices(batches):
                found = [matcher.find(t) if t else [] for t in batch.column(at).to_pylist()]
                if earlier:
                    found = [a + b for a, b in zip(batch.column(names.index("benchmark_matches")).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found, _MATCH)], names=[*(names[i] for i in keep), "benchmark_matches"])

        docs = docs.mapInArrow(run, schema)
        at = docs.columns.index("text")
    return docs


def op5(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, span_start, span_end) for each benchmark item found in a document."""
    found = matched(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.item_id", "m.distance", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"))
