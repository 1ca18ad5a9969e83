"""Substring dedup: suffixes split by prefixes of variable length into memory-sized groups; the deep internal nodes of each group's suffix tree are the repeats."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import WordHashes, bitmap, in_bitmap, run_hashes, slices, small_batches, spool, word_hashes

WINDOW = 35
PREFIX = 12
LOG2_BITS = 26
CHUNK = 1_000_000
GROUPS = 256
GROUP_SUFFIXES = 250_000
HOT = 30_000
LOG2_HOT_BITS = 22


def sampled(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, places): for each window, hash and place of its sampled suffix, the one whose first `prefix` words have the least hash of all runs inside the window (the first of equals).

    Equal windows sample at equal offsets, so the suffixes that start there meet in one prefix group.
    """
    values = run_hashes(h, prefix)
    places, width, want = np.arange(len(values)), 1, window - prefix + 1
    while width < want:
        step = min(width, want - width)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] < values[left], right, left)
        width += step
    return values[places], places


def prefix_counts(window: int, prefix: int):
    """(prefix, n, suffixes) of each slice of rows: sampled prefixes, in how many places (2 stands for more), and how many suffixes of different texts are under them."""
    def count(batches):
        cache = WordHashes()
        for batch in slices(batches):
            values, times, under = [], [], []
            for text, copies in Counter(batch.column(0).to_pylist()).items():
                words = text.encode().split() if text else ()
                if len(words) < window:
                    continue
                value, place = sampled(word_hashes(words, cache), window, prefix)
                cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                values.append(value[cut])
                times.append(np.full(len(cut), min(copies, 2.0)))
                under.append(np.diff(np.append(cut, len(place))).astype(float))
            if values:
                value, at = np.unique(np.concatenate(values), return_inverse=True)
                n = np.minimum(np.bincount(at, np.concatenate(times)), 2).astype(np.int8)
                suffixes = np.bincount(at, np.concatenate(under)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n), pa.array(suffixes)], names=["prefix", "n", "suffixes"])

    return count


_DEALT = pa.schema([("part", pa.int32()), ("digests", pa.binary()), ("starts", pa.binary()), ("stops", pa.binary()), ("words", pa.binary())])
_DEALT_DDL = "part int, digests binary, starts binary, stops binary, words binary"
_RUNS = pa.schema([("digest", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])
_RUNS_DDL = "digest binary, start long, stop long"


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs start..stop-1 with those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def dealt_suffixes(bits: np.ndarray, hot: np.ndarray, rounds: int, turn: int, window: int, prefix: int, groups: int, chunk: int):
    """For each part of a chunk of rows one row of stretches (digest of the text, start, stop, words): the suffixes start..stop-1 that one sampled prefix covers, with their words up to the depth `window`.

    They go to the group of that prefix. Under a hot prefix each suffix goes to the group of its own longer prefix, all `window` words, so that what follows parts them.
    Of equal stretches in a chunk of rows one goes out; all of them are repeats, which rows without words tell. Words travel compressed.
    """
    def flush(held):
        packer = zstandard.ZstdCompressor()
        parts: dict[bytes, list[tuple[bytes, int, int, int, int]]] = {}
        for digest, times, start, stop, part, words in held:
            parts.setdefault(words, []).append((digest, times, start, stop, part))
        sent: dict[int, list] = {}
        known: dict[bytes, list[tuple[int, int]]] = {}
        for words, places in parts.items():
            digest, times, start, stop, part = places[0]
            sent.setdefault(part, []).append((digest, start, stop, words))
            if len(places) > 1 or times > 1:
                for digest, _, start, stop, _ in places:
                    known.setdefault(digest, []).append((start, stop))
        told: dict[int, list] = {}
        for digest, runs in known.items():
            told.setdefault(int.from_bytes(digest[:4]) % groups, []).extend((digest, a, b) for a, b in merged(runs))
        for rows, full in ((sent, True), (told, False)):
            for part, mine in rows.items():
                digests, starts, stops, *words = zip(*mine)
                blob = packer.compress(b"\n".join(words[0])) if full else None
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, b"".join(digests), np.array(starts, np.int64).tobytes(), np.array(stops, np.int64).tobytes(), blob), _DEALT)], schema=_DEALT)

    def deal(batches):
        cache, held, size, seen = WordHashes(), [], 0, {}
        for batch in slices(batches):
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                if digest in seen:
                    for entry in seen[digest]:
                        entry[1] += 1
                    continue
                mine = seen[digest] = []
                words = text.encode().split()
                if len(words) < window:
                    continue
                h = word_hashes(words, cache)
                value, place = sampled(h, window, prefix)
                live = in_bitmap(bits, value)
                if rounds > 1:
                    live &= value % np.uint64(rounds) == turn
                if not live.any():
                    continue
                split = in_bitmap(hot, value)
                own = run_hashes(h, window) if (split & live).any() else value
                cut = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | split[1:]))
                for a, b in zip(cut.tolist(), np.append(cut[1:], len(value)).tolist()):
                    if live[a]:
                        key = own[a] if split[a] else value[a]
                        mine.append([digest, 1, a, b, int(key % np.uint64(groups)), b" ".join(words[a : b - 1 + window])])
                        size += b - a
                held += mine
            if size + 20 * len(seen) >= chunk:
                yield from flush(held)
                held, size, seen = [], 0, {}
        yield from flush(held)

    return deal


def suffix_tree(words: np.ndarray, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the leaves (places in words) in the order of their suffixes, and how many words each shares with the one before it, at most `depth`.

    These are the tree's leaves from left to right and the depths of their lowest common ancestors: internal nodes of depth d and more are the runs where common >= d.
    Ranks of runs of 1, 2, 4, ... words, by doubling, sort the suffixes; the same ranks, taken from the longest down, tell what neighbours share. Words are whole numbers, and so is equality exact.
    Each leaf must have `depth` words before any end of a stretch, so that what follows does not matter.
    """
    ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * width <= depth:
        last = ranks[-1]
        pair = last[:-width] * (last.max() + 1) + last[width:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        width *= 2
    top = ranks[-1]
    # Two runs of `width` words, the second from `depth - width` on, make up the first `depth` words.
    order = leaves[np.lexsort((leaves, top[leaves + depth - width], top[leaves]))]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    at = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            fits = at + (1 << k) <= depth
            i = np.flatnonzero(fits)
            same = ranks[k][a[i] + at[i]] == ranks[k][b[i] + at[i]]
            at[i[same]] += 1 << k
    common[1:] = at
    return order, common


def deep_leaves(common: np.ndarray, depth: int) -> np.ndarray:
    """Which leaves (in order) lie below an internal node of at least that depth: they share so many words with a neighbour."""
    deep = common >= depth
    return deep | np.append(deep[1:], False)


def repeats(stretches: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each different stretch of words the runs (from, to) of its suffixes whose first `window` words also start another suffix of these stretches, by their suffix tree."""
    ids: dict[bytes, int] = {}
    split = [b.split() for b in stretches]
    sizes = np.array([len(s) for s in split])
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(sizes.sum()))
    del split
    first, count = np.cumsum(sizes) - sizes, sizes - window + 1
    leaves = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    order, common = suffix_tree(words, leaves, window)
    found = np.sort(order[deep_leaves(common, window)])
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    if len(found):
        row = np.searchsorted(first, found, "right") - 1
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (found[1:] != found[:-1] + 1)))
        for r, a, n in zip(row[cut].tolist(), (found[cut] - first[row[cut]]).tolist(), np.diff(np.append(cut, len(found))).tolist()):
            out[r].append((a, a + n))
    return out


def _group_repeats(window: int):
    def of_group(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        runs: dict[bytes, list[tuple[int, int]]] = {}
        places: dict[bytes, list[tuple[bytes, int, int]]] = {}
        for digests, starts, stops, words in zip(*(table[c].to_pylist() for c in ("digests", "starts", "stops", "words"))):
            mine = [(digests[16 * i : 16 * i + 16], a, b) for i, (a, b) in enumerate(zip(np.frombuffer(starts, np.int64).tolist(), np.frombuffer(stops, np.int64).tolist()))]
            if words is None:
                for digest, a, b in mine:
                    runs.setdefault(digest, []).append((a, b))
            else:
                for place, stretch in zip(mine, unpacker.decompress(words).split(b"\n")):
                    places.setdefault(stretch, []).append(place)
        stretches = list(places)
        for stretch, found in zip(stretches, repeats(stretches, window) if stretches else ()):
            for digest, a, b in places[stretch]:
                # Equal stretches repeat whole; of one alone, what the tree finds.
                runs.setdefault(digest, []).extend([(a, b)] if len(places[stretch]) > 1 else [(a + x, a + y) for x, y in found])
        rows = [(digest, a, b) for digest, mine in runs.items() for a, b in merged(mine)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _RUNS)], schema=_RUNS)

    return of_group


def repeated_runs(texts: DataFrame, window: int = WINDOW, prefix: int = PREFIX, log2_bits: int = LOG2_BITS, group_suffixes: int = GROUP_SUFFIXES, hot_suffixes: int = HOT) -> DataFrame:
    """(digest, start, stop): the suffixes start..stop-1 of texts (digest, text) whose first `window` words also start a suffix elsewhere; rows may repeat.

    1. Every window samples one suffix inside it by the suffix's first `prefix` words. These prefixes are counted, and only those in two places or more go on:
       which they are goes to the tasks as a bitmap of fixed size, in as many rounds as it needs to stay sparse.
    2. A prefix takes all suffixes that it covers, with their words, to its group; a group holds about `group_suffixes`. Prefixes of more than `hot_suffixes` are
       too short: the suffixes under them are dealt by all of their first `window` words instead. No passage, however common, fills a group, and nothing is dropped.
    3. A group's suffixes are sorted into a suffix tree, in words and not in hashes. Those below an internal node of depth `window` or more are the repeats.
       Trees are followed to that depth only, since it decides; a longer repeat is a run of consecutive suffixes.
    """
    small_batches(texts.sparkSession)
    counts = texts.select("text").mapInArrow(prefix_counts(window, prefix), "prefix long, n byte, suffixes long")
    shared = spool(counts.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("suffixes").alias("suffixes")).where("n > 1").select("prefix", "suffixes"))
    many, suffixes = shared.agg(F.count("*"), F.coalesce(F.sum("suffixes"), F.lit(0))).first()
    hot = bitmap(shared.where(F.col("suffixes") > hot_suffixes), "prefix", LOG2_HOT_BITS)
    rounds = max(1, -(-many // (1 << (log2_bits - 3))))
    groups = max(GROUPS, -(-suffixes // (group_suffixes * rounds)))
    out = None
    for turn in range(rounds):
        mine = shared if rounds == 1 else shared.where(F.expr(f"cast(conv(hex(prefix), 16, 10) as decimal(20)) % {rounds} = {turn}"))
        deal = dealt_suffixes(bitmap(mine, "prefix", log2_bits), hot, rounds, turn, window, prefix, groups, CHUNK)
        found = texts.select("digest", "text").mapInArrow(deal, _DEALT_DDL).groupBy("part").applyInArrow(_group_repeats(window), _RUNS_DDL)
        out = found if out is None else out.unionByName(found)
    return out


def text_digest(text: str | Column = "text") -> Column:
    """128 bits that stand for a text; rows with equal texts share all results."""
    return F.unhex(F.md5(text))


_KEPT = ("n_words", "n_removed", "kept_sha256", "kept")


def _cut(window: int, spans: bool):
    def cut(batches):
        for batch in slices(batches):
            out = [[], [], [], []]
            runs = batch.column(2).to_pylist() if spans else [None] * batch.num_rows
            for text, mine in zip(batch.column(1).to_pylist(), runs):
                words = text.encode().split() if text else []
                n = len(words)
                if mine:
                    edges = np.zeros(n + 1, np.int64)
                    for r in mine:
                        edges[r["start"]] += 1
                        edges[min(n, r["stop"] - 1 + window)] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                kept = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", *_KEPT])

    return cut


def _with_bitmap(bits: np.ndarray, want: bool):
    """Rows (doc_id, text, digest, place) whose place is, or is not, in a bitmap."""
    def keep(batches):
        for batch in slices(batches):
            mine = np.flatnonzero(in_bitmap(bits, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)) == want)
            if len(mine):
                yield batch.take(pa.array(mine))

    return keep


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs' doc_id with the columns n_words, n_removed (long), kept_sha256 and kept (the kept words, joined by a space).

    Words are runs of other bytes than ASCII white space, unchanged. A word goes if a window of `window` words that covers it has the same words as a window that starts anywhere else.
    Null and empty texts have no words; texts shorter than a window keep all; repeated rows are copies, so they lose every window; rows with equal or null ids stay apart.
    Only doc_id and text are read, so other columns may have any name. An empty table gives no rows. Only texts that hold a repeat are shuffled whole, to meet their runs.
    """
    rows = docs.select("doc_id", "text", text_digest().alias("digest"), F.xxhash64(text_digest()).alias("place"))
    runs = spool(repeated_runs(rows.select("digest", "text"), window, prefix).groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("runs")))
    bits = bitmap(runs.select(F.xxhash64("digest").alias("place")), "place", LOG2_BITS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema, passed = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string", f"doc_id {kind}, text string, digest binary, place long"
    clean = rows.mapInArrow(_with_bitmap(bits, False), passed).select("doc_id", "text").mapInArrow(_cut(window, False), schema)
    rest = rows.mapInArrow(_with_bitmap(bits, True), passed).join(runs, "digest", "left").select("doc_id", "text", "runs").mapInArrow(_cut(window, True), schema)
    return clean.unionByName(rest)


def op8(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)
), x AS (
  SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id
), o AS (
  SELECT d.doc_id, len(w) AS n, w, coalesce(ps, []) AS ps FROM d LEFT JOIN x ON d.doc_id = x.doc_id
), y AS (
  SELECT doc_id, n, CASE WHEN len(ps) = 0 THEN w ELSE list_transform(list_filter(range(1, n + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS kept FROM o
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM y
"""
