"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, exact intersection of sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import LOWER, WordHashes, bitmap, chosen, components, id_hash, in_bitmap, mixed, over_rounds, run_hashes, slices, small_batches, spool, word_hashes

WORDS = 5
PERCENT = 80
STARS = 4
HEAVY = 64
LOG2_BITS = 24
TILE_ROWS = 2048
GROUP_ROWS = 10_000
TILE_SHINGLES = 1_000_000
PAIRS_A_ROW = 16
KEY_ROUNDS = 4
LEAST_BITS, MOST_BITS = 256, 65_536
CHUNK = 2_000_000
CLOSE = 4


def shingles(text: str | None, cache: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct runs of words (A-Z lower-cased); of the whole sequence where there are fewer words."""
    parts = text.encode().translate(LOWER).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = word_hashes(parts, cache)
    if len(parts) < words:
        return run_hashes(h + np.uint64(len(parts)), len(parts))
    return np.unique(run_hashes(h, words))


def signature(s: np.ndarray, times: int = 2) -> bytes:
    """A bitmap of at least so many times (a power of two) as many bits as there are shingles (a power of two, at most MOST_BITS)."""
    width = min(MOST_BITS, max(LEAST_BITS, times << (len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """A signature (uint64 words) in fewer bits."""
    while len(sig) > words:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def most_common(n: int, own: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of one set (size n) with others: each bit that one has and the other lacks is a shingle not shared."""
    return np.minimum(n - np.bitwise_count(own & ~others).sum(-1, dtype=np.int64), sizes - np.bitwise_count(others & ~own).sum(-1, dtype=np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """So many shingles, first in any order common to all, that two sets of the wanted similarity share one of them."""
    return n - -(-n * percent // 100) + 1


def local_repeats(docs: DataFrame, words: int) -> DataFrame:
    """(shingle, n) for shingles that a stretch of input holds at least 3 times: what is common everywhere, without a shuffle of all shingles."""
    def run(batches):
        cache, held, size = WordHashes(), [], 0

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["shingle", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                parts = text.encode().translate(LOWER).split() if text else []
                held.append(run_hashes(word_hashes(parts, cache), words))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "shingle long, n long")


def packed(s: np.ndarray, whole: bool = False) -> bytes:
    """A set for the shuffle: the leading 48 bits of each sorted hash, 16 of them and then 32; or whole hashes."""
    if whole:
        return s.tobytes()
    return (s >> np.uint64(48)).astype("<u2").tobytes() + ((s >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def unpacked(blob: bytes, whole: bool = False) -> np.ndarray:
    if whole:
        return np.frombuffer(blob, np.uint64)
    n = len(blob) // 6
    return np.frombuffer(blob, "<u2", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(blob, "<u4", n, 2 * n).astype(np.uint64)


def sets_of(docs: DataFrame, ids: DataFrame, words: int, whole: bool, log2_bits: int) -> DataFrame:
    """(doc_id, shingles) of the documents with one of the ids (id), and of a few besides that their bitmaps let through."""
    def run(mine):
        def of(batches):
            cache = WordHashes()
            for batch in slices(batches):
                wanted = np.flatnonzero(mine.holds(batch.column(1).to_numpy().view(np.uint64)))
                if len(wanted):
                    part = batch.take(pa.array(wanted))
                    sets = [packed(shingles(t, cache, words), whole) for t in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

        return of

    rows = docs.where("doc_id is not null").select("doc_id", id_hash("doc_id").alias("place"), "text")
    return over_rounds([rows.mapInArrow(run(mine), "doc_id long, shingles binary") for mine in chosen(ids.select(id_hash("id").alias("place")), "place", log2_bits)])


def compared(pairs: DataFrame, docs: DataFrame, percent: int, words: int, whole: bool, log2_bits: int) -> DataFrame:
    """(a, b, spare) for the pairs (a, b) whose similarity reaches percent: bitmap bound first, then intersection of the sorted sets. spare: how many common shingles more than needed."""
    both = pairs
    for k in ("b", "a"):
        sets = sets_of(docs, pairs.select(F.col(k).alias("id")).distinct(), words, whole, log2_bits).withColumnsRenamed({"doc_id": f"doc_id_{k}", "shingles": f"shingles_{k}"})
        # The last join shuffles small sides too: by broadcast, sets would be made and checked in one task, with two Python workers where there is memory for one.
        both = both.join(sets.hint("merge") if k == "a" else sets, F.col(k) == F.col(f"doc_id_{k}"))

    def check(batches):
        for batch in slices(batches):
            keep, spare = [], []
            a, b, xa, xb = (batch.column(i) for i in range(4))
            for i in range(len(batch)):
                p, q = unpacked(xa[i].as_py(), whole), unpacked(xb[i].as_py(), whole)
                least = (len(p) + len(q)) * percent
                if not len(p) or not len(q):
                    continue
                u, v = (np.frombuffer(signature(x), np.uint64) for x in (p, q))
                width = min(len(u), len(v))
                if int(most_common(len(p), folded(u, width), len(q), folded(v, width))) * (100 + percent) < least:
                    continue
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                if common * (100 + percent) >= least:
                    keep.append(i)
                    spare.append(common - -(-least // (100 + percent)))
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64())), pa.array(spare, pa.int64())], names=["a", "b", "spare"])

    return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(check, "a long, b long, spare long")


def possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose signatures (facts: doc_id, n, sig) bound the overlap high enough: a signature is a small part of its set, so only sets that may link are moved."""
    ids = spool(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    facts = facts.select("doc_id", "n", "sig").join(ids, "doc_id", "left_semi")
    side = lambda k: facts.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))

    def check(batches):
        for batch in slices(batches):
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(u), len(v))
                if int(most_common(n, folded(u, width), m, folded(v, width))) * (100 + percent) >= (n + m) * percent:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    return both.mapInArrow(check, "a long, b long")


def open_keys_of(entries: DataFrame, rounds: int = KEY_ROUNDS) -> DataFrame:
    """The shingles of entries (class, shingle) that different classes share. Each round takes its part of the shingles, so that only this part of the entries lies on disk as shuffle files at once."""
    def part(turn):
        mine = entries.where(F.pmod("shingle", F.lit(rounds)) == turn)
        return spool(mine.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("shingle"))

    return over_rounds([part(turn) for turn in range(rounds)])


def open_rows(full: DataFrame, open_keys: DataFrame, log2_bits: int) -> DataFrame:
    """(doc_id, shingle) of the prefixes for all open keys, and for a few shingles besides that their bitmaps let through.

    Shingles of prefixes are the least hashes of their sets, so their leading bits are much alike; bitmaps go by the trailing half instead."""
    def run(mine):
        def of(batches):
            for batch in batches:
                lists = batch.column(1)
                flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                row = np.repeat(np.arange(len(batch)), np.diff(offsets))
                h = flat.view(np.uint64)
                held = np.flatnonzero(mine.holds(h << np.uint64(32) | h >> np.uint64(32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[held])), pa.array(flat[held])], names=["doc_id", "shingle"])

        return of

    swapped = F.shiftleft("shingle", 32).bitwiseOR(F.shiftrightunsigned("shingle", 32))
    return over_rounds([full.select("doc_id", "prefix").mapInArrow(run(mine), "doc_id long, shingle long") for mine in chosen(open_keys.select(swapped.alias("place")), "place", log2_bits)])


def thinned(sig: pd.Series) -> pd.Series:
    """Signatures in half as many bits, which bound the overlap less closely."""
    return sig.map(lambda x: x if x is None else folded(np.frombuffer(x, np.uint64), max(LEAST_BITS // 64, len(x) // 16)).tobytes())


def linked(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, log2_bits: int = LOG2_BITS) -> DataFrame:
    """Those of the pairs (a, b) of ids whose similarity reaches percent.

    Only documents in a pair are read as sets; which they are goes to the tasks as bitmaps of fixed size, in rounds (what they let through besides, the join drops).
    Sets travel as 48-bit hashes, under which shingles can only look more alike. Pairs that reach percent by fewer than CLOSE common shingles are compared again on whole hashes.
    """
    found = spool(compared(spool(pairs.distinct()), docs, percent, words, False, log2_bits))
    close = found.where(F.col("spare") < CLOSE).select("a", "b").distinct()
    exact = compared(close, docs, percent, words, True, log2_bits)
    return found.where(F.col("spare") >= CLOSE).select("a", "b").unionByName(exact.select("a", "b")).distinct()


def _facts(heavy: np.ndarray, percent: int, words: int):
    """Per document: set size, digest of the set, keys for stars, prefix of the set (common shingles last), signature."""
    odd = mixed(np.arange(1, STARS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        cache = WordHashes()
        for batch in slices(batches):
            out = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                s = shingles(text, cache, words)
                if len(s):
                    rest = s[np.argsort(in_bitmap(heavy, s), kind="stable")][: prefix_size(len(s), percent)]
                    stars = [int(((s * o).min() ^ o).view(np.int64)) for o in odd]
                else:
                    rest, stars = s, []
                for column, value in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, stars, rest.view(np.int64), signature(s) if len(s) else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())], names=["doc_id", "n", "digest", "stars", "prefix", "sig"])

    return run


def _at_width(sigs: list[np.ndarray], width: int) -> np.ndarray:
    """The signatures in so many words; those that are shorter are left out (zeros)."""
    return np.stack([folded(s, width) if len(s) >= width else np.zeros(width, np.uint64) for s in sigs])


def _tile_hits(roots, sizes, own, side, diagonal, sigs, percent, most):
    """Which of a tile's rows may link with another, and the pairs (None if over most for each such row): of different parts, sizes near enough, bitmap bound high enough.
    At least one of a pair is of the tile's own band."""
    widths = np.array([len(s) for s in sigs])
    at_width: dict[int, np.ndarray] = {}
    hit, place, pairs, count = np.zeros(len(roots), bool), np.arange(len(roots)), [], 0
    for i in np.flatnonzero(own):
        near = (roots != roots[i]) & (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * percent)
        near &= (~own | (place > i)) if diagonal else (side != side[i])
        if count > most * len(roots):
            near &= ~(hit & hit[i])
        near = np.flatnonzero(near)
        if len(near):
            # Rows of like size have like widths: folded no further than that, a bitmap does not fill up.
            width = min(widths[i], widths[near].min())
            if width not in at_width:
                at_width[width] = _at_width(sigs, width)
            bound = most_common(int(sizes[i]), at_width[width][i], sizes[near], at_width[width][near])
            near = near[bound * (100 + percent) >= (sizes[i] + sizes[near]) * percent]
            hit[near] = True
            hit[i] |= len(near) > 0
            count += len(near)
            if count <= most * len(roots):
                pairs.append(np.column_stack([np.full(len(near), i), near]))
    return hit, (np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)) if count <= most * hit.sum() else None


def _tiles(percent: int, most: int = PAIRS_A_ROW):
    """Candidate pairs (doc_id, other) of a group of tiles, each pair once. Of a tile with over so many pairs for each document in one, these documents instead (other is doc_id),
    with the tile: so the rows made grow with those read. Of tiles with the same such documents one is enough."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shingle", "tile", "p", "q"], kind="stable", ignore_index=True)
        key = pdf[["shingle", "tile", "p", "q"]].to_numpy(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(pdf)) if len(pdf) else [0]
        columns = [pdf[c].to_numpy() for c in ("root", "n", "own", "side")]
        diagonal, sigs, ids = pdf["diagonal"].to_numpy(bool), [np.frombuffer(x, np.uint64) for x in pdf["sig"]], pdf["doc_id"].to_numpy()
        few, seen, rows = set(), set(), []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                hit, pairs = _tile_hits(*(c[a:b] for c in columns), diagonal[a], sigs[a:b], percent, most)
                if pairs is not None:
                    few.update(map(tuple, np.sort(ids[a + pairs], axis=1).tolist()))
                    continue
                hit = a + np.flatnonzero(hit)
                hit = hit[np.unique(ids[hit], return_index=True)[1]]
                if (same := ids[hit].tobytes()) not in seen:
                    seen.add(same)
                    rows.append(hit)
        many = pdf.loc[np.concatenate(rows) if rows else [], ["shingle", "tile", "p", "q", "doc_id", "root", "n"]].assign(other=lambda x: x["doc_id"])
        pairs = pd.DataFrame(sorted(few), columns=["doc_id", "other"], dtype=np.int64).assign(shingle=0, tile=0, p=0, q=0, root=0, n=0)
        return pd.concat([many, pairs[many.columns]], ignore_index=True)

    return run


def _tile_links(ids, roots, sides, diagonal, sets, percent):
    """Links between a tile's documents that join all parts which its links join: exact, and fewer than its rows. Pairs of one part, or of parts joined already, are not compared."""
    sizes, sigs = np.array([len(s) for s in sets]), [np.frombuffer(signature(s, 8), np.uint64) for s in sets]
    widths = np.array([len(s) for s in sigs])
    at_width: dict[int, np.ndarray] = {}
    part, place = np.unique(roots, return_inverse=True)[1], np.arange(len(roots))
    for i in place:
        near = (part != part[i]) & (place > i) & (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * percent)
        near = np.flatnonzero(near if diagonal else near & (sides != sides[i]))
        if not len(near):
            continue
        width = min(widths[i], widths[near].min())
        if width not in at_width:
            at_width[width] = _at_width(sigs, width)
        bound = most_common(int(sizes[i]), at_width[width][i], sizes[near], at_width[width][near])
        able = bound * (100 + percent) >= (sizes[i] + sizes[near]) * percent
        near, bound = near[able], bound[able]
        for j in near[np.argsort(-bound / (sizes[i] + sizes[near]), kind="stable")]:
            if part[j] == part[i]:
                continue
            p, q = sets[i], sets[j]
            common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
            if common * (100 + percent) >= (len(p) + len(q)) * percent:
                yield min(ids[i], ids[j]), max(ids[i], ids[j])
                part[part == part[j]] = part[i]


def _links(percent: int):
    """The links of a group of tiles."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for (_, p, q), rows in pdf.groupby(["key", "p", "q"]):
            sets = [unpacked(x, True) for x in rows["shingles"]]
            out.update(_tile_links(*(rows[c].to_numpy() for c in ("doc_id", "root", "side")), p == q, sets, percent))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype=np.int64)

    return run


def one_of_equal(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows, n) of the keys of rows (key, doc_id, n): of those with the same documents one, n the sum."""
    members = rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).alias("sum"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("xor"), F.sum("n").alias("n"))
    return members.groupBy("rows", "sum", "xor").agg(F.min(key).alias(key), F.max("n").alias("n")).select(key, "rows", "n")


def joining(hits: DataFrame, docs: DataFrame, percent: int, words: int, log2_bits: int, tile_shingles: int) -> DataFrame:
    """Links (a, b) that join what the documents with one key in hits (key, doc_id, root, n) link. A key's whole sets meet in one task, in blocks where they are large."""
    keep = spool(one_of_equal(hits, "key").select("key", "n", F.ceil(F.col("n") / tile_shingles).cast("int").alias("blocks")))
    rows = spool(hits.select("key", "doc_id", "root").join(keep.select("key", "blocks"), "key"))
    rows = rows.join(sets_of(docs, rows.select(F.col("doc_id").alias("id")).distinct(), words, True, log2_bits).where(F.length("shingles") > 0), "doc_id")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "doc_id", "root", "side", "shingles")
    copies = keep.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    groups = max(256, -(-(copies or 0) // tile_shingles))
    return dealt.groupBy(F.pmod(F.xxhash64("key", "p", "q"), F.lit(groups)).alias("group")).applyInPandas(_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, heavy: int = HEAVY, tile_rows: int = TILE_ROWS, log2_bits: int = LOG2_BITS, tile_shingles: int = TILE_SHINGLES, pairs_a_row: int = PAIRS_A_ROW) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): sets of word shingles, linked where 100 * overlap >= percent * union.

    component_id is the smallest doc_id reachable by links. Exact: no link between different sets is lost.
    1. Equal sets are one class, named by its smallest doc_id; the rest works on one document of each class.
    2. Each document is compared with the first of those that share one of a few least hashes (stars), which joins most near copies without comparing them with each other.
    3. Two sets that link share a shingle of their prefixes, in any common order; shingles that are common come last in it.
       Where all documents with a prefix shingle are in one component already there is nothing to do; the others meet in tiles by shingle and size band
       (split into blocks where there are many). Pairs that halved bitmaps allow are bounded by whole ones and compared exactly. A tile with many pairs for each of
       its documents does not list them: the whole sets of these documents meet once more, and of their exact links those that join parts are returned,
       so no step makes rows with the square of a group.
    Null and empty texts, and those of white space only, have an empty set, linked with nothing; repeated rows are each returned; rows that share a doc_id are one node with
    the links of each; a null doc_id is linked with nothing. Only doc_id and text are read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = local_repeats(docs, words).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy).select("shingle")
    facts = spool(docs.mapInArrow(_facts(bitmap(common, "shingle", LOG2_BITS), percent, words), "doc_id long, n long, digest binary, stars array<long>, prefix array<long>, sig binary"))
    full = facts.where("n > 0 and doc_id is not null")
    firsts = spool(full.groupBy("digest").agg(F.min("doc_id").alias("first")))
    reps = firsts.select(F.col("first").alias("doc_id")).distinct()

    keyed = full.select("doc_id", "n", F.explode("stars").alias("star")).join(reps, "doc_id", "left_semi")
    lead = keyed.groupBy("star").agg(F.min(F.struct("doc_id", "n")).alias("lead"))
    near = keyed.join(lead, "star").where("lead.doc_id < doc_id").where(F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent)
    # Of a document's leads the one that shares most stars is most like it; what this leaves apart the prefixes find.
    best = near.groupBy(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("stars")).groupBy("b").agg(F.max_by("a", F.struct("stars", -F.col("a"))).alias("a"))
    links = spool(linked(possible(spool(best.select("a", "b")), full, percent), docs, percent, words, log2_bits))
    known = components(links)

    nodes = reps.join(known, reps["doc_id"] == known["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
    # Which prefix shingles different sets share is told without moving a prefix: only their hashes and extremes of the sets' digests are summed.
    entries = full.select(F.xxhash64("digest").alias("class"), F.explode("prefix").alias("shingle"))
    open_keys = open_keys_of(entries)
    # What the bitmaps let through besides has one class, so one root, and is not apart below.
    shared = spool(open_rows(full, open_keys, log2_bits).join(nodes, "doc_id").select("doc_id", "shingle", "root"))
    apart = shared.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    met = spool(shared.join(apart, "shingle"))
    # Near copies share most of a prefix: of shingles that the same documents share one is enough.
    keep = one_of_equal(met.withColumn("n", F.lit(1)), "shingle").select("shingle", "rows", F.ceil(F.col("rows") / tile_rows).cast("int").alias("blocks"))
    rows = met.join(keep, "shingle").join(full.select("doc_id", "n", F.pandas_udf(thinned, "binary")("sig").alias("sig")), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A tile is the documents with one shingle; where they are many, those of one size band and the next smaller one, in blocks.
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    banded = F.array(F.struct(band.alias("tile"), F.lit(True).alias("own")), F.struct((band + 1).alias("tile"), F.lit(False).alias("own")))
    whole = F.array(F.struct(F.lit(-1).alias("tile"), F.lit(True).alias("own")))
    dealt = rows.withColumn("t", F.explode(F.when(F.col("blocks") > 1, banded).otherwise(whole))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shingle", "t.tile", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "doc_id", "root", "n", "sig", "t.own", F.col("block").alias("side"), (F.col("block") == F.col("other")).alias("diagonal"))
    copies = keep.agg(F.sum(F.col("rows") * F.when(F.col("blocks") > 1, 2 * F.col("blocks")).otherwise(1))).first()[0]
    groups = max(256, -(-(copies or 0) // GROUP_ROWS))
    met_in = dealt.groupBy(F.pmod(F.xxhash64("shingle", "tile", "p", "q"), F.lit(groups)).alias("group"))
    found = spool(met_in.applyInPandas(_tiles(percent, pairs_a_row), "shingle long, tile int, p int, q int, doc_id long, root long, n long, other long"))
    pairs = found.where("doc_id < other").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
    hits = found.where("doc_id = other").select(F.xxhash64("shingle", "tile", "p", "q").alias("key"), "doc_id", "root", "n")
    more = linked(possible(spool(pairs), full, percent), docs, percent, words, log2_bits).unionByName(joining(hits, docs, percent, words, log2_bits, tile_shingles))

    roots = components(links.unionByName(more))
    classes = firsts.join(roots, firsts["first"] == roots["node"], "left").select("digest", F.coalesce("root", "first").alias("component_id"))
    twins = facts.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return twins.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, md5(unnest(g)) AS h FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT p.y, r.root FROM r JOIN p ON r.doc_id = p.x
), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.root AS component_id FROM s JOIN m ON s.doc_id = m.doc_id
"""
