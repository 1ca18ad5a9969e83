"""URL filters: rules by host and path, and where none fits, naive Bayes over segmented host and path words."""

from __future__ import annotations

import base64
import math
import re

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import LOWER_LETTERS, UPPER_LETTERS, WordHashes, bitmap, in_bitmap, spool, word_hashes

# The rules of the query (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

# Words that mark a host or path as unwanted wherever they stand as a word; urls with one are the bad rows that naive Bayes learns from.
UNWANTED = "ads adserver adware backlinks casino casinos cialis clickbait doorway hookup jackpot keygen malware payday phish phishing porn porno scam scams spam viagra warez xxx".split()
# Words of one or two letters; other runs as short are no words.
SHORT = frozenset("a i am an as at be by do go he if in is it me my no of on or so to up us we".split())

LOG2_BITS = 26
LONGEST = 24
LEAST_HOSTS = 3
SEED_WEIGHT = 5
GENERAL_WEIGHT = 1_000_000


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no `://`."""
    url = F.col(url) if isinstance(url, str) else url
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER_LETTERS, LOWER_LETTERS), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, or nulls; the rules are a short list given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def general_words(ranks: str) -> dict[str, float]:
    """Shares of words in general language, from a public vocabulary in which frequent words come first: the k-th of its whole words (those that follow a space) weighs 1 / (k + 2). Unwanted words that it lacks come last, so they count as its rarest."""
    with open(ranks, "rb") as lines:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    words = dict.fromkeys(w for _, t in tokens if t.startswith(b" ") and (w := t[1:].decode(errors="replace").lower()).isalpha() and (len(w) > 2 or w in SHORT) and len(w) <= LONGEST) | dict.fromkeys(UNWANTED)
    weights = {w: 1 / (k + 2) for k, w in enumerate(words)}
    total = sum(weights.values())
    return {w: x / total for w, x in weights.items()}


class Segmenter:
    """Unigram Viterbi: splits a name into the most probable words. Runs of more than LONGEST letters are never one word."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        """counts of words; total is that of all words, where counts has only some."""
        self.total = total or sum(counts.values()) or 1.0
        self.log = {w: math.log(c / self.total) for w, c in counts.items() if w}
        self.known: dict[str, tuple[str, ...]] = {}

    def cost(self, word: str) -> float:
        got = self.log.get(word)
        return got if got is not None else math.log(10 / self.total) - 2.3026 * len(word)

    def split(self, name: str) -> tuple[str, ...]:
        if name in self.known:
            return self.known[name]
        score, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                s = score[start] + self.cost(name[start:end])
                if s > score[end]:
                    score[end], back[end] = s, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        got = tuple(reversed(out))
        if len(self.known) < 100_000:
            self.known[name] = got
        return got


def pieces(host: str, path: str) -> tuple[list[str], list[str]]:
    """Letter runs of a host (without its last two labels' suffix) and of a path."""
    labels = host.split(":")[0].split(".")
    return re.findall(r"[^\W\d_]+", " ".join(labels[:-1])), re.findall(r"[^\W\d_]+", path.lower())


def unigrams(urls: DataFrame, ranks: str | None = None) -> DataFrame:
    """(w, count) of words: in how many hosts each stands alone, as a part of the host or of a path, and a general model of at least as much weight.

    A run of letters that few hosts have may be words run together, and must not count as a word. No word counts for its meaning.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1)
    alone = urls.select("host", F.explode(F.concat(runs(F.regexp_replace("host", r"\.[^.]*$", "")), runs(F.lower("path")))).alias("w")).distinct()
    words = spool(alone.where(F.length("w").between(3, LONGEST) | F.col("w").isin(*SHORT)).groupBy("w").agg(F.count("*").cast("double").alias("count")).where(F.col("count") >= LEAST_HOSTS))
    weight = max(float(GENERAL_WEIGHT), words.agg(F.sum("count")).first()[0] or 0.0)
    general = general_words(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = words.sparkSession.createDataFrame([(w, weight * x) for w, x in general.items()], "w string, count double")
    return spool(words.unionByName(rows).groupBy("w").agg(F.sum("count").alias("count")))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names: each meets the counts of its parts by a join, so that no task holds the counts.

    Parts that are no word are mostly dropped before, by a bitmap of fixed size of the words' hashes; it lets more through when words are many, and never drops a word."""
    total = counts.agg(F.sum("count")).first()[0]

    def hashed(batches):
        cache = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"h": word_hashes([w.encode() for w in pdf["w"]], cache).view("int64")})

    bits = bitmap(counts.select("w").mapInPandas(hashed, "h long"), "h", LOG2_BITS)

    def parts(batches):
        cache, out = WordHashes(), ([], [])
        for pdf in batches:
            for name in pdf["name"]:
                found = sorted({name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + LONGEST) + 1)})
                known = in_bitmap(bits, word_hashes([w.encode() for w in found], cache))
                mine = [w for w, k in zip(found, known) if k] or [""]
                out[0].extend([name] * len(mine))
                out[1].extend(mine)
                if len(out[0]) >= 10_000:
                    yield pd.DataFrame({"name": out[0], "w": out[1]})
                    out = ([], [])
        yield pd.DataFrame({"name": out[0], "w": out[1]}, dtype=object)

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([list(Segmenter({x["w"]: x["count"] for x in f}, total).split(n)) for n, f in zip(name, found)])

    met = names.mapInPandas(parts, "name string, w string").join(counts, "w", "left").groupBy("name")
    known = met.agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("w", "count"))).alias("found"))
    return known.select("name", split("name", "found").alias("words"))


def model_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, n, words) of the distinct urls: how many rows each has, and its words (h: of the host, p: of the path) with how often they occur."""
    def cut(batches):
        for pdf in batches:
            rows = [(h, p, n, kind, x) for h, p, n in zip(pdf["host"], pdf["path"], pdf["n"]) for kind, names in zip(("h:", "p:"), pieces(h, p)) for x in names or ([""] if kind == "h:" else [])]
            yield pd.DataFrame(rows, columns=["host", "path", "n", "kind", "name"])

    cuts = spool(urls.groupBy("host", "path").agg(F.count("*").alias("n")).mapInPandas(cut, "host string, path string, n long, kind string, name string"))
    names = spool(segmented(cuts.where("name <> ''").select("name").distinct(), counts))
    met = cuts.join(names, "name", "left").select("host", "path", "n", F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat("kind", w)).alias("words"))
    return spool(met.groupBy("host", "path", "n").agg(F.flatten(F.collect_list("words")).alias("words")))


def naive_bayes(known: DataFrame) -> tuple[DataFrame, float]:
    """((w, odds) of all words, the prior's odds): log odds, unwanted against clean, learned from all urls. Pages have no labels, so a url with an unwanted word is taken as bad and any other as clean.

    Each word counts once more than it occurs, shared out by the classes' sizes: a word that neither has says nothing, and a rare word of the larger class never speaks for the smaller."""
    bad = F.exists("words", lambda w: F.substring(w, 3, 1 << 30).isin(UNWANTED))
    rows = known.select("n", bad.cast("long").alias("bad"), "words")
    good = lambda n: [F.sum(F.col(n) * F.col("bad")).alias("bad"), F.sum(F.col(n) * (1 - F.col("bad"))).alias("good")]
    docs = rows.agg(*good("n")).first()
    seen = rows.select("n", "bad", F.explode("words").alias("w")).groupBy("w").agg(*good("n"))
    seeds = known.sparkSession.createDataFrame([(f"{kind}:{w}", SEED_WEIGHT, 0) for w in UNWANTED for kind in "hp"], "w string, bad long, good long")
    words = spool(seen.unionByName(seeds).groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    all_bad, all_good = words.agg(F.sum("bad"), F.sum("good")).first()
    one = 1.0 / (all_bad + all_good)
    odds = F.log(F.col("bad") / F.lit(float(all_bad)) + one) - F.log(F.col("good") / F.lit(float(all_good or 1)) + one)
    return words.select("w", odds.alias("odds")), math.log(((docs["bad"] or 0) + 1) / ((docs["good"] or 0) + 1))


def url_filter(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", ranks: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest fitting rule's verdict, else that of naive Bayes over segmented words.

    score is the probability that the url is unwanted (0.5 or more: block), whatever the rule says. A null url, or one without `://`,
    has empty host and path; without words the verdict is the prior's, which is allow unless most urls are unwanted.
    One row for each input row, null and repeated ids too, and repeated rows count as often as they stand there; urls of any length are read whole. Other columns of pages
    are not carried. An empty table gives no rows. Both models hold all words, as tables that names and urls meet by joins. Viterbi and the words' cut run row by row in Python, each distinct name once.
    """
    host, path = host_path(url)
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    known = model_words(urls, unigrams(urls, ranks))
    odds, prior = naive_bayes(known)
    sums = known.select("host", "path", F.explode("words").alias("w")).join(odds, "w").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    x = F.coalesce("odds", F.lit(0.0)) + F.lit(prior)

    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = urls.join(sums, ["host", "path"], "left").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x)))))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
