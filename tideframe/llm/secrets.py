"""Secret scans: a trigram inverted index picks the rows that each rule must read; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import spool


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, and how many characters a group of the match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules of the contract.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
_MOST_ALTERNATIVES = 64
LOG2_BITS = 22
SALTS = 8


def trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def weakest(queries) -> list:
    """Alternatives without those that another one implies: what holds all trigrams of a set holds those of its subsets."""
    return [q for q in queries if not any(o < q for o in queries)]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean trigram query of a regex, as alternatives of trigrams that must all occur (in lower case); None if some match needs no trigram."""

    def cut(states):
        closed = weakest(list(dict.fromkeys(grams | trigrams(run) for grams, run in states)))
        return [(grams, "") for grams in closed]

    def walk(items, states):
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                states = [(grams, run + chr(arg).lower()) for grams, run in states]
            elif op == "SUBPATTERN":
                states = walk(arg[3], states)
            elif op == "BRANCH":
                states = [s for branch in arg[1] for s in walk(branch, states)]
            elif op == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
                states = [(grams, run + chr(c).lower()) for grams, run in states for _, c in arg]
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                if (low, high) == (0, 1):
                    states = states + walk(inner, states)
                elif low == 0:
                    states = cut(states)
                else:
                    for _ in range(min(low, 8)):
                        states = walk(inner, states)
                    if (low, high) != (low, low) or low > 8:
                        states = cut(states)
            elif op != "AT":
                states = cut(states)
            states = list(dict.fromkeys(states))
            if len(states) > _MOST_ALTERNATIVES:
                states = cut(states)
            if len(states) > _MOST_ALTERNATIVES:
                states = [(frozenset.intersection(*(grams for grams, _ in states)), "")]
        return states

    out = [grams for grams, _ in cut(walk(regex_parser.parse(pattern), [(frozenset(), "")]))]
    return out if all(out) else None


def text_key() -> Column:
    """128 bits that stand for a text; rows with equal texts have equal spans."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc) over whole texts (doc, text), with lists only for trigrams that a rule asks for; trigram is a place in grams."""
    low = docs.select("doc", F.lower("text").alias("low"))
    held = low.select("doc", F.array(*(F.contains("low", F.lit(t)) for t in grams)).alias("held"))
    # The outer form, as for the other Spark adds a filter on the list's size, which would make the list (and the lower case for each of its entries) once more.
    return held.select("doc", F.posexplode_outer("held").alias("trigram", "has")).where("has").select("trigram", "doc")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc, kinds): the rules with trigram queries whose lists all hold the document (doc, text). The rules' trigrams (as many as the rules have letters) are broadcast."""
    queries = [(r.kind, n, q) for r in rules for n, q in enumerate(trigram_query(r.pattern) or [])]
    spark = docs.sparkSession
    if not queries:
        return docs.where("false").select("doc", F.array().cast("array<string>").alias("kinds"))
    grams = sorted({t for _, _, q in queries for t in q})
    rows = [(grams.index(t), kind, n, 1 << place, (1 << len(q)) - 1) for kind, n, q in queries for place, t in enumerate(sorted(q))]
    asked = F.broadcast(spark.createDataFrame(rows, "trigram int, kind string, alternative int, bit long, need long"))
    met = postings(docs, grams).join(asked, "trigram").groupBy("doc", "kind", "alternative", "need").agg(F.bit_or("bit").alias("have")).where("have = need")
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, rank: int, asked: Column) -> Column:
    """Spans of a rule's matches, leftmost and non-overlapping, from the gaps that split() leaves between them; only matches whose group is long enough stay.

    Lengths are summed within blocks of about as many matches as there are blocks, and then over the blocks, since each step of a sum copies the list so far.
    """
    pattern = F.lit(rule.pattern)
    hits, gaps, groups = F.regexp_extract_all(text, pattern, 0), F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, rule.group)
    # Zipped, each of the three lists is made once for a text; the last gap has no match.
    parts = F.filter(F.arrays_zip(hits, gaps, groups), lambda x: x["0"].isNotNull())
    sizes = F.transform(parts, lambda x: F.struct(F.length(x["1"]).alias("gap"), F.length(x["0"]).alias("hit"), (F.length(x["2"]) >= rule.least).alias("fits")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["hit"]).alias("end"))
        return F.struct((begin + x["hit"]).alias("at"), F.when(x["fits"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).cast(_SPAN).alias("spans"))

    def blocks(all_sizes):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_sizes))).cast("int"))
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_sizes)), width)
        return F.transform(firsts, lambda i: F.aggregate(F.slice(all_sizes, i, width), start, step))

    def shifted(block, by):
        return F.transform(block["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    def joined(acc, block):
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["parts"], shifted(block, acc["at"])).cast(f"array<{_SPAN}>").alias("parts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("parts"))
    # A lambda's argument is worked out once, however often it is named.
    whole = F.element_at(F.transform(F.array(sizes), lambda all_sizes: F.aggregate(blocks(all_sizes), none, joined, lambda acc: F.flatten(acc["parts"]))), 1)
    return F.when(asked & text.rlike(rule.pattern), whole).otherwise(F.array().cast(_SPAN))


def _marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (with _secret_place) with `_secret_near`: whether the place is one of found's (place). A bitmap of fixed size, at most 2**LOG2_BITS / 64 rows, is broadcast; when candidates are many it lets others through."""
    place = lambda c: F.shiftrightunsigned(c, 64 - LOG2_BITS)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    bits = found.select(place("place").alias("p")).select(F.shiftright("p", 6).alias("_secret_word"), bit("p").alias("b")).groupBy("_secret_word").agg(F.bit_or("b").alias("_secret_bits"))
    at = docs.withColumn("_secret_p", place("_secret_place")).withColumn("_secret_at", F.shiftright("_secret_p", 6))
    both = at.join(F.broadcast(bits), F.col("_secret_at") == F.col("_secret_word"), "left")
    near = F.coalesce(F.col("_secret_bits").bitwiseAND(bit("_secret_p")) != 0, F.lit(False))
    return both.withColumn("_secret_near", near).drop("_secret_p", "_secret_at", "_secret_word", "_secret_bits")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with a column `secret_spans`: array of (start, rank, kind, end) by start, then by the rules' order; code points, end exclusive.

    A rule with a trigram query is run on the rows that the index gives; a rule without (a bare run of hexadecimal digits) on all rows, where they lie. Only candidates are
    shuffled, to meet their rules: a text that no rule's trigrams are in stays in its place, and copies of a candidate are dealt to several tasks. Whole texts
    are read; null texts count as empty and stay null; repeated rows, and rows with a null doc_id, are scanned as they are. Columns may have any names but those that
    begin with `_secret_`; one named secret_spans is replaced. An empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"]
    keyed = docs.select(*columns, text_key().alias("_secret_key"), F.xxhash64(text_key()).alias("_secret_place"))
    found = spool(candidates(keyed.select(F.col("_secret_key").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), rules))
    marked = _marked(keyed, found.select(F.xxhash64("doc").alias("place")))
    text = F.coalesce(F.col("text"), F.lit(""))
    full = [trigram_query(r.pattern) is None for r in rules]

    def spans(asked):
        parts = [spans_of(text, r, i, a) for i, (r, a) in enumerate(zip(rules, asked)) if a is not None]
        return F.sort_array(F.concat(*parts)) if parts else F.array().cast(_SPAN)

    far = marked.where("not _secret_near").select(*columns, spans([F.lit(True) if f else None for f in full]).alias("secret_spans"))
    salt = F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    kinds = found.select(F.col("doc").alias("_secret_doc"), F.col("kinds").alias("_secret_kinds"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_secret_slot"))
    near = marked.where("_secret_near").withColumn("_secret_salt", salt)
    near = near.join(kinds, (F.col("_secret_key") == F.col("_secret_doc")) & (F.col("_secret_salt") == F.col("_secret_slot")), "left")
    asked = [F.lit(True) if f else F.coalesce(F.array_contains("_secret_kinds", r.kind), F.lit(False)) for f, r in zip(full, rules)]
    return far.unionByName(near.select(*columns, spans(asked).alias("secret_spans")))


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)


def op7(spark, sf_dir: str) -> DataFrame:
    scanned = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(spans).alias("spans"))


def _oracle() -> str:
    """The same spans in SQL: gaps and matches of each pattern, added up."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, list_transform(list_filter(range(1, len(h) + 1), lambda i: length(g[i]) >= {r.least}), lambda i: {{
      'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'rank': {rank}, 'kind': '{r.kind}',
      'end': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT)}}) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS h, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d)""")
    name = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.start || ':' || x.\"end\"), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)}
), f AS (SELECT doc_id, list_sort(flatten(list(s))) AS s FROM a GROUP BY doc_id)
SELECT doc_id, CAST(len(list_filter(s, lambda x: x.kind = 'assign')) AS BIGINT) AS n_assign, CAST(len(list_filter(s, lambda x: x.kind = 'access')) AS BIGINT) AS n_access,
  CAST(len(list_filter(s, lambda x: x.kind = 'hex')) AS BIGINT) AS n_hex,
  sha256(coalesce({name.format("list_filter(s, lambda x: x.rank < 3)")}, '')) AS base_sha256, coalesce({name.format("s")}, '') AS spans
FROM f"""


ORACLE = _oracle()
