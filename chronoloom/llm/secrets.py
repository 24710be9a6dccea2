"""Secret scans with a trigram inverted index.

Each rule's regular expression gives a Boolean query of mandatory trigrams.  One scan of the
texts writes a row of the index for each document: a number, the trigrams it holds as bits,
and what rules without mandatory trigrams find, which scan every text in place.  The posting
lists of a block of consecutive documents come from these bits alone.  They are intersected
and united as the queries say, and only the resulting candidates are run through the regular
expression.  Blocks bound the length of any list, so a trigram that a third of all rows hold
is many lists.

So that candidates need no second scan, the first one sets aside the text of a document that
holds a pivot: of each query one mandatory trigram an alternative, the rarest by a guess that
needs no counts.  Documents are told apart by their number in the written index, not by a hash.

DataFrame functions only.  Java's expressions find leftmost non-overlapping matches; spans
are code points, end exclusive.

Edge cases: null and empty texts have no spans; repeated rows each get their spans; null
doc_ids are kept; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .trigrams import Query, pivots, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three base kinds, in this order.  A run of [0-9a-f]+ of 24 or more and a
# match of the counted form are the same thing, and so for access.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: further kinds of common credentials
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,}:[^\s/:@]{1,}@"),
)
SPAN = "array<struct<start:int,rule:int,end:int>>"
_BITS = 60


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """All spans of a rule, by the lengths of the pieces between and in its matches."""
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m))
    checked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m)) if rule.group else sizes
    zipped = F.arrays_zip(pieces.alias("gap"), sizes.alias("size"), checked.alias("checked"))
    empty = F.lit(None).cast(SPAN)
    found = F.aggregate(
        F.slice(zipped, 1, F.size(sizes)),
        F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast(SPAN)).alias("spans")),
        lambda state, m: F.struct(
            (state["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(
                m["checked"] >= rule.least,
                F.concat(state["spans"], F.array(F.struct((state["at"] + m["gap"]).alias("start"), F.lit(number).alias("rule"), (state["at"] + m["gap"] + m["size"]).alias("end")))),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), found["spans"]).otherwise(F.array().cast(SPAN))


def _evaluate(query: Query, lists: dict[str, Column]) -> Column:
    """Places in a block for which the query holds, from its posting lists."""
    if isinstance(query, str):
        return lists[query]
    parts = [_evaluate(q, lists) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def _bit(trigrams: list[str], trigram: str) -> tuple[str, int]:
    """Column and mask of a trigram's bit."""
    at = trigrams.index(trigram)
    return f"held{at // _BITS}", 1 << at % _BITS


def trigram_bits(text: Column, trigrams: list[str]) -> list[Column]:
    """Which trigrams a text holds, as columns held0, held1, ... of _BITS bits each."""
    lowered = F.lower(text)
    bits = [F.when(F.contains(lowered, F.lit(g)), F.lit(_bit(trigrams, g)[1]).cast("long")).otherwise(F.lit(0).cast("long")) for g in trigrams]
    parts = [bits[at : at + _BITS] for at in range(0, len(bits), _BITS)]
    return [reduce(lambda a, b: a.bitwiseOR(b), part).alias(f"held{i}") for i, part in enumerate(parts)]


def _holds_any(trigrams: list[str], some: set[str]) -> Column:
    masks: dict[str, int] = {}
    for g in some:
        column, mask = _bit(trigrams, g)
        masks[column] = masks.get(column, 0) | mask
    return reduce(lambda a, b: a | b, [F.col(c).bitwiseAND(F.lit(m).cast("long")) != 0 for c, m in masks.items()])


def postings(index: DataFrame, trigrams: list[str], block_bits: int) -> DataFrame:
    """Posting lists of each block: block, and for each trigram the places in the block that hold it (p0, p1, ...)."""
    place = F.col("row").bitwiseAND(F.lit((1 << block_bits) - 1)).cast("int")
    lists = [F.collect_list(F.when(_holds_any(trigrams, {g}), place)).alias(f"p{i}") for i, g in enumerate(trigrams)]
    return index.groupBy(F.shiftright("row", block_bits).alias("block")).agg(*lists)


def candidates(posted: DataFrame, trigrams: list[str], queries: dict[int, Query], block_bits: int) -> DataFrame:
    """(row, rules) of every row for which the query of a rule holds."""
    lists = {g: F.col(f"p{i}") for i, g in enumerate(trigrams)}
    each = F.array(*[F.struct(F.lit(n).alias("rule"), _evaluate(q, lists).alias("places")) for n, q in queries.items()])
    found = posted.select("block", F.explode(each).alias("r")).select("block", F.col("r.rule").alias("rule"), F.explode("r.places").alias("place"))
    row = F.shiftleft("block", block_bits).bitwiseOR(F.col("place").cast("long"))
    return found.select(row.alias("row"), "rule").groupBy("row").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_bits: int = 12) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, rule number, end) in that order.

    A block of the index is 2 ** block_bits documents.
    """
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q is not True}
    nothing = F.array().cast(SPAN)
    scanned = F.concat(nothing, *[rule_spans(F.col("text"), rules[n], n) for n, q in queries.items() if q is True])
    if not indexed:
        return docs.select("doc_id", F.array_sort(scanned).alias("spans"))

    trigrams = sorted(set().union(*[trigrams_of(q) for q in indexed.values()]))
    held = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), *trigram_bits(F.col("text"), trigrams))
    some = set().union(*[pivots(q) for q in indexed.values()])
    bits = [c for c in held.columns if c.startswith("held")]
    index = materialize(held.select("doc_id", "row", *bits, scanned.alias("scanned"), F.when(_holds_any(trigrams, some), F.col("text")).alias("text")), "secret-index")
    found = candidates(postings(index.select("row", *bits), trigrams, block_bits), trigrams, indexed, block_bits)
    verified = (
        index.select("row", "text")
        .where("text is not null")
        .join(found, "row")
        .select("row", F.concat(*[F.when(F.array_contains("rules", n), rule_spans(F.col("text"), rules[n], n)).otherwise(nothing) for n in indexed]).alias("verified"))
    )
    joined = index.select("row", "doc_id", "scanned").join(verified, "row", "left")
    return joined.select("doc_id", F.array_sort(F.concat("scanned", F.coalesce("verified", nothing))).alias("spans"))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Counts and digests of the first ``base`` rules and the text of all spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")

    def of(number: int) -> Column:
        return F.filter("spans", lambda s: s["rule"] == number)

    counts = [F.size(of(n)).cast("long").alias(f"n_{rules[n].kind}") for n in range(base)]
    of_base = F.filter("spans", lambda s: s["rule"] < base)
    return scanned.select("doc_id", *counts, F.sha2(written(of_base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
