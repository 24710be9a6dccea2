"""Collocations: phrases of 2 to 4 words that come more often than their parts make likely.

Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line breaks, pieces into words.
Everything is counted per language (null: ``und``).

1. Words are counted by shard (``SHARD_BYTES`` of text that one task holds), then over all shards.
2. Each shard counts its windows of four words, fewer at the end of a piece, in a trie: its words
   numbered in their order, its distinct paths ascending, with counts.  Windows end before words
   below the least count, which no candidate holds; a bit filter of bounded size tells those, and
   what it lets pass is harmless.  The trie is cut by prefix range, each range written as one row
   of sorted runs with the words that it uses.
3. A range's runs from all shards are merged.  In the merged order the paths below a node are
   neighbours, so one walk gives every node's count, and with it the counts of its left parts, the
   nodes above it.  Nodes below the least count go.
4. The right part of a phrase without its first word is the node that its suffix link names: a join
   with phrases one word shorter, whose own links are followed already.

A range is a hash range of the first two words, of about ``RANGE_WINDOWS`` windows.  A pair of words
that has many windows itself is cut by its third word too, and so is a triple by its fourth; a sample of
windows (one of ``SAMPLE``) tells which, the same for all shards.  The counts of such a pair are then
summed over its ranges.  A shard sends a path once however often it comes, so a passage that a third of all
documents share is no hot key.  Rows between 2 and 3 are shards times ranges of a language at most.

Edge cases: null texts and texts without words have none; words may hold any character but space, tab
and those that cut, and are compared as bytes; repeated rows count each; an empty table gives no
phrase; further columns play no part.  All counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, release, smallest, unpack
from .decontaminate import Filter, make_filter
from .store import materialize
from .words import Chunk, Spans, chunks, mix64

SHARD_BYTES = 8 << 20
RANGE_WINDOWS = 1 << 21
SAMPLE = 1 << 10
DEPTH = 4
#: a pair or triple of more windows than this, or than this share of all, has ranges of its own
HOT_WINDOWS, HOT_SHARE = 1 << 22, 1 << 18
_CUTS = np.zeros(256, dtype=bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_CUTS
_IN_WORD[[0x20, 0x09]] = False
U64 = np.uint64


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of about ``size`` bytes of rows (lang, text), or of one longer text."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def taken() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        for lang in pc.unique(table["lang"]).to_pylist():
            yield lang, table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks()

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + size - held_bytes)) + 1)
            held.append(batch.slice(first, stop - first))
            held_bytes += int(ends[stop - 1]) - before
            first = stop
            if held_bytes >= size:
                yield from taken()
                held, held_bytes = [], 0
                release()
    if held:
        yield from taken()


@dataclass
class Shard:
    """Distinct words of some texts (binary) with their hashes, the word of each token, and whether the next token stands in the same piece."""

    words: pa.Array
    hashes: np.ndarray
    token: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, lang: str, texts: pa.Array) -> Shard:
        (c,) = [*chunks(texts, _IN_WORD, lower=True, size=1 << 62)] or [Chunk(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64), _IN_WORD)]
        size = c.end - c.start
        at = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=at[1:])
        laid = c.data[_IN_WORD[c.data]]
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(laid)]).dictionary_encode()
        cuts = np.searchsorted(np.flatnonzero(_CUTS[c.data]), c.start)
        joined = np.zeros(len(size), dtype=bool)
        joined[:-1] = cuts[1:] == cuts[:-1]
        ends = c.word_at[1:]
        joined[ends[ends > 0] - 1] = False
        return cls(words.dictionary, word_hashes(lang, words.dictionary), words.indices.to_numpy(), joined)


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in a language; equal ones of different words cost work only."""
    salt = U64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))
    words = words.cast(pa.large_binary())
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(at[0])
    return mix64(Spans(data[base : int(at[-1])])(at[:-1] - base, at[1:] - base) ^ salt)


def then(prefix: np.ndarray, word: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a path and one more word."""
    return mix64(prefix * U64(0x9E3779B97F4A7C15) + word)


def _word_counts(size: int):
    """(lang, path, n, h) of rows (lang, text): words; an empty path with all words; sampled pairs and triples, after a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches, size):
            s = Shard.of(lang, texts)
            if not len(s.token):
                continue
            counts = np.bincount(s.token, minlength=len(s.words))
            at = np.flatnonzero(s.joined)
            at = at[mix64(s.hashes[s.token[at]] ^ mix64(at.astype(np.uint64))) % U64(SAMPLE) == 0]
            pair = then(s.hashes[s.token[at]], s.hashes[s.token[at + 1]])
            more = s.joined[at + 1]
            triple = then(pair[more], s.hashes[s.token[at[more] + 2]])
            hashes, n = np.unique(np.concatenate((pair, triple)), return_counts=True)
            paths = pa.concat_arrays([s.words.cast(pa.large_string()), pa.array([""], pa.large_string()), pa.array([f" {h}" for h in hashes.tolist()], pa.large_string())])
            columns = [pa.array([lang] * len(paths)), paths.cast(pa.string()), pa.array(np.concatenate((counts, [len(s.token)], n))), pa.array(np.concatenate((s.hashes, [U64(0)], hashes)).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "path", "n", "h"])

    return run


@dataclass
class Plan:
    """What all shards must know: frequent words (perhaps more), ranges by language (1 if not given), and pairs and triples cut further."""

    known: Filter
    ranges: dict[str, int]
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # ascending

    def is_hot(self, paths: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(paths), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, paths), len(self.hot) - 1)] == paths

    def range_of(self, lang: str, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The range of each path of word hashes; 0 stands for no word."""
        path = then(a, b)
        hot = np.flatnonzero(self.is_hot(path))
        path[hot] = then(path[hot], c[hot])
        hot = hot[self.is_hot(path[hot])]
        path[hot] = then(path[hot], d[hot])
        return ((path >> U64(32)) * U64(self.ranges.get(lang, 1)) >> U64(32)).astype(np.int64)


def one_key(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Numbers below ``sizes`` as one number each, in the order of their columns."""
    key, room = columns[0].astype(np.int64), max(1, sizes[0])
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if room * size >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            room = len(found)
        key, room = key * size + column, room * size
    return key


def trie(s: Shard, known: Filter) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Paths of a shard, ascending: the words in their order (places in s.words), four columns (0: no word, else the word's number + 1), counts."""
    some = known.maybe(s.hashes)
    some = some[pc.sort_indices(s.words.take(pa.array(some))).to_numpy()] if len(some) else some
    number = np.zeros(len(s.words), dtype=np.int64)
    number[some] = np.arange(1, len(some) + 1)
    token = number[s.token] if len(s.token) else np.zeros(0, np.int64)
    at = np.flatnonzero(s.joined & (token > 0))
    at = at[token[at + 1] > 0]
    columns, last = [token[at], token[at + 1]], at + 1
    whole = np.ones(len(at), dtype=bool)
    for _ in range(DEPTH - 2):
        whole &= s.joined[last]
        last = np.minimum(last + 1, max(0, len(token) - 1))
        whole &= token[last] > 0
        columns.append(np.where(whole, token[last], 0))
    _, first, counts = np.unique(one_key(columns, [len(some) + 1] * DEPTH), return_index=True, return_counts=True)
    return some, [c[first] for c in columns], counts


def _runs(plan, size: int):
    """(lang, range, payload) of rows (lang, text): the sorted paths of a shard in a range, and the words that they use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches, size):
            s = Shard.of(lang, texts)
            words, columns, counts = trie(s, plan.value.known)
            hashes = np.concatenate((np.zeros(1, U64), s.hashes[words]))
            of = plan.value.range_of(lang, *(hashes[c] for c in columns))
            order = np.argsort(of, kind="stable")
            ranges, first = np.unique(of[order], return_index=True)
            rows = []
            for r, part in zip(ranges.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
                stacked = np.stack([c[part] for c in columns])
                used = np.unique(stacked)
                used = used[used > 0]
                stacked = np.where(stacked > 0, np.searchsorted(used, stacked) + 1, 0)
                own = s.words.take(pa.array(words[used - 1]))
                laid = np.frombuffer(b"".join(own.to_pylist()), np.uint8)
                arrays = {"words": laid, "sizes": smallest(pc.binary_length(own).to_numpy()), "counts": smallest(counts[part])}
                arrays |= {f"w{i}": smallest(x) for i, x in enumerate(stacked)}
                rows.append((lang, r, pack(arrays)))
            for lo in range(0, len(rows), 64):
                langs, numbers, payloads = zip(*rows[lo : lo + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(numbers, pa.int64()), pa.array(payloads, pa.binary())], names=["lang", "range", "payload"])

    return run


def _merged(plan, least: int):
    """(lang, phrase, size, f, l2, l3, part) of a range's runs: phrases of 2 to 4 words with the counts of their left parts of 2 and 3 words.

    part: the phrase has more ranges, and this is the count in one of them; left parts of that kind are null.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64()), ("l2", pa.int64()), ("l3", pa.int64()), ("part", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        runs = [unpack(x.as_py()) for x in table["payload"]]
        sizes = np.concatenate([r["sizes"].astype(np.int64) for r in runs])
        laid = np.concatenate([r["words"] for r in runs])
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(laid))]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(1, len(order) + 1)
        number = number[words.indices.to_numpy()]  # of each run's words, one after another
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(r["sizes"]) for r in runs])))
        columns = []
        for i in range(DEPTH):
            parts = [r[f"w{i}"].astype(np.int64) for r in runs]
            columns.append(np.concatenate([np.where(p > 0, number[np.maximum(p - 1 + lo, 0)], 0) for p, lo in zip(parts, first, strict=False)]))
        counts = np.concatenate([r["counts"].astype(np.int64) for r in runs])
        # the runs are ascending, so a stable sort merges them
        sort = np.argsort(one_key(columns, [len(order) + 1] * DEPTH), kind="stable")
        columns, counts = [c[sort] for c in columns], counts[sort]
        vocabulary = words.dictionary.take(pa.array(order)).cast(pa.large_string())
        hashes = np.concatenate((np.zeros(1, U64), word_hashes(lang, vocabulary)))

        new = np.zeros(len(counts), dtype=bool)
        new[0] = True
        new[1:] = columns[0][1:] != columns[0][:-1]
        path, above, out = hashes[columns[0]], [], []
        for depth in range(2, DEPTH + 1):
            new[1:] |= columns[depth - 1][1:] != columns[depth - 1][:-1]
            node = np.flatnonzero(new)
            f = np.add.reduceat(counts, node)
            path = then(path, hashes[columns[depth - 1]])
            is_part = plan.value.is_hot(path[node]) if depth < DEPTH else np.zeros(len(node), bool)
            real = (columns[depth - 1][node] > 0) & ((f >= least) | is_part)
            node_at = np.flatnonzero(real)
            texts = [vocabulary.take(pa.array(columns[i][node[node_at]] - 1)) for i in range(depth)]
            lefts = [pa.array(of[node[node_at]], mask=part[node[node_at]]) for of, part in above]
            nulls = pa.nulls(len(node_at), pa.int64())
            phrase = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())).cast(pa.string())
            lefts = [*lefts, nulls, nulls][:2]
            out.append(pa.table([pa.array([lang] * len(node_at)), phrase, pa.array(np.full(len(node_at), depth, np.int32)), pa.array(f[node_at]), *lefts, pa.array(is_part[node_at])], schema=schema))
            walk = np.cumsum(new) - 1  # the node above each path
            above.append((f[walk], is_part[walk]))
        return pa.concat_tables(out)

    return run


@dataclass
class Counts:
    """words: (lang, word, n) of frequent words; totals: (lang, n) of all; phrases: (lang, phrase, size, f, l2, l3)."""

    words: DataFrame
    totals: DataFrame
    phrases: DataFrame


def count(docs: DataFrame, least: int = 30, shard_bytes: int = SHARD_BYTES, range_windows: int = RANGE_WINDOWS, hot_windows: int = HOT_WINDOWS) -> Counts:
    """Counts of words and phrases of 2 to 4 words that come ``least`` times or more in a language, and of the phrases' left parts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = rows.mapInArrow(_word_counts(shard_bytes), "lang string, path string, n long, h long")
    counted = counted.groupBy("lang", "path").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
    sampled = F.startswith("path", F.lit(" "))
    counted = materialize(counted.where((F.col("n") >= F.when(sampled, max(1, hot_windows // SAMPLE)).otherwise(least)) | (F.col("path") == "")), "words")
    totals = counted.where("path = ''").select("lang", "n")
    words = counted.where((F.col("path") != "") & ~sampled).select("lang", F.col("path").alias("word"), "n", "h")
    # as many as there are ranges at most
    ranges = {r["lang"]: -(-r["n"] // range_windows) for r in totals.where(F.col("n") > range_windows).collect()}
    everything = totals.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(sampled & (F.col("n") >= max(hot_windows, everything // HOT_SHARE) // SAMPLE)).select("h").collect()
    plan = spark.sparkContext.broadcast(Plan(make_filter(words.select("h")), ranges, np.sort(np.array([r["h"] for r in hot], dtype=np.int64).view(U64))))
    runs = rows.mapInArrow(_runs(plan, shard_bytes), "lang string, range long, payload binary")
    nodes = runs.groupBy("lang", "range").applyInArrow(_merged(plan, least), "lang string, phrase string, size int, f long, l2 long, l3 long, part boolean")
    nodes = materialize(nodes, "phrases")
    whole = nodes.where("not part").drop("part")
    # pairs and triples that have more than one range, and what stands below them
    parts = nodes.where("part").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"), F.max("l2").alias("l2"), F.max("l3").alias("l3")).where(F.col("f") >= least)
    summed = materialize(parts, "hot-phrases")
    for n in (2, 3):
        left = summed.where(F.col("size") == n).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_left"), F.col("f").alias("_f"))
        whole, summed = (
            t.join(left, (F.col("size") > n) & F.col(f"l{n}").isNull() & (F.col("lang") == F.col("_lang")) & (F.substring_index("phrase", " ", n) == F.col("_left")), "left").withColumn(f"l{n}", F.coalesce(f"l{n}", "_f")).drop("_lang", "_left", "_f")
            for t in (whole, summed)
        )
    return Counts(words.drop("h"), totals, whole.union(summed))


def with_right_parts(counts: Counts) -> DataFrame:
    """Phrases (lang, phrase, size, f) with lefts and rights: the counts of both parts by the words of the left one."""
    link = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    first = counts.words.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), F.col("n").alias("l1"))
    phrases = counts.phrases.join(first, (F.col("lang") == F.col("_lang")) & (F.substring_index("phrase", " ", 1) == F.col("_word"))).drop("_lang", "_word")
    phrases = materialize(phrases.withColumn("link", link), "left-parts")
    # a word has no right part; a phrase's are its link's count and the link's own
    below, found = counts.words.select(F.col("lang").alias("_lang"), F.col("word").alias("_phrase"), F.array("n").alias("_rights")), None
    for size in range(2, DEPTH + 1):
        here = phrases.where(F.col("size") == size).join(below, (F.col("lang") == F.col("_lang")) & (F.col("link") == F.col("_phrase")))
        here = materialize(here.withColumnRenamed("_rights", "rights").drop("_lang", "_phrase", "link"), f"phrases-{size}")
        below = here.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.concat(F.array("f"), "rights").alias("_rights"))
        found = here if found is None else found.union(here)
    return found.withColumn("lefts", F.slice(F.array("l1", "l2", "l3"), F.lit(1), F.col("size") - 1)).drop("l1", "l2", "l3")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, scale: int = 2_000_000, **sizes: int) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    score: floor(scale * a / (l + r)) of the cut where that is least.  A phrase goes if a longer
    one that holds it comes ``percent`` % as often, or more often.
    """
    counts = count(docs, least, **sizes)
    phrases = materialize(with_right_parts(counts), "all-phrases")
    longer = phrases.where("size > 2").select("lang", "f", F.split("phrase", " ").alias("w"), "size")
    inner = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inner = longer.select(F.col("lang").alias("_lang"), "f", F.explode(inner).alias("_phrase")).groupBy("_lang", "_phrase").agg(F.max("f").alias("_longer"))
    told = phrases.join(inner, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = told.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("f")))
    cut = f"transform(lefts, (l, i) -> struct(cast(cast({scale} as decimal(9,0)) * cast(f as decimal(19,0)) div cast(l + rights[i] as decimal(19,0)) as long) as score, i as k, l as l, rights[i] as r))"
    scored = kept.withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.totals.select(F.col("lang").alias("_lang"), "n")
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
