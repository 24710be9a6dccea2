"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A window is ``window`` consecutive words of a benchmark item (all words of a shorter item).  A
document contains a window only if it contains all its ``shingle``-word shingles, so the
rarest of them in the corpus - the necessary prefix at full containment - is joined with the
documents' shingles.  A joined shingle fixes where the window would start; positional and
length bounds drop starts outside the document, and the words themselves are compared.

Two passes over the texts, whatever the size of the benchmark: one counts the shingles that
the benchmark has too, which orders them by rarity; the other gives, for each occurrence of a
prefix, its position and the words around it, as many as a window can reach.  These few rows
meet the windows in a join by shingle.  No text is shuffled and nothing of the benchmark is
broadcast but a bit filter of its shingles, at most ``FILTER_BITS`` large, which lets
most shingles of a text go by unseen and decides nothing.

Edge cases: null texts have no words; items without words have no window; repeated items and
windows count once with all their item ids; a null item_id can't be named in a digest and is
left out of n_items, but its windows still mark words; empty tables give no hits; repeated
rows are judged each; input columns other than those named are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .words import ALNUM, Chunk, chunks, laid_words, window_hash

#: most bits of the filter (32 MB), and bits a shingle below that
FILTER_BITS, BITS_EACH = 1 << 28, 64
_PIECE = 1 << 12
CANDIDATES = "array<struct<h:bigint,at:bigint,left:int,context:string>>"


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, n, shingles) of every window; words joined by spaces, shingles the hashes by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), ALNUM, lower=True):
                h, room, counts = c.hashes(), c.room(), np.repeat(c.counts(), c.counts())
                start = np.flatnonzero((room >= window) | ((counts < window) & (room == counts)))
                n = np.minimum(window, room[start])
                size = np.minimum(shingle, n)
                raw, at = laid_words(c)
                words = [raw[a:b].decode() for a, b in zip(at[start].tolist(), (at[start + n] - 1).tolist(), strict=True)]
                per = n - size + 1
                first = np.repeat(start - (np.cumsum(per) - per), per) + np.arange(per.sum())
                hashes = window_hash(h, first, np.repeat(size, per)).view(np.int64)
                of = pa.array(np.searchsorted(c.word_at, start, side="right") - 1 + c.first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(words, pa.string()), pa.array(n), lists], names=["item_id", "words", "n", "shingles"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, words string, n long, shingles array<bigint>")


class Filter:
    """A bit filter of 64-bit hashes, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that may have been added."""
        one, two = self.places(hashes)
        found = np.flatnonzero(self.bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
        two = two[found]
        return found[(self.bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def make_filter(hashes: DataFrame) -> Filter:
    """The filter of a column h: each task sets bits of its own, their pieces are united, at most FILTER_BITS reach the driver."""
    size = _PIECE * 8
    wanted = min(FILTER_BITS, max(1, hashes.count()) * BITS_EACH)
    while size < wanted:
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(size // 8, np.uint8))
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        pieces = own.bits.reshape(-1, _PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["piece", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        total = np.zeros(_PIECE, np.uint8)
        for x in table["bits"].to_pylist():
            total |= np.frombuffer(x, np.uint8)
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([total.tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for row in hashes.select("h").mapInArrow(run, "piece long, bits binary").groupBy("piece").applyInArrow(unite, "piece long, bits binary").toLocalIterator():
        bits[row["piece"] * _PIECE : (row["piece"] + 1) * _PIECE] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits)


def _found(c: Chunk, known: Filter, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, hashes) of the shingles that may be known."""
    h, room = c.hashes(), c.room()
    for size in sizes:
        first = np.flatnonzero(room >= size)
        hashes = window_hash(h, first, size)
        some = known.maybe(hashes)
        yield size, first[some], hashes[some]


def _counter(known, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for c in chunks(batch.column(0), ALNUM, lower=True):
                found += [hashes for _, _, hashes in _found(c, known.value, sizes)]
            some, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _locator(known, sizes: list[int], window: int, shingle: int, text: str, names: list[str]):
    """Adds the number of words and, for each occurrence of a shingle that may be a prefix, its hash, position and surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, per_text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            hash_, at_, left_, context = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for c in chunks(batch.column(text), ALNUM, lower=True):
                counts.append(c.counts())
                found = [(np.full(len(p), size), p, x) for size, p, x in _found(c, known.value, sizes)]
                size, place, hashes = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.int64, np.int64, np.uint64), zip(*found, strict=True) if found else [()] * 3, strict=True))
                doc = np.searchsorted(c.word_at, place, side="right") - 1
                order = np.lexsort((size, place))
                size, place, hashes, doc = size[order], place[order], hashes[order], doc[order]
                # a window of less than ``shingle`` words is its own shingle; others reach so far to both sides
                whole = size < shingle
                low = np.where(whole, place, np.maximum(c.word_at[doc], place - (window - shingle)))
                high = np.where(whole, place + size, np.minimum(c.word_at[doc + 1], place + window))
                if len(place):
                    raw, laid = laid_words(c)
                    context += [raw[a:b].decode() for a, b in zip(laid[low].tolist(), (laid[high] - 1).tolist(), strict=True)]
                hash_.append(hashes)
                at_.append(place - c.word_at[doc])
                left_.append(place - low)
                per_text.append(np.bincount(doc, minlength=len(c)))
            offsets = pa.array(np.append(0, np.cumsum(np.concatenate(per_text))).astype(np.int32))
            parts = [pa.array(np.concatenate(hash_).view(np.int64)), pa.array(np.concatenate(at_)), pa.array(np.concatenate(left_).astype(np.int32)), pa.array(context, pa.string())]
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["h", "at", "left", "context"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts).astype(np.int64)), lists], names=names)

    return run


def locate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, shingle: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked, hits, items).

    marked: docs with the columns _row (a number of the row), _n_words and _candidates; hits: (row,
    start, n, words) of every occurrence of a window; items: (words, item_id).
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window, shingle), "benchmark-windows")
    items = windows.where("item_id is not null").select("words", "item_id").distinct()
    distinct = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    shingles = materialize(distinct.select("words", "n", F.size("shingles").alias("of"), F.posexplode("shingles").alias("offset", "h")), "benchmark-shingles")
    sizes = sorted(r[0] for r in shingles.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect())

    known = spark.sparkContext.broadcast(make_filter(shingles))
    counts = docs.select(text).mapInArrow(_counter(known, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("frequency"))
    # a window with a shingle that no document has can't occur
    ranked = shingles.join(counts, "h").groupBy("words", "n", "of").agg(F.count("*").alias("seen"), F.min(F.struct("frequency", "h", "offset")).alias("rarest")).where("seen = of")
    prefixes = materialize(ranked.select("rarest.h", "rarest.offset", "words", "n"), "benchmark-prefixes")
    known.unpersist()

    rare = spark.sparkContext.broadcast(make_filter(prefixes))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join([*(f"`{c}` {k}" for c, k in numbered.dtypes), "_n_words long", f"_candidates {CANDIDATES}"])
    names = [*numbered.columns, "_n_words", "_candidates"]
    marked = materialize(numbered.mapInArrow(_locator(rare, sizes, window, shingle, text, names), schema), "located")
    rare.unpersist()

    candidates = marked.where(F.size("_candidates") > 0).select(F.col("_row").alias("row"), F.explode("_candidates").alias("c")).select("row", "c.*")
    joined = candidates.join(prefixes, "h").where("left >= offset")
    occurring = F.array_join(F.slice(F.split("context", " "), (F.col("left") - F.col("offset") + 1).cast("int"), F.col("n").cast("int")), " ")
    hits = joined.where(occurring == F.col("words")).select("row", (F.col("at") - F.col("offset")).alias("start"), "n", "words")
    return marked, materialize(hits, "benchmark-hits"), items


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked, hits, items = locate(docs.select("doc_id", "text"), benchmark, **options)
    # each hit adds the words that no hit before it reaches
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    stop = F.col("start") + F.col("n")
    gained = hits.withColumn("gain", F.greatest(F.lit(0), stop - F.greatest("start", F.coalesce(before, "start"))))
    words = gained.groupBy("row").agg(F.sum("gain").alias("n_hit"))
    found = hits.select("row", "words").distinct().join(items, "words").select("row", "item_id").distinct()
    named = found.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    rows = marked.select(F.col("_row").alias("row"), "doc_id", F.col("_n_words").alias("n_words"))
    n_hit, n_items = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_items"))
    return (
        rows.join(words.join(named, "row", "left"), "row", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a hit word, with their columns.

    Only rows that hold a prefix meet the hits in a join; the others pass through.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of docs can clash
    marked, hits, _ = locate(named, benchmark, text=f"c{docs.columns.index('text')}", **options)
    some = marked.where(F.size("_candidates") > 0).join(hits.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti")
    kept = marked.where(F.size("_candidates") == 0).select(named.columns).union(some.select(named.columns))
    return kept.toDF(*docs.columns)
