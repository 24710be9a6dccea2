"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence is what lies between two of ``.!?`` or line breaks; its features are its words and the
first ``PREFIXES`` code points of them, lower-cased (A-Z), each once.  A sentence offends with the
probability ``sigmoid(bias + sum of its features' weights)``, and a document is toxic if at least
one of its sentences offends: ``1 - product(1 - p)`` (noisy-or).  Weights are fitted to the labels
of documents through that product, so which sentences offend is learned and not given;
:func:`offending` tells which they are.

Fitting reads at most ``sample_rows`` = 20,000 labelled rows (those of least hash) and of these as
many as have ``sample_bytes`` = 64 MB of text together; whole texts each.  From them the
``max_features`` = 4,096 features that tell toxic from other documents best are kept.  Scoring reads
all documents, whole.

Edge cases: null, empty and wordless texts have no sentence and score 0; documents without a
label are scored alike; repeated labels of a doc_id count as the least; a null doc_id is not
held out and has no label; without labels of both kinds every score is 0; an empty table gives
none; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import ALNUM, LEAD, Chunk, Spans, chunks, mix64

PREFIXES = (3, 4, 5, 6, 7)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[0x21, 0x2E, 0x3F, 0x0A, 0x0D]] = True
U64 = np.uint64


def word_features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """64-bit features of a chunk's words, and the word of each."""
    hashes = Spans(c.data)
    found, words = [mix64(hashes(c.start, c.end) + U64(1))], [np.arange(len(c.start))]
    leads = np.flatnonzero(LEAD[c.data])
    before = np.searchsorted(leads, c.start)
    size = np.searchsorted(leads, c.end) - before
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        found.append(mix64(hashes(c.start[longer], leads[before[longer] + n]) + U64(1 + n)))
        words.append(longer)
    return np.concatenate(found), np.concatenate(words)


def sentences(c: Chunk) -> np.ndarray:
    """The sentence of each word, numbered through the chunk from 0 without gaps."""
    if not len(c.start):
        return np.zeros(0, dtype=np.int64)
    stops = np.concatenate((np.zeros(1, np.int64), np.cumsum(_STOPS[c.data])))
    at, text = stops[c.start], c.doc_of_word()
    return np.concatenate((np.zeros(1, np.int64), np.cumsum((at[1:] != at[:-1]) | (text[1:] != text[:-1]))))


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def __post_init__(self):
        #: a bit for the leading 16 bits of each feature, to pass over most others
        self.some = np.zeros(1 << 16, dtype=bool)
        self.some[(self.features >> U64(48)).astype(np.int64)] = True

    def hits(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (sentence, feature number) that occur, each once, by sentence; and the sentences of the chunk's words."""
        sentence = sentences(c)
        h, word = word_features(c)
        maybe = np.flatnonzero(self.some[(h >> U64(48)).astype(np.int64)])
        h, word = h[maybe], word[maybe]
        place = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
        known = self.features[place] == h if len(self.features) else np.zeros(len(h), bool)
        pair = np.unique(sentence[word[known]] * max(1, len(self.features)) + place[known])
        return pair // max(1, len(self.features)), pair % max(1, len(self.features)), sentence

    def sentence_logits(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each sentence of a chunk, and the sentences of its words."""
        of, feature, sentence = self.hits(c)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        return self.bias + np.bincount(of, self.weights[feature], n), sentence

    def scores(self, column: pa.Array) -> np.ndarray:
        """Noisy-or of the sentences of each text."""
        out = [np.zeros(0)]
        for c in chunks(column, ALNUM, lower=True):
            logits, sentence = self.sentence_logits(c)
            first = np.searchsorted(sentence, np.arange(len(logits)))
            clean = np.zeros(len(c))
            np.add.at(clean, c.doc_of_word()[first], -np.logaddexp(0, logits))
            out.append(-np.expm1(clean))
        return np.concatenate(out)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic and other documents that have it) of rows (toxic, text), summed by batch."""
    for batch in batches:
        toxic, found, counts = batch.column(0).to_numpy(zero_copy_only=False) > 0, [], []
        for c in chunks(batch.column(1), ALNUM, lower=True):
            h, word = word_features(c)
            order = np.lexsort((h, text := c.doc_of_word()[word]))
            h, text = h[order], text[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            found.append(h[new])
            counts.append(toxic[c.first : c.stop][text[new]])
        if found:
            h, of = np.unique(np.concatenate(found), return_inverse=True)
            with_it = np.bincount(of, np.concatenate(counts), len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(with_it), pa.array(np.bincount(of, minlength=len(h)).astype(np.int64) - with_it)], names=["feature", "toxic", "other"])


def _bags(model: Model):
    """(toxic, bytes, sentences, features of sentences that have any: numbers, and the sentence of each) of rows (doc_id, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in chunks(batch.column(2), ALNUM, lower=True):
                of, feature, sentence = model.hits(c)
                ends = np.append(sentence, sentence[-1] + 1 if len(sentence) else 0)[c.word_at]
                cut = np.searchsorted(of, ends)
                rows += [(int(b - a), feature[lo:hi], of[lo:hi] - a) for a, b, lo, hi in zip(ends[:-1], ends[1:], cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2))],
                names=["doc_id", "toxic", "sentences", "feature", "sentence"],
            )

    return run


def _fitted(toxic: np.ndarray, sentences: np.ndarray, bag: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n: int, start: np.ndarray, decay: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest likelihood under a quadratic penalty, by gradient steps of adapted size.

    bag, sentence (through all bags) and feature: one entry per feature of a sentence; sentences without any count by number.
    """
    _, of = np.unique(sentence, return_inverse=True)
    m = int(of.max()) + 1 if len(of) else 0
    bag_of = np.zeros(m, dtype=np.int64)
    bag_of[of] = bag
    plain = sentences - np.bincount(bag_of, minlength=len(sentences))
    x = np.append(start, np.log(max(toxic.mean(), 1e-6)) - np.log(max(sentences.mean(), 1.0)) - 1)
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        logits = x[n] + np.bincount(of, x[feature], m)
        p, p0 = 1 / (1 + np.exp(-logits)), 1 / (1 + np.exp(-x[n]))
        clean = np.bincount(bag_of, np.logaddexp(0, logits), len(sentences)) + plain * np.logaddexp(0, x[n])
        # of the log likelihood by each logit: p * odds of the bag being clean, or -p
        pull = np.where(toxic, 1 / np.maximum(np.expm1(np.minimum(clean, 50)), 1e-9), -1.0)
        pull = np.clip(pull, -1.0, 20.0)
        by_sentence = pull[bag_of] * p
        slope = np.append(np.bincount(feature, by_sentence[of], n) - decay * x[:n], by_sentence.sum() + (pull * plain).sum() * p0) / len(sentences)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        x = x + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return x[:n], float(x[n])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    sample_bytes: int = 64 << 20,
    max_features: int = 4096,
    support: int = 3,
    decay: float = 0.1,
    rounds: int = 300,
    seed: int = 13,
) -> Model:
    """Fit on labelled rows that aren't held out.  support: toxic documents that a feature must have."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows).collect()
    if not taken:
        return Model()
    place = {r["doc_id"]: i for i, r in enumerate(taken)}
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in taken], "doc_id long, toxic int")
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    sampled = materialize(sampled, "labelled-texts")
    # doc_ids may repeat: all rows of one count as one place in the order of hashes
    sizes = sampled.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()
    room, chosen = sample_bytes, []
    for r in sorted(sizes, key=lambda r: place[r["doc_id"]]):
        room -= r["bytes"]
        if room < 0 and chosen:
            break
        chosen.append(r["doc_id"])
    if len(chosen) < len(sizes):
        sampled = sampled.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id").select("doc_id", "toxic", "text")
    n_toxic, n_rows = sampled.agg(F.sum("toxic"), F.count("*")).first()
    if not n_rows or not n_toxic or n_toxic == n_rows:
        return Model()

    counts = sampled.select("toxic", "text").mapInArrow(_document_features, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    n_other = n_rows - n_toxic
    share = (F.col("t") + F.col("o")) / F.lit(float(n_rows))
    part = lambda x, n: x * F.log((x + 0.5) / (share * n + 0.5))
    gain = part(F.col("t"), n_toxic) + part(F.col("o"), n_other)
    telling = counts.where((F.col("t") >= support) & (F.col("t") * n_other > F.col("o") * n_toxic)).withColumn("gain", gain)
    rows = telling.orderBy(F.desc("gain"), "feature").limit(max_features).select("feature", "t", "o").collect()
    if not rows:
        return Model()
    table = sorted((np.int64(r["feature"]).view(U64), r["t"], r["o"]) for r in rows)
    model = Model(np.array([t[0] for t in table], dtype=U64), np.zeros(len(table)), 0.0)

    bags = sampled.mapInArrow(_bags(model), "doc_id long, toxic int, sentences long, feature array<long>, sentence array<long>").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("sentences", "ascending")])
    toxic, n_sentences = bags["toxic"].to_numpy() > 0, bags["sentences"].to_numpy()
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (bags["feature"], bags["sentence"])]
    sizes_ = np.diff(lists[0].offsets.to_numpy())
    bag = np.repeat(np.arange(len(sizes_)), sizes_)
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n_sentences)[:-1]))
    feature, sentence = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy() + first[bag]
    model.weights, model.bias = _fitted(toxic, n_sentences, bag, sentence, feature, len(table), np.zeros(len(table)), decay, rounds)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (score of ``threshold`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores(batch.column(2)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Sentences that offend with probability ``least`` or more: doc_id, start and end (bytes of the UTF-8 text, first to last word), score, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in chunks(batch.column(1), ALNUM, lower=True):
                logits, sentence = shared.value.sentence_logits(c)
                p = 1 / (1 + np.exp(-logits))
                text = c.doc_of_word()
                for s in np.flatnonzero(p >= least):
                    lo, hi = np.searchsorted(sentence, [s, s + 1])
                    row, base = c.first + int(text[lo]), int(c.text_at[text[lo]])
                    a, b = int(c.start[lo]) - base, int(c.end[hi - 1]) - base
                    written = batch.column(1)[row].as_py().encode()[a:b].decode(errors="replace")
                    rows.append((batch.column(0)[row].as_py(), a, b, float(p[s]), written))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()], strict=True)], names=["doc_id", "start", "end", "score", "sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")
