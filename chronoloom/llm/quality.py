"""Quality rules: base rules, and an isolation forest on the rules' statistics.

Base rules reject texts of few words and texts that repeat themselves.  The forest judges
the rest by shares of symbols, repeated lines, repeated 5-word windows and words equal to
the one before, each over three times a rule's usual limit and cut at 1.  Trees are grown on good
labelled rows; split values are drawn over the range that all labelled rows span, so what
no good row shows is isolated by a short path.  The score is 2 ** (-mean path / usual path).
The threshold is calibrated on labelled rows: the score above which most bad rows lie while
at most ``good_loss`` of the good ones do.

Each tree is grown on ``per_tree`` rows, as isolation forests are, drawn from the ``sample_rows``
good labelled rows with the least hashes; the range and the threshold come from all labelled rows.
Statistics, scores and verdicts cover every row, in one narrow pass without a shuffle.

Edge cases: a null or empty text has no words and fails the base rules; without labels (or
with no bad ones) the forest rejects nothing; a doc_id with conflicting labels counts as bad;
repeated rows are judged each; an empty table gives an empty result; ``judge`` reads only
doc_id and text, ``keep_good`` passes all columns through by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import LEAD, PLAIN, chunks, mix64, segment_sums, span_hash, window_hash

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes")
#: a feature is its statistic as a share of words or lines, over three times the usual limit
FEATURES = (("n_symbols", "n_words", 0.1), ("n_dup_lines", "n_lines", 0.3), ("n_repeat_words", "n_words", 0.2), ("n_echoes", "n_words", 0.1))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
_WINDOW = 5


def _salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """STATISTICS of each text."""
    out: dict[str, list[np.ndarray]] = {s: [np.zeros(0, np.int64)] for s in STATISTICS}
    for c in chunks(column):
        h, room, n = c.hashes(), c.room(), len(c)
        doc = c.doc_of_word()
        out["n_words"].append(c.counts())
        out["word_chars"].append(segment_sums(PLAIN[c.data] & LEAD[c.data], c.text_at))
        out["n_symbols"].append(segment_sums(_SYMBOL[c.data], c.text_at))
        # lines with a word, and how many distinct ones
        breaks = np.flatnonzero(c.data == 0x0A)
        start = np.concatenate((c.text_at[:-1], breaks + 1))
        end = np.concatenate((breaks, c.text_at[1:]))
        owner = np.concatenate((np.arange(n), np.searchsorted(c.text_at, breaks, side="right") - 1))
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        end = np.sort(end, kind="stable") if n == 1 else end[np.lexsort((end, np.concatenate((np.searchsorted(c.text_at, breaks, side="right") - 1, np.arange(n)))))]
        worded = np.searchsorted(c.start, end) > np.searchsorted(c.start, start)
        start, end, owner = start[worded], end[worded], owner[worded]
        _, first = np.unique(_salted(span_hash(c.data, start, end), owner), return_index=True)
        lines = np.bincount(owner, minlength=n)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(lines - np.bincount(owner[first], minlength=n))
        # words in windows that come twice or more
        at = np.flatnonzero(room >= _WINDOW)
        _, inverse, count = np.unique(_salted(window_hash(h, at, _WINDOW), doc[at]), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + _WINDOW, -1)
        out["n_repeat_words"].append(segment_sums(np.cumsum(edge[:-1]) > 0, c.word_at))
        echo = np.zeros(len(h), dtype=bool)
        echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out["n_echoes"].append(segment_sums(echo, c.word_at))
    return {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.minimum(1.0, stats[a] / np.maximum(1, stats[b]) / (3 * limit)) for a, b, limit in FEATURES], axis=1)


def base_failed(stats: dict[str, np.ndarray], least_words: int = 10, repeat_percent: int = 20) -> np.ndarray:
    return (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > repeat_percent * stats["n_words"])


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a random binary tree of n values."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left and right child, path length that a leaf adds."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    usual: float = 1.0

    @classmethod
    def grow(cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, per_tree: int, seed: int) -> Forest:
        rng, found = np.random.default_rng(seed), []
        depth = int(np.ceil(np.log2(max(2, per_tree))))
        open_features = np.flatnonzero(high > low)
        for _ in range(trees):
            sample = rows[rng.choice(len(rows), min(per_tree, len(rows)), replace=False)]
            nodes: list[list] = []

            def split(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: int) -> int:
                me = len(nodes)
                if not left or len(part) <= 1 or not len(open_features):
                    nodes.append([-1, 0.0, -1, -1, depth - left + float(usual_path(len(part)))])
                    return me
                f = int(rng.choice(open_features))
                cut = rng.uniform(lo[f], hi[f])
                nodes.append([f, cut, -1, -1, 0.0])
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = cut
                nodes[me][2] = split(part[part[:, f] < cut], lo, below, left - 1)
                nodes[me][3] = split(part[part[:, f] >= cut], above, hi, left - 1)
                return me

            split(sample, low, high, depth)
            a = np.array(nodes, dtype=float)
            found.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
        return cls(found, float(usual_path(min(per_tree, len(rows)))) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        # most rows share a few values: score each distinct one once
        distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
        total = np.zeros(len(distinct))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(distinct), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at]
                goes_left = distinct[np.arange(len(distinct)), np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += path[at]
        return (2.0 ** (-total / len(self.trees) / self.usual))[inverse.ravel()]


@dataclass
class Model:
    forest: Forest
    threshold: float


def calibrate(good: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """The threshold that catches most bad scores at a loss of at most good_loss of the good ones.

    Where several do, the middle of the gap between them is taken.
    """
    if not len(bad) or not len(good):
        return float("inf")
    values = np.unique(np.concatenate((good, bad)))
    lost = 1 - np.searchsorted(np.sort(good), values, side="right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), values, side="right") / len(bad)
    allowed = np.flatnonzero(lost <= good_loss)
    best = allowed[np.lexsort((lost[allowed], -caught[allowed]))[0]]
    above = values[best + 1] if best + 1 < len(values) else values[best]
    return float((values[best] + above) / 2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    trees: int = 100,
    per_tree: int = 256,
    good_loss: float = 0.001,
    seed: int = 7,
) -> Model:
    """Grow each tree on ``per_tree`` good rows, drawn from the ``sample_rows`` of least hash; calibrate on all labelled rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            x, failed = features(stats), base_failed(stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "failed", *names])

    names = [f"f{i}" for i in range(len(FEATURES))]
    schema = "doc_id long, failed boolean, " + ", ".join(f"{n} double" for n in names)
    # features of all rows, so that no text is shuffled to its label
    told = docs.select("doc_id", "text").mapInArrow(run, schema).where("not failed").join(known, "doc_id")
    # doc_ids may repeat; one row of each is enough
    rows = told.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"), *[F.max(n).alias(n) for n in names])
    rows = materialize(rows, "quality-features")
    spans = rows.agg(*[f(n) for f in (F.min, F.max) for n in names]).first()
    sampled = rows.where("good").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows).collect()
    if not sampled:
        return Model(Forest(), float("inf"))
    good = np.array([[r[n] for n in names] for r in sorted(sampled, key=lambda r: r["doc_id"])], dtype=float)
    forest = Forest.grow(good, np.array(spans[: len(names)], dtype=float), np.array(spans[len(names) :], dtype=float), trees, per_tree, seed)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(x)), batch.column(0)], names=["score", "good"])

    return Model(forest, threshold(rows.select("good", *names).mapInArrow(score, "score double, good boolean"), good_loss))


def threshold(scored: DataFrame, good_loss: float, bins: int = 1 << 14) -> float:
    """``calibrate`` over rows (score, good) of any number: the driver sees counts by bin, finer each time."""
    scored = materialize(scored, "quality-scores")
    goods, bads, low, high = scored.agg(F.count_if("good"), F.count_if(~F.col("good")), F.min("score"), F.max("score")).first()
    if not goods or not bads:
        return float("inf")
    greatest, above = high, 0
    # the least score with few enough good ones above it: in the last bin whose top is allowed
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / (high - low) * bins), F.lit(bins - 1))
        counts = scored.where(F.col("score").between(low, high)).groupBy(place.alias("bin")).agg(F.count_if("good").alias("good"), F.min("score").alias("low"), F.max("score").alias("high"))
        passed = above
        for r in sorted(counts.collect(), key=lambda r: -r["bin"]):
            if 1 - (goods - passed) / goods > good_loss:
                break
            low, high, above = r["low"], r["high"], passed
            passed += r["good"]
    bad = scored.where(~F.col("good") & (F.col("score") > low)).agg(F.min("score")).first()[0]
    if bad is None:
        return float(greatest)
    return float((scored.where(F.col("score") < bad).agg(F.max("score")).first()[0] + bad) / 2)


def _verdict(model: Model, texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    stats = statistics(texts)
    failed, score = base_failed(stats), model.forest.score(features(stats))
    return stats, failed, score, ~failed & ~(score > model.threshold)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, failed, score, kept = _verdict(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[s]) for s in STATISTICS), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *STATISTICS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS) + ", base_failed boolean, score double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdict(shared.value, batch.column(text))[3]))

    return docs.mapInArrow(run, docs.schema)
