"""Language-model scores from a weighted backoff automaton.

Model: n-grams of the training documents with Dirichlet smoothing,

    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu),   p(w) = (c(w) + 1) / (N + V + 1),

h' being h without its first word.  As an automaton: states are the histories seen in
training; a seen n-gram is an arc with log10 p(w | h); every state has a failure arc of
weight log10(mu / (c(h) + mu)) to the state of h', which is exact because an unseen n-gram
has no count of its own.  One traversal from left to right carries the state and adds up.

The counts of the whole corpus never sit in one place: each block of documents asks for the
counts of its own distinct n-grams (see ``blocks``), builds the part of the automaton that
its documents can reach, and scores them.  From order 3 on it asks order by order, and only for
n-grams whose first and last n - 1 words both occur in other blocks too, in training or not;
the others are its own, and nobody else asks for them.  Tokens are lower-cased (A-Z) words and an end
token; the start state is the history "start of text".  Keys are 64-bit hashes of n-grams;
two that collide would share counts (about n**2 / 2**65 pairs among n distinct n-grams).

Edge cases: a null or empty text is one end token; a null doc_id hashes as empty text, which
puts it in training; repeated rows count and are scored each; if nothing is in training all
counts are 0; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .store import materialize, new_folder
from .tokenfiles import slices
from .words import chunks, mix64

END, START = np.uint64(0x656E64), np.uint64(0x7374617274)  # hashes of no word in practice
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and the tokens of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c in chunks(texts, lower=True):
        hashes.append(np.insert(c.hashes(), c.word_at[1:], END))
        counts.append(c.counts() + 1)
    return np.concatenate(hashes), np.concatenate(counts)


def _grams(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: keys of the n-grams, and the positions at which they end.

    A history reaches back to START at most, so n-grams of order n end at position n - 2 or later.
    """
    first = np.cumsum(counts) - counts
    place = np.arange(len(tokens)) - np.repeat(first, counts)
    out, keys = [(tokens, np.arange(len(tokens)))], tokens
    for n in range(2, order + 1):
        before = np.roll(keys, 1)
        if n == 2:
            before[first] = START
        keys = mix64(before * _STEP + tokens + np.uint64(n))
        at = np.flatnonzero(place >= n - 2)
        out.append((keys[at], at))
    return out


def _collect(order: int, block_bytes: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = B.OwnFile(folder)
        for batch in batches:
            for lo, hi in slices(batch.column(1), block_bytes):
                part = batch.slice(lo, hi - lo)
                tokens, counts = _sequence(part.column(1))
                held = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
                vocabulary, local = np.unique(tokens, return_inverse=True)
                own = {**B.pack_ids(part.column(0).to_pylist()), "held": held, "counts": counts, "vocabulary": B.delta(vocabulary), "tokens": B.smallest(local)}
                yield file.add(own, len(vocabulary) + (order - 1) * len(tokens))
                del tokens, counts, vocabulary, local, own
                B.release()
        file.close()

    return run


class _Counted:
    """n-grams of a block and their training counts, order by order as far as answers reach."""

    def __init__(self, own: dict[str, np.ndarray], answers: dict[int, list[dict[str, np.ndarray]]], order: int, answered: int):
        """answered: orders up to this one have been asked for."""
        self.vocabulary, self.counts, self.local = B.undelta(own["vocabulary"]), own["counts"], own["tokens"].astype(np.int64)
        train = np.repeat(own["held"] == 0, self.counts)
        #: (positions, number of the n-gram at each, training count by number)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: of orders without an answer: keys, ascending, and training counts in this block, of what is to be asked
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        elsewhere = below = None
        for n, (keys, at) in enumerate(_grams(self.vocabulary[self.local], self.counts, order), 1):
            known, gram = np.unique(keys, return_inverse=True)
            first = np.empty(len(known), dtype=np.int64)
            first[gram[::-1]] = np.arange(len(gram))[::-1]
            inside = np.bincount(gram, weights=train[at], minlength=len(known)).astype(np.int64)
            asked = np.ones(len(known), dtype=bool)
            if n > 2:
                place = at[first]
                asked = elsewhere[below[place - 1]] & elsewhere[below[place]]
            if n > answered:
                self.open.append((known[asked], inside[asked]))
                if n > 1:
                    return
                continue
            total = inside.copy()
            total[asked] = np.concatenate([np.zeros(0, np.int64), *(a[f"c{n}"] for a in answers.get(n, []))])
            self.orders.append((at, gram, total))
            if 2 <= n < order:
                elsewhere, below = asked.copy(), np.full(len(self.local), -1, dtype=np.int64)
                elsewhere[asked] = np.concatenate([np.zeros(0, bool), *(a[f"e{n}"].astype(bool) for a in answers.get(n, []))])
                below[at] = gram


def _rows(table: pa.Table) -> tuple[dict[str, np.ndarray], dict[int, list[dict[str, np.ndarray]]]]:
    """A block's own part and its answers by order, each in the order of the buckets."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: r[0])
    answers: dict[int, list[dict[str, np.ndarray]]] = {}
    for _, payload in rows[1:]:
        answer = B.unpack(payload)
        for name in answer:
            if name[0] == "c":
                answers.setdefault(int(name[1:]), []).append(answer)
    return B.fetch(rows[0][1]), answers


def _questions(block: str, counted: _Counted, buckets: int) -> pa.RecordBatch:
    first = len(counted.orders) + 1
    asked: list[dict[str, np.ndarray]] = [{} for _ in range(buckets)]
    for n, (keys, counts) in enumerate(counted.open, first):
        edge = B.bucket_edges(keys, buckets)
        for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            asked[b] |= {f"k{n}": B.delta(keys[lo:hi]), f"c{n}": B.smallest(counts[lo:hi])}
    # each round has buckets of its own
    return B.record_batch([(block, (first << 24) + b, B.pack(a)) for b, a in enumerate(asked) if any(len(k) for k in a.values())])


def _ask_first(order: int, buckets: int):
    """Of each block's row: its distinct words and bigrams with their training counts, a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                yield _questions(block, _Counted(B.fetch(payload.as_py()), {}, min(order, 2), 0), buckets)
                B.release()

    return run


def _ask_next(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out = _questions(table["block"][0].as_py(), _Counted(*_rows(table), order, order - 1), buckets)
        B.release()
        return pa.Table.from_batches([out])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """All questions of a bucket: training counts by key and whether other blocks have it too, in the order of each block's keys."""
    names, asked = table["block"].to_pylist(), [B.unpack(x) for x in table["payload"].to_pylist()]
    answers: list[dict[str, np.ndarray]] = [{} for _ in asked]
    distinct = total = 0
    for n in sorted({int(name[1:]) for a in asked for name in a}):
        keys = [B.undelta(a[f"k{n}"]) for a in asked]
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([a[f"c{n}"] for a in asked])).astype(np.int64)
        if n == 1:
            distinct, total = int((sums > 0).sum()), int(sums.sum())
        holders = np.bincount(inverse)
        for i, a in enumerate(answers):
            of = inverse[at[i] : at[i + 1]]
            a[f"c{n}"] = B.smallest(sums[of])
            if n > 1:
                a[f"e{n}"] = (holders[of] > 1).astype(np.uint8)
    columns = {
        "block": pa.array(names),
        "bucket": table["bucket"],
        "payload": pa.array([B.pack(a) for a in answers], pa.binary()),
        "distinct": pa.array([distinct] + [0] * (len(names) - 1), pa.int64()),
        "total": pa.array([total] + [0] * (len(names) - 1), pa.int64()),
    }
    return pa.table(columns)


class Automaton:
    """States, arcs and failure arcs of the n-grams of some texts.

    States: 0 is the empty history, 1 the start of a text, then the seen histories of each
    order.  Arcs: one a word from the empty history, then the seen n-grams of each order, each
    from the state of its history.  ``arcs[m]`` names, for each token of the texts, the arc of the
    (m + 1)-gram that ends there, or -1; it can be taken from the state it leaves only.
    """

    def __init__(self, unigrams: np.ndarray, tokens: np.ndarray, counts: np.ndarray, starts: int, total: int, distinct: int, mu: tuple[float, ...], order: int):
        """unigrams: training count of each local word; tokens, counts: the texts as local words; starts: texts in training."""
        n, self.mu, self.order = len(unigrams), mu, order
        self.tokens, self.counts, self.first = tokens, counts, np.cumsum(counts) - counts
        seen = np.flatnonzero(unigrams)
        self.state_of = np.zeros(n, dtype=np.int64)
        self.state_of[seen] = 2 + np.arange(len(seen)) if order > 1 else 0
        self.count = np.concatenate(([0, starts], unigrams[seen])).astype(float)
        self.level = np.concatenate(([0], np.ones(1 + len(seen), np.int64)))
        self.failure = np.zeros(2 + len(seen), dtype=np.int64)
        self.probability, self.next, self.source = (unigrams + 1) / (total + distinct + 1), self.state_of.copy(), np.zeros(n, dtype=np.int64)
        self.arcs = [tokens]
        self.reached = self.state_of[tokens]  # by the history of the order built last, at each token

    def add(self, m: int, at: np.ndarray, gram: np.ndarray, count: np.ndarray) -> None:
        """The m-grams that end at positions ``at``: ``gram`` numbers them, ``count`` is how often each was trained on."""
        first = np.full(len(count), -1, dtype=np.int64)
        first[gram[::-1]] = at[::-1]
        known = np.flatnonzero(count > 0)
        arc = np.full(len(count), -1, dtype=np.int64)
        arc[known] = len(self.source) + np.arange(len(known))
        here = np.full(len(self.tokens), -1, dtype=np.int64)
        here[at] = arc[gram]
        place = first[known]
        before = np.roll(self.reached, 1)
        if m == 2:
            before[self.first] = 1
        source, lower = before[place], self.arcs[-1][place]
        mu, c = self.mu[m - 2], count[known].astype(float)
        p = (c + mu * self.probability[lower]) / (self.count[source] + mu)
        if m < self.order:
            # the m-gram is a state itself; without its first word it is the state reached from below
            states = len(self.failure) + np.arange(len(known))
            self.failure = np.concatenate((self.failure, self.next[lower]))
            self.count = np.concatenate((self.count, c))
            self.level = np.concatenate((self.level, np.full(len(known), m)))
            reached = np.full(len(count), -1, dtype=np.int64)
            reached[known] = states
            self.reached = np.full(len(self.tokens), -1, dtype=np.int64)
            self.reached[at] = reached[gram]
        else:
            states = self.next[lower]
        self.probability, self.next, self.source = np.concatenate((self.probability, p)), np.concatenate((self.next, states)), np.concatenate((self.source, source))
        self.arcs.append(here)

    def score(self) -> np.ndarray:
        """log10 probability of each text: one traversal from left to right, the texts in step, longest first."""
        weight = np.log10(self.probability)
        back = np.append(self.mu[: self.order - 1], 1.0)[np.maximum(self.level, 1) - 1] if self.order > 1 else np.ones(len(self.level))
        failure_weight = np.log10(back / (self.count + back))
        arcs, counts = np.stack(self.arcs), self.counts
        order = np.argsort(-counts, kind="stable")
        first = self.first[order]
        state = np.full(len(counts), 1 if self.order > 1 else 0, dtype=np.int64)
        total = np.zeros(len(counts))
        alive = np.searchsorted(-counts[order], -np.arange(int(counts.max()) if len(counts) else 0), side="left")
        for t, n in enumerate(alive.tolist()):
            at, s = first[:n] + t, state[:n]
            arc = arcs[self.level[s], at]
            missing = np.flatnonzero((arc < 0) | (self.source[arc] != s))
            while len(missing):
                total[missing] += failure_weight[s[missing]]
                s[missing] = self.failure[s[missing]]
                arc[missing] = arcs[self.level[s[missing]], at[missing]]
                missing = missing[(arc[missing] < 0) | (self.source[arc[missing]] != s[missing])]
            total[:n] += weight[arc]
            state[:n] = self.next[arc]
        out = np.empty(len(counts))
        out[order] = total
        return out


def _scorer(order: int, total: int, distinct: int, mu: tuple[float, ...]):
    def run(table: pa.Table) -> pa.Table:
        own, answers = _rows(table)
        counted = _Counted(own, answers, order, order)
        counts, local, unigrams = counted.counts, counted.local, counted.orders[0][2]
        starts = int(unigrams[np.searchsorted(counted.vocabulary, END)])  # each training text has one end token
        automaton = Automaton(unigrams, local, counts, starts, total, distinct, mu, order)
        for n, (at, gram, seen) in enumerate(counted.orders[1:], 2):
            automaton.add(n, at, gram, seen)
        score = automaton.score()
        edge = np.concatenate(([0], np.cumsum(counts)))
        base = np.log10((unigrams[local] + 1) / (total + (distinct + 1)))
        known = unigrams[local] > 0
        del automaton, answers, counted
        B.release()
        return pa.table(
            {
                "doc_id": B.unpack_ids(own),
                "held_out": pa.array(own["held"].astype(bool)),
                "n_tokens": pa.array(counts.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), edge[:-1])),
                "train_tokens": pa.array(np.full(len(counts), total, dtype=np.int64)),
                "base_score": pa.array(np.add.reduceat(base, edge[:-1])),
                "score": pa.array(score),
            }
        )

    return run


def score(docs: DataFrame, held: Column | None = None, order: int = 3, mu: tuple[float, ...] = (1000.0, 10.0, 10.0), block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held: documents to keep out of training (default: one fold of seven by doc_id).
    mu: the smoothing weight of each order from 2.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    collected = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held")).mapInArrow(_collect(order, block_bytes, new_folder(docs.sparkSession, "lm-own")), B.OWN_SCHEMA)
    own = materialize(collected, "lm-blocks")
    (blocks, buckets), own = B.measured(own), own.drop("keys")
    schema = "block string, bucket int, payload binary, distinct long, total long"
    answers = materialize(own.mapInArrow(_ask_first(order, buckets), B.SCHEMA).groupBy("bucket").applyInArrow(_answer, schema), "lm-answers")
    sums = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    known = own.union(answers.select("block", "bucket", "payload"))
    for n in range(3, order + 1):
        asked = B.by_block(known, blocks).applyInArrow(_ask_next(n, buckets), B.SCHEMA)
        more = materialize(asked.groupBy("bucket").applyInArrow(_answer, schema), "lm-answers")
        known = known.union(more.select("block", "bucket", "payload"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.by_block(known, blocks).applyInArrow(_scorer(order, sums[0], sums[1], mu), out)
