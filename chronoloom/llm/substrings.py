"""Substring dedup by seed and extend.

Seeds: 10-word grams are winnowed so that every window of ``length`` = 20 words holds its
least gram as an anchor, at the same place wherever the window's words occur.  An anchor's
reach is the run of words that the windows it stands for cover.

1. Anchors are joined on their hash.  Occurrences whose reach to both sides has the same hash
   too are candidates for repeats of the earliest one of them.
2. Candidates are extended word by word: the words of a candidate's whole reach are compared
   with those of the earliest occurrence.  Where an anchor has different reaches, the earliest
   occurrence of each is extended window by window in the same way.

Words covered by repeats are removed; merged they are the maximal repeats.  Since all
occurrences of a window share its anchor and those of equal reach have equal windows, this
finds exactly the windows that start earlier elsewhere.  Hashes only bring occurrences
together; nothing is removed before its words have been compared.

Joins go through ``blocks``: each block sends a reach or window once, however often it holds
it, so a passage that a third of all documents share costs one key a block.  Only candidates'
words are sent.

Order of documents: by doc_id, null last, then by a hash of the text; rows equal in both are
the same document and get the same result.  Null and short texts have no windows; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .store import materialize, new_folder
from .tokenfiles import slices
from .words import chunks, mix64, span_hash, text_buffers, window_hash

#: answers on an anchor, as bits: others have its reach; one of them is earlier; its hash has other reaches too
_SHARED, _LATER, _MIXED = 1, 2, 4
_COMPARE = 1 << 20
_LAY_WORDS = 1 << 18


class Anchors:
    """Anchors of a block: gram position, first and last window start, hash and hash of the reach."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, length: int, gram: int):
        end = np.repeat(np.cumsum(counts), counts)
        room = end - np.arange(len(hashes))
        grams = np.full(len(hashes), ~np.uint64(0))
        whole = np.flatnonzero(room >= gram)
        grams[whole] = window_hash(hashes, whole, gram)
        window = np.flatnonzero(room >= length)
        at, least = window.copy(), grams[window]
        for o in range(1, length - gram + 1):
            here = grams[window + o]
            less = here < least
            least[less], at[less] = here[less], window[less] + o
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.at = at[new]
        self.first = window[new]
        self.last = window[np.append(new[1:], len(window)) - 1] if len(new) else self.first
        self.hash = grams[self.at]
        stop = self.last + length
        self.reach = mix64(window_hash(hashes, self.first, stop - self.first) + (self.at - self.first).astype(np.uint64))


def _ranks(no_id: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rank of each document; equal ones share it."""
    order = np.lexsort((tie, ids, no_id))
    n, i, t = no_id[order], ids[order], tie[order]
    new = np.ones(len(order), dtype=np.int64)
    if len(order):
        new[1:] = (n[1:] != n[:-1]) | (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _group(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by keys (in sorted order), and the earliest row of each group."""
    by = np.lexsort((order, *reversed(keys)))
    new = np.zeros(len(by), dtype=bool)
    if len(by):
        new[0] = True
        for k in keys:
            new[1:] |= k[by[1:]] != k[by[:-1]]
    number = np.empty(len(by), dtype=np.int64)
    number[by] = np.cumsum(new) - 1
    return number, by[new]


def _message(own: dict[str, np.ndarray], doc: np.ndarray, start: np.ndarray, more: dict[str, np.ndarray]) -> bytes:
    """Rows with the order of their documents, the documents named once."""
    docs, local = np.unique(doc, return_inverse=True)
    named = {"ids": own["ids"][docs], "no_id": own["no_id"][docs], "tie": own["tie"][docs]}
    return B.pack(named | {"doc": B.smallest(local), "start": B.smallest(start)} | more)


def _orders(messages: list[dict[str, np.ndarray]]) -> np.ndarray:
    """One order over the rows of all messages."""
    rank = _ranks(*(np.concatenate([m[k] for m in messages]) for k in ("no_id", "ids", "tie")))
    shift = np.concatenate(([0], np.cumsum([len(m["ids"]) for m in messages])[:-1])).tolist()
    return np.concatenate([rank[m["doc"].astype(np.int64) + s] << 32 | m["start"].astype(np.int64) for m, s in zip(messages, shift, strict=True)])


def _spans_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], some million elements at a time."""
    out, rows = np.ones(len(a), dtype=bool), np.flatnonzero(a != b)
    a, shift, size = a[rows], b[rows] - a[rows], size[rows]
    ends, first = np.cumsum(size), 0
    while first < len(rows):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + _COMPARE, side="right")))
        n = size[first:stop]
        at = np.repeat(a[first:stop] - (ends[first:stop] - n - before), n) + np.arange(n.sum())
        unlike = np.flatnonzero(data[at] != data[at + np.repeat(shift[first:stop], n)])
        out[rows[first + np.searchsorted(ends[first:stop] - before, unlike, side="right")]] = False
        first = stop
    return out


def _same_words(data: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal slices data[at:at + size] that share a key: number of each, and the earliest of each group."""
    number, earliest = _group(order, key, size)
    first = earliest[number]
    unlike = np.flatnonzero(~_spans_equal(data, at, at[first], size))
    if len(unlike):  # slices that share a key by chance: tell them apart by themselves
        names: dict[tuple[int, bytes], int] = {}
        number = number.copy()
        for i in unlike.tolist():
            number[i] = names.setdefault((int(number[i]), data[at[i] : at[i] + size[i]].tobytes()), len(earliest) + len(names))
        number, earliest = _group(order, number)
    return number, earliest


class _Block:
    """A block's documents as local word numbers, and its anchors."""

    def __init__(self, own: dict[str, np.ndarray], length: int, gram: int):
        self.own, self.length = own, length
        self.words, self.counts = own["words"].astype(np.int64), own["counts"].astype(np.int64)
        self.stop = np.cumsum(own["sizes"].astype(np.int64))
        self.hashes = span_hash(own["vocabulary"], self.stop - own["sizes"], self.stop)[self.words]
        self.word_at = np.concatenate(([0], np.cumsum(self.counts)))
        self.anchors = Anchors(self.hashes, self.counts, length, gram)
        self.rank = _ranks(own["no_id"], own["ids"], own["tie"])

    def place(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start in it and order of word positions."""
        doc = np.searchsorted(self.word_at, position, side="right") - 1
        start = position - self.word_at[doc]
        return doc, start, self.rank[doc] << 32 | start

    def lay(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of words, each with a space after it, and where each starts (one more than words)."""
        n = self.own["sizes"].astype(np.int64)[words] + 1
        at = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(self.stop[words] - n + 1 - at[:-1], n) + np.arange(at[-1])
        laid = np.append(self.own["vocabulary"], np.uint8(0x20))[np.minimum(source, len(self.own["vocabulary"]))]
        laid[at[1:] - 1] = 0x20
        return laid, at

    def questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors to ask for, the group of each anchor, and which ones repeat one in this block word by word."""
        a = self.anchors
        _, _, order = self.place(a.first)
        number, earliest = _group(order, a.hash, a.reach)
        size = a.last + self.length - a.first
        first = earliest[number]
        unlike = (size != size[first]) | ~_spans_equal(self.words, a.first, a.first[first], np.minimum(size, size[first]))
        if unlike.any():  # equal hashes of unlike words: each such anchor asks for itself
            number[unlike] = len(earliest) + np.arange(unlike.sum())
            earliest = np.concatenate((earliest, np.flatnonzero(unlike)))
            by = np.lexsort((a.reach[earliest], a.hash[earliest]))
            back = np.empty(len(by), dtype=np.int64)
            back[by] = np.arange(len(by))
            number, earliest = back[number], earliest[by]
        return earliest, number, order > order[earliest][number]

    def ask(self, buckets: int) -> list[tuple[int, bytes]]:
        a, (asked, _, _) = self.anchors, self.questions()
        doc, start, _ = self.place(a.first[asked])
        edge = B.bucket_edges(a.hash[asked], buckets)
        return [
            (b, _message(self.own, doc[lo:hi], start[lo:hi], {"key": B.delta(a.hash[asked[lo:hi]]), "reach": a.reach[asked[lo:hi]]}))
            for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True))
            if hi > lo
        ]

    def candidates(self, status: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is to be compared: starts and lengths in words, key, group of each, earliest of each group; first the
        shared reaches, then the windows of earliest reaches among several; and how many are reaches."""
        a, (asked, _, _) = self.anchors, self.questions()
        whole = asked[(status & _SHARED) > 0]
        mixed = asked[((status & _MIXED) > 0) & ((status & _LATER) == 0)]
        n = a.last[mixed] - a.first[mixed] + 1
        windows = np.repeat(a.first[mixed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.concatenate((a.first[whole], windows))
        size = np.concatenate((a.last[whole] + self.length - a.first[whole], np.full(len(windows), self.length)))
        key = window_hash(self.hashes, at, size, 2)
        number, earliest = _same_words(self.words, at, size, key, self.place(at)[2])
        by = np.argsort(key[earliest], kind="stable")
        back = np.empty(len(by), dtype=np.int64)
        back[by] = np.arange(len(by))
        return at, size, key, back[number], earliest[by], len(whole)

    def ask_words(self, status: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
        at, size, key, _, earliest, _ = self.candidates(status)
        at, size, key = at[earliest], size[earliest], key[earliest]
        doc, start, _ = self.place(at)
        out, edge = [], B.bucket_edges(key, buckets)
        for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if hi > lo:
                n = size[lo:hi]
                text, laid = self.lay(self.words[np.repeat(at[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                stop = laid[np.cumsum(n)]
                out.append((b, _message(self.own, doc[lo:hi], start[lo:hi], {"key": B.delta(key[lo:hi]), "size": B.smallest(np.diff(stop, prepend=0)), "text": text})))
        return out

    def removed(self, status: np.ndarray, compared: np.ndarray) -> np.ndarray:
        """Which words a repeat covers."""
        a, (asked, number, repeats) = self.anchors, self.questions()
        at, size, _, group, earliest, n_whole = self.candidates(status)
        order = self.place(at)[2]
        again = compared[group].astype(bool) | (order > order[earliest][group])
        later = status[(status & _SHARED) > 0] & _LATER > 0
        if (later & ~again[:n_whole]).any():
            raise RuntimeError("two passages of unlike words share 128 bits of hashes; choose other hash bases")
        # anchors that repeat one of this block, and those whose reach was found earlier
        found = np.zeros(len(asked), dtype=bool)
        found[np.flatnonzero((status & _SHARED) > 0)] = again[:n_whole]
        whole = repeats | found[number]
        at = at[n_whole:][again[n_whole:]]
        edge = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(edge, a.first[whole], 1)
        np.add.at(edge, a.last[whole] + self.length, -1)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def _collect(block_bytes: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = B.OwnFile(folder)
        for batch in batches:
            for lo, hi in slices(batch.column(1), block_bytes):
                part = batch.slice(lo, hi - lo)
                raw, text_at = text_buffers(part.column(1))
                tie = np.array([zlib.crc32(raw[a:b]) for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)], dtype=np.uint32)
                hashes, starts, sizes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for c in chunks(part.column(1)):
                    hashes.append(c.hashes())
                    starts.append(c.start + text_at[c.first])
                    sizes.append(c.end - c.start)
                    counts.append(c.counts())
                start, size = np.concatenate(starts), np.concatenate(sizes)
                _, first, local = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
                n = size[first]
                unlike = ~_spans_equal(raw, start, start[first][local], np.minimum(size, n[local])) | (size != n[local])
                if unlike.any():  # words of equal hashes: numbers of their own
                    local[unlike], first = len(first) + np.arange(unlike.sum()), np.concatenate((first, np.flatnonzero(unlike)))
                    n = size[first]
                vocabulary = raw[np.repeat(start[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                own = {
                    **B.pack_ids(part.column(0).to_pylist()),
                    "tie": tie,
                    "counts": np.concatenate(counts),
                    "sizes": n,
                    "vocabulary": vocabulary,
                    "words": B.smallest(local),
                }
                yield file.add(own, len(size))
                del raw, hashes, starts, sizes, counts, start, size, first, local, vocabulary, own
                B.release()
        file.close()

    return run


def _ask(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                messages = _Block(B.fetch(payload.as_py()), length, gram).ask(buckets)
                yield B.record_batch([(block, b, m) for b, m in messages])
                B.release()

    return run


def _answers(table: pa.Table, answers: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": table["block"], "bucket": table["bucket"], "payload": pa.array([B.pack({"status": a}) for a in answers], pa.binary())})


def _split(values: np.ndarray, messages: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(m["start"]) for m in messages])[:-1])


def _answer_anchors(table: pa.Table) -> pa.Table:
    messages = [B.unpack(x) for x in table["payload"].to_pylist()]
    key = np.concatenate([B.undelta(m["key"]) for m in messages])
    reach, order = np.concatenate([m["reach"] for m in messages]), _orders(messages)
    number, earliest = _group(order, key, reach)
    anchor, _ = _group(order, key)
    reaches, members = np.bincount(anchor[earliest], minlength=1), np.bincount(number, minlength=1)
    status = (members[number] > 1) * _SHARED + (order > order[earliest][number]) * _LATER + (reaches[anchor] > 1) * _MIXED
    return _answers(table, _split(status.astype(np.uint8), messages))


def _answer_words(table: pa.Table) -> pa.Table:
    """Whether the same words start earlier."""
    messages = [B.unpack(x) for x in table["payload"].to_pylist()]
    key, order = np.concatenate([B.undelta(m["key"]) for m in messages]), _orders(messages)
    size = np.concatenate([m["size"].astype(np.int64) for m in messages])
    number, earliest = _same_words(np.concatenate([m["text"] for m in messages]), np.cumsum(size) - size, size, key, order)
    return _answers(table, _split((order > order[earliest][number]).astype(np.uint8), messages))


#: buckets of the second round have numbers from here on, beyond those of blocks.measured
_SECOND = B.MOST_BUCKETS


def _rows(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A block's own part and the answers of both rounds, each in the order of the buckets."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: r[0])
    none = [np.zeros(0, np.uint8)]
    rounds = [np.concatenate(none + [B.unpack(p)["status"] for b, p in rows[1:] if (b >= _SECOND) == second]) for second in (False, True)]
    return B.fetch(rows[0][1]), *rounds


def _ask_words(length: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        own, status, _ = _rows(table)
        block = table["block"][0].as_py()
        messages = _Block(own, length, gram).ask_words(status, buckets)
        return pa.Table.from_batches([B.record_batch([(block, _SECOND + b, m) for b, m in messages])])

    return run


def _finish(length: int, gram: int, with_text: bool):
    def run(table: pa.Table) -> pa.Table:
        own, status, compared = _rows(table)
        block = _Block(own, length, gram)
        gone = block.removed(status, compared)
        at, counts = block.word_at, block.counts
        digests, texts, spans = [], [], []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))) | np.isin(np.arange(len(gone) + 1), at))
        first = 0
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + _LAY_WORDS, side="right")) - 1)
            last = min(last, len(counts))
            kept = np.flatnonzero(~gone[at[first] : at[last]]) + at[first]
            laid, laid_at = block.lay(block.words[kept])
            raw = laid.tobytes()
            cut = laid_at[np.searchsorted(kept, at[first : last + 1])].tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                text = raw[a : max(a, b - 1)]
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            first = last
        for d in range(len(counts)):
            own_edge = edge[np.searchsorted(edge, at[d]) : np.searchsorted(edge, at[d + 1], side="right")].tolist()
            spans.append([{"start": a - int(at[d]), "end": b - int(at[d])} for a, b in zip(own_edge[:-1], own_edge[1:], strict=True) if gone[a]] if counts[d] else [])
        n_gone = np.concatenate(([0], np.cumsum(gone)))
        columns = {
            "doc_id": B.unpack_ids(own),
            "n_words": pa.array(counts),
            "n_removed": pa.array((n_gone[at[1:]] - n_gone[at[:-1]]).astype(np.int64)),
            "kept_sha256": pa.array(digests, pa.string()),
            "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
        if with_text:
            columns["kept_text"] = pa.array(texts, pa.string())
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, length: int = 20, gram: int = 10, with_text: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, repeats and, if asked for, kept_text.

    repeats: the maximal runs of removed words as (start, end), in words of the document.
    """
    schema = "block string, bucket int, payload binary"
    own = materialize(docs.select("doc_id", "text").mapInArrow(_collect(block_bytes, new_folder(docs.sparkSession, "repeat-own")), B.OWN_SCHEMA), "repeat-blocks")
    (blocks, buckets), own = B.measured(own), own.drop("keys")
    asked = own.mapInArrow(_ask(length, gram, buckets), B.SCHEMA)
    anchors = materialize(asked.groupBy("bucket").applyInArrow(_answer_anchors, schema), "repeat-anchors")
    candidates = B.by_block(own.union(anchors), blocks).applyInArrow(_ask_words(length, gram, buckets), schema)
    words = materialize(candidates.groupBy("bucket").applyInArrow(_answer_words, schema), "repeat-words")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>" + ", kept_text string" * with_text
    return B.by_block(own.union(anchors).union(words), blocks).applyInArrow(_finish(length, gram, with_text), out)
