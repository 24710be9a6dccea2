"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: 64 bits over the XXH64 values (seed 42) of a text's 4-word shingles; a bit is
1 if it is set in more than half of them.  Fingerprints link at ``distance`` = 4 or fewer
differing bits.  They are cut into three segments, so of 4 differing bits one segment has at
most one.  Each distinct fingerprint is indexed under every variant of each segment with
one bit made a wildcard (64 keys); two segments that differ in at most one bit share a key.
Rows with an equal key meet in one sorted run, where whole fingerprints are compared and a
spanning forest of the verified links is kept - never all pairs.

A key that more than ``HOT_RUN`` fingerprints share is split: each of them goes once more under
the key joined with one of five pieces of its bits (of which at most 4 differ, so one piece is
equal), so no link is lost and no task holds a hot key.  ``refine`` does the same to all keys
from the start: five times the keys, runs shorter by 2**12, for some ten million distinct
fingerprints and more.  Links are the same either way.

Components are found by distributed star contraction on the fingerprints.

Edge cases: null and wordless texts have the fingerprint zero and link like any other; a
text of fewer than 4 words has one shingle, all its words; null doc_ids get a component_id
like any row but never name one (a component of null doc_ids only has a null id); repeated
rows stay; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize
from .words import chunks, laid_words, mix64

SEGMENTS = ((0, 21), (21, 42), (42, 64))
HOT_RUN = 1 << 14
SHORT_RUN = 1 << 9
_SPREAD = np.zeros(256, dtype=np.uint64)
for _b in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def _bit_counts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in hashes[at[i]:at[i+1]], as (segments, 64)."""
    n = len(at) - 1
    counts = np.zeros((n, 64), dtype=np.int64)
    if not len(hashes):
        return counts
    # cut segments into pieces of at most 255, the most that one byte lane can add up
    pieces = -(-np.diff(at) // 255)
    owner = np.repeat(np.arange(n), pieces)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[owner] + 255 * first
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, byte]], start).view(np.uint8).reshape(-1, 8)
        np.add.at(counts[:, 8 * byte : 8 * byte + 8], owner, sums)
    return counts


def fingerprints(column: pa.Array, k: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    digest, out = xxhash.xxh64_intdigest, []
    for c in chunks(column, lower=True):
        # a shingle is a slice of the words laid out with one space after each
        raw, at = laid_words(c)
        room = c.room()
        whole = np.repeat(c.counts() < k, c.counts())
        first = np.flatnonzero((room >= k) | (whole & (room == np.repeat(c.counts(), c.counts()))))
        last = np.minimum(first + k, first + room[first])
        raw = memoryview(raw)
        hashes = np.array([digest(raw[a:b], 42) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)], dtype=np.uint64)
        shingle_at = np.searchsorted(first, c.word_at)
        set_in = _bit_counts(hashes, shingle_at)
        bits = 2 * set_in > np.diff(shingle_at)[:, None]
        out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def add_fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(len(keep))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), fp], names=[*keep, "fp"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _pieces(distance: int) -> list[np.uint64]:
    """Masks of distance + 1 pieces of the 64 bits: one of them is equal in any two linked fingerprints."""
    n = distance + 1
    return [np.uint64((1 << 64 * (p + 1) // n) - (1 << 64 * p // n)) for p in range(n)]


def _mixed(key: np.ndarray, fp: np.ndarray, number: int) -> np.ndarray:
    return mix64(key ^ mix64(fp ^ mix64(np.full(1, number + 1, np.uint64))))


def _variants(distance: int, refine: bool):
    """Index rows (key, fp, more columns) of each fingerprint; a column ``print`` keeps fingerprints of several kinds apart."""
    plans = [(100 * s + bit, (1 << hi) - (1 << lo) & ~(1 << bit)) for s, (lo, hi) in enumerate(SEGMENTS) for bit in range(lo, hi)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                fp = part.column(0).to_numpy().view(np.uint64)
                kind = part.column("print").to_numpy().astype(np.uint64) * np.uint64(1000) if "print" in part.schema.names else np.zeros(1, np.uint64)
                keys = [_mixed(kind + np.uint64(number), fp & np.uint64(mask), 0) for number, mask in plans]
                if refine:
                    keys = [_mixed(k, fp & mask, p) for k in keys for p, mask in enumerate(_pieces(distance))]
                yield _under(keys, fp, part.column("id") if "id" in part.schema.names else None)

    return run


def _under(keys: list[np.ndarray], fp: np.ndarray, ids: pa.Array | None) -> pa.RecordBatch:
    columns = {"key": pa.array(np.concatenate(keys).view(np.int64)), "fp": pa.array(np.tile(fp, len(keys)).view(np.int64))}
    if ids is not None:
        columns["id"] = pa.array(np.tile(ids.to_numpy(), len(keys)))
    return pa.RecordBatch.from_pydict(columns)


def _split_keys(distance: int):
    """Rows of hot keys under as many narrower keys as there are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            keys = [_mixed(key, fp & mask, p) for p, mask in enumerate(_pieces(distance))]
            yield _under(keys, fp, batch.column("id") if "id" in batch.schema.names else None)

    return run


def _centre(fp: np.ndarray) -> int:
    """The fingerprint nearest to the bits that most have."""
    set_in = _bit_counts(fp, np.array([0, len(fp)]))[0]
    middle = np.packbits(2 * set_in > len(fp), bitorder="little").view(np.uint64)[0]
    return int(np.argmin(np.bitwise_count(fp ^ middle)))


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions, of the links among fingerprints: searched breadth-first from central ones, each is compared once with all not yet reached."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        first = _centre(fp[left]) if len(left) > 2 and not a else 0
        queue, left = [left[first]], np.delete(left, first)
        while queue and len(left):
            x = queue.pop(0)
            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _linked(fp: np.ndarray, start: np.ndarray, size: np.ndarray, distance: int) -> list[np.ndarray]:
    """Of runs of bounded size, the positions of those members that have a link, run by run; compared some million pairs at a time."""
    head = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    later = np.repeat(start + size, size) - head - 1
    upto, cut, run_of, found = np.cumsum(later), 0, np.repeat(np.arange(len(start)), size), [np.zeros((2, 0), np.int64)]
    while cut < len(head):
        before = upto[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(upto, before + (1 << 20), side="right")))
        n = later[cut:stop]
        x = np.repeat(head[cut:stop], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        near = np.flatnonzero(np.bitwise_count(fp[x] ^ fp[y]) <= distance)
        run = np.repeat(run_of[cut:stop], n)[near]
        found += [np.stack((run, x[near])), np.stack((run, y[near]))]
        cut = stop
    members = np.unique(np.concatenate(found, axis=1), axis=1)
    return np.split(members[1], np.flatnonzero(np.diff(members[0])) + 1) if members.shape[1] else []


def _links(distance: int, most: int | None):
    """From rows (key, fp[, id]) sorted by key: verified links (a, b) of ids, or fingerprints, that span each run of equal keys.

    Rows of runs longer than ``most`` come as they are, marked hot.
    """

    def settle(key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        pairs = start[size == 2]
        pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
        a, b = [ids[pairs]], [ids[pairs + 1]]
        some = (size > 2) & (size <= SHORT_RUN)
        near = _linked(fp, start[some], size[some], distance)
        for members in [*near, *(np.arange(s, s + n) for s, n in zip(start.tolist(), size.tolist(), strict=True) if n > SHORT_RUN and (most is None or n <= most))]:
            x, y = forest(fp[members], distance)
            a.append(ids[members[x]])
            b.append(ids[members[y]])
        return np.concatenate(a), np.concatenate(b)

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, none], names=["a", "b", "key", "fp", "id"])

    def hot(key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(fp.view(np.int64)), pa.array(ids.view(np.int64))], names=["a", "b", "key", "fp", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the parts of the last run, which may go on
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            ids = batch.column(2).to_numpy() if batch.num_columns > 2 else fp
            if not len(key):
                continue
            if held and key[-1] == held[0][0][0]:
                held.append((key, fp, ids))
            else:
                cut = int(np.searchsorted(key, key[-1]))
                done = [*held, (key[:cut], fp[:cut], ids[:cut])]
                held = [(key[cut:], fp[cut:], ids[cut:])]
                yield from flush(*(np.concatenate(x) for x in zip(*done, strict=True)))
            if most is not None and sum(len(k) for k, *_ in held) > 4 * most:
                # long enough to be hot whatever follows; what stays behind is hot by its own length
                key, fp, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                yield hot(key[: -most - 1], fp[: -most - 1], ids[: -most - 1])
                held = [(key[-most - 1 :], fp[-most - 1 :], ids[-most - 1 :])]
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def flush(key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        yield rows(*settle(key, fp, ids))
        if most is not None:
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            some = np.repeat(size > most, size)
            if some.any():
                yield hot(key[some], fp[some], ids[some])

    return run


def fingerprint_links(prints: DataFrame, distance: int = 4, refine: bool = False, hot_run: int = HOT_RUN) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints at most ``distance`` bits apart.

    prints: fp, no repeats, and links are of fingerprints; or fp, id, print, and links are of the
    ids of fingerprints of one print.
    """
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("three segments allow up to 5 differing bits")
    columns = [c for c in ("fp", "id", "print") if c in prints.columns]
    with_id = ", id long" if "id" in columns else ""
    schema, keyed = "a long, b long, key long, fp long, id long", f"key long, fp long{with_id}"
    index = prints.select(columns).mapInArrow(_variants(distance, refine), keyed).repartition("key").sortWithinPartitions("key")
    found = materialize(index.mapInArrow(_links(distance, hot_run), schema), "fingerprint-links")
    hot = found.where("key is not null").select("key", "fp", *(["id"] if with_id else []))
    narrow = hot.mapInArrow(_split_keys(distance), keyed).repartition("key").sortWithinPartitions("key")
    more = narrow.mapInArrow(_links(distance, None), schema)
    return found.where("key is null").union(more).select("a", "b")


def fingerprint_components(distinct: DataFrame, distance: int = 4, **options) -> DataFrame:
    """distinct: column fp, no repeats.  Returns node, root of every fingerprint that has a link."""
    return connected_components(fingerprint_links(distinct, distance, **options))


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialize(add_fingerprints(docs, "doc_id"), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(classes.select("fp"), distance)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "fingerprint-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", digits, "component_id")
