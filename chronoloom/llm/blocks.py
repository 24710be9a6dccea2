"""Blocks: exchanging key counts between slices of the corpus without a row per occurrence.

A block is a slice of documents of bounded size that one task holds.  It keeps its own part
(its documents in local numbers) as one row and sends its distinct 64-bit keys, cut by their
leading bits into buckets, as one row a bucket that gets any.  A bucket sees each key at most
once a block, however frequent the key is, so hot keys are aggregated before the shuffle.  It
answers every block that asks with one row, in the order of the keys asked for; blocks join
their answers by block id.

There are as many buckets as the keys of the corpus need at ``BUCKET_BYTES`` each, so what one
call holds does not depend on the corpus or on the number of shuffle partitions.  Rows are at
most blocks times buckets, and never more than distinct keys of blocks.

Blocks' own parts lie in files of the shared folder, one file a task under a name of its own
attempt; a row points to each.  So block ids and contents stay the same whatever is repeated
later, and no own part is ever shuffled: who has a block's answers fetches it.
"""

from __future__ import annotations

import ctypes
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

SCHEMA = "block string, bucket int, payload binary"
ARROW_SCHEMA = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
#: blocks' own rows: a pointer, and the number of keys they will ask for at most
OWN_SCHEMA = SCHEMA + ", keys long"
#: keys of a bucket, as packed bytes
BUCKET_BYTES, KEY_BYTES = 4 << 20, 6
#: buckets at most, so that a second round's fit into 32 bits beside them; reached at 7 * 10**14 keys
MOST_BUCKETS = 1 << 30


def measured(own: DataFrame) -> tuple[int, int]:
    """How many blocks there are, and how many buckets their keys need."""
    blocks, keys = own.agg(F.count("*"), F.sum("keys")).first()
    return blocks, min(MOST_BUCKETS, max(1, -(-(keys or 0) * KEY_BYTES // BUCKET_BYTES)))


def by_block(rows: DataFrame, blocks: int) -> GroupedData:
    """Blocks' rows grouped.  They are small, since own parts are not in them, but the work on a block is not: about a task each."""
    return rows.repartition(min(max(1, blocks), 100_000), "block").groupBy("block")


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as bytes; 64-bit integers are laid out bytewise, which compresses sorted deltas."""
    head, parts, squeeze = [], [], zstandard.ZstdCompressor(level=1)
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        raw = squeeze.compress(raw)
        head.append((name, a.dtype.str, len(a), len(raw)))
        parts.append(raw)
    text = json.dumps(head).encode()
    return b"".join([struct.pack("<I", len(text)), text, *parts])


def unpack(data: bytes) -> dict[str, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    out, at, expand = {}, 4 + n, zstandard.ZstdDecompressor()
    for name, kind, size, length in json.loads(data[4 : 4 + n]):
        dtype = np.dtype(kind)
        raw = np.frombuffer(expand.decompress(data[at : at + length], max_output_size=max(1, size * dtype.itemsize)), np.uint8) if size else np.zeros(0, np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(dtype.itemsize, size).T).reshape(-1).view(dtype) if dtype.itemsize > 1 else raw.view(dtype)
        at += length
    return out


def delta(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0)) if len(sorted_keys) else sorted_keys


def undelta(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=np.uint64)


def bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start: buckets are ranges of the leading 32 bits."""
    limits = np.array([-(-(b << 32) // buckets) for b in range(buckets)], dtype=np.uint64) << np.uint64(32)
    return np.append(np.searchsorted(sorted_keys, limits), len(sorted_keys))


def smallest(values: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack_ids(ids: list[int | None]) -> dict[str, np.ndarray]:
    return {"ids": np.array([0 if x is None else x for x in ids], dtype=np.int64), "no_id": np.array([x is None for x in ids], dtype=np.uint8)}


def unpack_ids(arrays: dict[str, np.ndarray]) -> pa.Array:
    return pa.array(arrays["ids"], mask=arrays["no_id"].astype(bool))


def record_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_SCHEMA, strict=True)], schema=ARROW_SCHEMA)


class OwnFile:
    """Own parts of the blocks that a task makes, in one file."""

    def __init__(self, folder: str):
        from .tokenfiles import filesystem

        self.uri, self.at = f"{folder}/{uuid.uuid4().hex}.own", 0
        files, path = filesystem(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path)

    def add(self, arrays: dict[str, np.ndarray], keys: int) -> pa.RecordBatch:
        """The block's row."""
        payload = pack(arrays)
        self.out.write(payload)
        pointer = json.dumps([self.uri, self.at, len(payload)]).encode()
        self.at += len(payload)
        columns = [pa.array([uuid.uuid4().hex]), pa.array([-1], pa.int32()), pa.array([pointer], pa.binary()), pa.array([keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "payload", "keys"])

    def close(self) -> None:
        self.out.close()


def fetch(pointer: bytes) -> dict[str, np.ndarray]:
    """A block's own part."""
    from .tokenfiles import filesystem

    uri, at, size = json.loads(pointer)
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        f.seek(at)
        return unpack(f.read(size))


def release() -> None:
    """Give freed memory back: several workers share a machine, and rarely peak at once."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
