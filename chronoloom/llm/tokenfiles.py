"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

File format (little-endian), one file a shard:

    8 bytes   magic "CLTOKEF1"
    u32 u32   bytes an id (2 or 4), documents with a null doc_id (they come first)
    i64       smallest doc_id; the coded ids are relative to it
    u64 u64   documents, ids
    u64 u64   bytes of the two coded sequences that follow
    ...       Elias-Fano: doc_id - smallest, of the documents that have one
    ...       Elias-Fano: offset in ids at which each document ends
    ...       ids, each document's with the end id last

``select`` on the second sequence gives any document's range without a table of 64-bit
offsets; readers go through a shard by selects of some thousand documents, whose ids alone
they fetch.  Documents are range-partitioned and sorted by doc_id, each task writes its range as
shards of bounded size, first under a name of its own attempt and then renamed, so a repeated
task leaves the same files.  The manifest (one row a shard) is a table in the shared folder.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids
follow in the order of their texts' hashes and repeated rows stay; an empty table gives no
shard; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elias_fano
from .blocks import release
from .store import materialize, new_path
from .words import text_buffers

MAGIC = b"CLTOKEF1"
_HEAD = struct.Struct("<8sIIqQQQQ")
MANIFEST = "partition int, part int, path string, docs long, ids long"


def filesystem(uri: str):
    """A pyarrow file system and the path in it; works for local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    names = elias_fano.encode(known.astype(np.uint64) - np.uint64(least % 2**64))
    bounds = elias_fano.encode(ends.astype(np.uint64))
    head = _HEAD.pack(MAGIC, id_bytes, len(doc_ids) - len(known), least, len(doc_ids), len(ids), len(names), len(bounds))
    return b"".join([head, names, bounds, ids.astype(f"<u{id_bytes}").tobytes()])


class Shard:
    """Reader of one file, which must seek."""

    def __init__(self, file):
        self.file = file
        magic, self.id_bytes, self.nulls, self.least, self.docs, self.n_ids, n_names, n_bounds = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.names = elias_fano.EliasFano(self._read(_HEAD.size, n_names))
        self.bounds = elias_fano.EliasFano(self._read(_HEAD.size + n_names, n_bounds))
        self.ids_at = _HEAD.size + n_names + n_bounds

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._read(self.ids_at + start * self.id_bytes, (stop - start) * self.id_bytes), dtype=f"<u{self.id_bytes}")

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        known = self.names.values(max(0, first - self.nulls), max(0, stop - self.nulls))
        return [None] * max(0, min(stop, self.nulls) - first) + (known + np.uint64(self.least % 2**64)).astype(np.int64).tolist()

    def bounds_of(self, first: int, stop: int) -> np.ndarray:
        """Where documents first to stop - 1 start in the shard's ids, and where the last one ends."""
        if not first:
            return np.append(0, self.bounds.values(0, stop).astype(np.int64))
        return self.bounds.values(first - 1, stop).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of this shard, by two selects."""
        return self.ids(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    _, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        stop = min(n, max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1))
        yield first, stop
        first = stop


def _writer(folder: str, definition: str, end_id: int, shard_ids: int, slice_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        enc, where = encoder(definition), TaskContext.get().partitionId()
        id_bytes = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        docs, ids, ends, size, rows = [], [], [], 0, []

        def flush() -> None:
            name = f"shard-{where:06d}-{len(rows):04d}.bin"
            attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(attempt) as f:
                f.write(pack(docs, np.concatenate(ends), np.concatenate(ids), id_bytes))
            files.move(attempt, f"{root}/{name}")
            rows.append((where, len(rows), f"{folder}/{name}", len(docs), size))

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for first, stop in slices(texts, slice_bytes):
                out, at = enc.encode(texts.slice(first, stop - first), end_id)
                docs += names.slice(first, stop - first).to_pylist()
                ids.append(out.astype(f"<u{id_bytes}"))
                ends.append(size + at[1:])
                size += len(out)
                del out, at
                release()
                if size >= shard_ids:
                    flush()
                    docs, ids, ends, size = [], [], [], 0
        if docs:
            flush()
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["partition", "part", "path", "docs", "ids"])

    return write


@dataclass(frozen=True)
class TokenFiles:
    """A written dataset; manifest: partition, part, path, docs, ids of each shard and ``before``, the ids of all shards before it."""

    folder: str
    manifest: DataFrame


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    folder: str | None = None,
    shard_ids: int = 1 << 23,
    slice_bytes: int = 16 << 20,
) -> TokenFiles:
    """Encode doc_id, text in ascending doc_id order into files in ``folder`` (default: the shared one)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(ranged.select("doc_id", "text").mapInArrow(_writer(folder, definition, end_id, shard_ids, slice_bytes), MANIFEST), "token-manifest")
    # offsets by partition first: a row a task in one window, then a row a shard
    earlier = Window.partitionBy(F.lit(0)).orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy("partition").agg(F.sum("ids").alias("n")).select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("ids").over(within), F.lit(0))
    return TokenFiles(folder, written.join(offsets, "partition").select("partition", "part", "path", "docs", "ids", before.alias("before")))


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False, docs_at_once: int = 4096) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    shard = Shard(f)
                    for first in range(0, shard.docs, docs_at_once):
                        stop = min(shard.docs, first + docs_at_once)
                        at = shard.bounds_of(first, stop)
                        ids, cut = shard.ids(at[0], at[-1]), at - at[0]
                        columns = {
                            "doc_id": pa.array(shard.doc_ids(first, stop), pa.int64()),
                            "start": pa.array(at[:-1] + before),
                            "n_tokens": pa.array(np.diff(at)),
                            "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.LargeListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # a shard a task, as far as there are so many
    shards = files.manifest.select("path", "before").repartition(min(10_000, max(1, files.manifest.count())))
    return shards.mapInArrow(read, schema)
