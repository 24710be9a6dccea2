"""Token counts kept as additive totals, maintained by signed deltas.

Totals by source, language and tokenizer version are a small table.  A batch of changes -
inserts, deletes and revised counts - is summed to signed deltas (partial sums first, so a
source that holds a third of the rows is no hot task) and added to the last version.  A
version holds the totals and the id of the batch that made it, written by one Spark job, and
counts only once that job has marked it finished: a batch is either in it whole or not at
all.  A file named after a batch id tells in which version it went, before that version is
written; the batch is committed if that version is finished and names it.  So committing a
batch id again changes nothing, and a commit reads and writes no more than the totals,
however many batches there have been.  One writer at a time.

Edge cases: null source, lang or version are groups of their own; null counts are 0; an
unknown kind of change is an error; groups whose documents and tokens are both 0 are not
reported; an empty batch is recorded as committed; null and empty texts have no tokens;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "batch_id string, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, tokenizers: dict[str, tuple[str, str | None]], keep: tuple[str, ...] = ("source", "lang"), slice_bytes: int = 16 << 20) -> DataFrame:
    """Columns ``keep`` of docs, and one column a tokenizer version with the tokens of the text.

    tokenizers: by version the path of a tokenizer's JSON file, or that of a file of ranks with
    the pattern that goes with it.  The files are read on the driver; tasks get their contents.
    """
    definitions = []
    for path, pattern in tokenizers.values():
        with open(path, encoding="utf-8") as f:
            definitions.append((f.read(), pattern))
    names = [*keep, *tokenizers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import Units, encoder
        from .tokenfiles import slices

        encoders = [encoder(*d) for d in definitions]
        special = [s for e in encoders for s in e.special]
        for batch in batches:
            texts, counts = batch.column(len(keep)), [[np.zeros(0, np.int64)] for _ in encoders]
            for first, stop in slices(texts, slice_bytes):
                units = Units(texts.slice(first, stop - first), special)
                for found, e in zip(counts, encoders, strict=True):
                    found.append(e.count(units))
            columns = [*(batch.column(i) for i in range(len(keep))), *(pa.array(np.concatenate(c)) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{v}` long" for v in tokenizers)])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Deltas (KEYS, n_docs, n_tokens) of changes (KEYS, change, n_tokens, old_tokens).

    change: insert (n_tokens), delete (n_tokens, as they were counted) or revise (old_tokens to n_tokens).
    """
    now, old = (F.coalesce(c, F.lit(0)) for c in ("n_tokens", "old_tokens"))
    docs = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).when(F.col("change") == "revise", 0)
    docs = docs.otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null")))))
    tokens = F.when(F.col("change") == "insert", now).when(F.col("change") == "delete", -now).otherwise(now - old)
    summed = changes.select(*KEYS, docs.cast("long").alias("d"), tokens.cast("long").alias("t")).groupBy(*KEYS)
    return summed.agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


class Rollup:
    """Totals in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _finished(self, version: int) -> bool:
        return self._files.exists(self._path(f"v{version:08d}/_SUCCESS"))

    def version(self) -> int:
        """Number of the last finished version; 0 if there is none."""
        found = [int(s.getPath().getName()[1:]) for s in self._files.listStatus(self._path("")) if s.getPath().getName().startswith("v")]
        return next((n for n in sorted(found, reverse=True) if self._finished(n)), 0)

    def _table(self, version: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.folder}/v{version:08d}") if version else self.spark.createDataFrame([], _SCHEMA)

    def _note(self, batch_id: str):
        return self._path(f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}")

    def committed(self, batch_id: str) -> bool:
        note = self._note(batch_id)
        if not self._files.exists(note):
            return False
        stream = self._files.open(note)
        version = stream.readLong()
        stream.close()
        return self._finished(version) and not self._table(version).where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already."""
        if self.committed(batch_id):
            return False
        last = self.version()
        totals = self._table(last).where("batch_id is null").select(*KEYS, "n_docs", "n_tokens").union(signed(changes)).groupBy(*KEYS)
        totals = totals.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        made_by = self.spark.createDataFrame([(batch_id, None, None, None, None, None)], _SCHEMA)
        whole = totals.select(F.lit(None).cast("string").alias("batch_id"), *KEYS, "n_docs", "n_tokens").union(made_by.coalesce(1))
        stream = self._files.create(self._note(batch_id), True)
        stream.writeLong(last + 1)
        stream.close()
        # an unfinished version of this number is what a failed commit has left
        whole.write.mode("overwrite").parquet(f"{self.folder}/v{last + 1:08d}")
        return True

    def totals(self) -> DataFrame:
        return self._table(self.version()).where("batch_id is null and (n_docs != 0 or n_tokens != 0)").select(*KEYS, "n_docs", "n_tokens")
