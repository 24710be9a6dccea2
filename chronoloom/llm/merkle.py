"""Merkle manifest of a data set: a tree of digests per language, and one over their roots.

Every row is a leaf, the SHA-256 of its columns ``FIELDS``, each written as its UTF-8 byte count,
a colon and the value, or ``-`` for null.  In a tree, runs of ``fanout`` consecutive nodes become
the SHA-256 of their hex digests, until one is left.

Building is driven by events.  A digest that arrives is put into its slot of the partial parent;
how many children a parent has follows from the number of leaves, so a parent knows by itself when
it is whole.  It is then emitted and is itself an event for its own parent.  Leaves lie in tasks in
the order of their trees, so a task resolves all but the frontier at its two ends.  What is
unresolved is shuffled by the ancestor ``STEP`` levels up, and so on until the roots are there: the
rows of a later round are as many as tasks times levels.

Each resolved parent leaves a reverse link for each child: the digests of its siblings.  Proofs are
made from these downwards, in blocks of ``fanout ** HEIGHT`` leaves: a block gets the path above it
as one row, so no task holds more than a block.

Edge cases: null languages form a tree, the first one; null doc_ids come first in their tree;
repeated doc_ids are ordered by their digests, equal rows are leaves each; null and empty texts
differ; an empty table has no root and no proofs; further columns count for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: levels that one shuffle of the frontier resolves, and levels of a block of proofs
STEP, HEIGHT = 20, 12
#: state of a row: a leaf or parent whose own parent is unresolved; one whose parent is known; the root
OPEN, LINKED, ROOT = 0, 1, 2

_NODE = "tree string, size long, level int, index long, digest binary, id long, claim binary"
_NODE_ARROW = [("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("claim", pa.binary())]
_PATH = pa.list_(pa.binary())


def combine(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def level_size(size: int, level: int, fanout: int = FANOUT) -> int:
    """Nodes at a level of a tree of ``size`` leaves."""
    return -(-size // fanout**level)


def depth(size: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves."""
    found = 0
    while size > 1:
        size, found = -(-size // fanout), found + 1
    return found


def leaf(fields: dict[str, Column]) -> Column:
    """The leaf digest (binary) of columns by their names in ``FIELDS``."""
    parts = []
    for name in FIELDS:
        text = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """Rows (tree, id, digest, claim): claim is the leaf that a row would have with other values of some fields."""
    fields = {name: F.col(name) for name in FIELDS}
    claim = leaf(fields | claims) if claims else F.lit(None).cast("binary")
    return docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(fields).alias("digest"), claim.alias("claim"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows of trees with ``size`` and ``index``, their places by ``order``: sorted by ranges of (tree, order), then counted by range."""
    keys = ["tree", *order]
    spread = rows.withColumn("copy", F.monotonically_increasing_id())  # lets equal rows go to several ranges
    spread = spread.repartitionByRange(*keys, "copy").sortWithinPartitions(*keys, "copy").drop("copy")
    spread = materialize(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    ranges = spread.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("tree"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = materialize(ranges.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), "first", F.coalesce(before, F.lit(0)).alias("before"), whole.alias("size")), f"{name}-ranges")
    told = spread.join(ranges, (F.col("part") == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return told.withColumn("index", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "_tree", "_part", "first", "before")


class Climb:
    """Partial parents by their place, and the rows that events have given."""

    def __init__(self, fanout: int):
        self.fanout, self.partial, self.out = fanout, {}, []

    def arrive(self, tree: str | None, size: int, level: int, index: int, digest: bytes, id: int | None, claim: bytes | None) -> None:
        k = self.fanout
        while (here := level_size(size, level, k)) > 1:
            place, slot = (tree, level + 1, index // k), index % k
            slots = self.partial.setdefault(place, {})
            slots[slot] = (size, digest, id, claim)
            if len(slots) < min(k, here - index // k * k):
                return
            del self.partial[place]
            digests = [slots[i][1] for i in range(len(slots))]
            for i, (_, own, own_id, own_claim) in slots.items():
                self.out.append((tree, size, level, index // k * k + i, own, own_id, own_claim, LINKED, b"".join(digests[:i] + digests[i + 1 :])))
            level, index, digest, id, claim = level + 1, index // k, combine(digests), None, None
        self.out.append((tree, size, level, index, digest, id, claim, ROOT, None))

    def frontier(self) -> None:
        for (tree, level, parent), slots in self.partial.items():
            for i, (size, digest, id, claim) in slots.items():
                self.out.append((tree, size, level - 1, parent * self.fanout + i, digest, id, claim, OPEN, None))
        self.partial = {}

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        schema = pa.schema([*_NODE_ARROW, ("state", pa.int32()), ("siblings", pa.binary())])
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _resolved(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        climb = Climb(fanout)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                climb.arrive(*row)
            yield climb.taken()
        climb.frontier()
        yield climb.taken()

    return run


def links(nodes: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """All nodes of the trees over numbered leaves (tree, size, index, digest, id, claim), with the digests of their siblings."""
    columns = [c.split()[0] for c in _NODE.split(", ")]
    top = nodes.agg(F.max("size")).first()[0]
    done, reach, events = [], 0, nodes.withColumn("level", F.lit(0)).select(columns)
    while True:
        found = materialize(events.mapInArrow(_resolved(fanout), f"{_NODE}, state int, siblings binary"), f"{name}-links")
        done.append(found.where(F.col("state") != OPEN))
        if reach >= depth(top or 0, fanout):
            break
        # at the first shuffle tasks have resolved most of what is below STEP levels
        reach += STEP
        up = F.greatest(F.lit(reach) - F.col("level"), F.lit(0))
        ancestor = F.floor(F.col("index") / F.pow(F.lit(float(fanout)), up))
        events = found.where(F.col("state") == OPEN).select(columns).repartition("tree", ancestor)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def fold(digest: bytes, path: list[bytes], index: int, size: int, fanout: int = FANOUT) -> bytes:
    """The root that a digest at ``index`` has with the siblings of ``path``, which are popped from its front."""
    for _ in range(depth(size, fanout)):
        slot, siblings = index % fanout, path.pop(0)
        others = [siblings[i : i + 32] for i in range(0, len(siblings), 32)]
        digest = combine([*others[:slot], digest, *others[slot:]])
        index //= fanout
    return digest


_TAIL = "layer int, path array<binary>, subroot binary, seat long"


def _walk_down(layer: int, fanout: int):
    """Paths of the nodes at the lowest level of a block, of its links and the path above it."""
    low = layer * HEIGHT
    schema = pa.schema([*_NODE_ARROW, ("layer", pa.int32()), ("path", _PATH), ("subroot", pa.binary()), ("seat", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["tree", "size", "level", "index", "digest", "id", "claim", "siblings", "path", "subroot", "seat"]).to_pylist()
        above = next((r for r in rows if r["path"] is not None), None)
        if above is None:  # a block of no tree: none such is made
            return schema.empty_table()
        known = {(r["level"], r["index"]): r for r in rows if r["path"] is None}
        out = []
        for (level, index), r in known.items():
            if level != low:
                continue
            path, end = [], min(low + HEIGHT, depth(r["size"], fanout))
            while level < end:
                path.append(known[level, index]["siblings"])
                level, index = level + 1, index // fanout
            out.append(r | {"layer": layer, "path": path + above["path"], "subroot": above["subroot"], "seat": above["seat"]})
        return pa.Table.from_pylist([{f.name: r[f.name] for f in schema} for r in out], schema=schema)

    return run


def paths(nodes: DataFrame, tails: DataFrame, top: int, name: str, fanout: int = FANOUT) -> DataFrame:
    """Leaves with ``path``, the siblings of each level, and what ``tails`` says above their trees' roots.

    nodes: what :func:`links` gives.  tails: (tree, size, path, subroot, seat).  top: size of the largest tree.
    """
    columns = ["tree", "size", "level", "index", "digest", "id", "claim"]
    layers = max(1, -(-depth(top, fanout) // HEIGHT))
    starts = F.udf(lambda size: max(1, -(-depth(size, fanout) // HEIGHT)), "int")  # one call a tree
    empty = {"level": F.lit(None).cast("int"), "digest": F.lit(None).cast("binary"), "id": F.lit(None).cast("long"), "claim": F.lit(None).cast("binary")}
    first = tails.withColumn("layer", starts("size")).withColumn("index", F.lit(0).cast("long")).withColumns(empty)
    first = materialize(first.select(*columns, "layer", "path", "subroot", "seat"), f"{name}-tails")
    below = None
    for layer in range(layers - 1, -1, -1):
        high = (layer + 1) * HEIGHT
        linked = (F.col("state") == LINKED) & F.col("level").between(layer * HEIGHT, high - 1)
        if not layer:
            linked |= (F.col("state") == ROOT) & (F.col("level") == 0)
        block = F.floor(F.col("index") / F.pow(F.lit(float(fanout)), F.lit(high) - F.col("level")))
        own = nodes.where(linked).select(*columns, "siblings", F.lit(None).cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("long").alias("seat"), block.alias("block"))
        above = first.where(F.col("layer") == layer + 1)
        if below is not None:
            above = above.union(below)
        above = above.select(*columns, F.lit(None).cast("binary").alias("siblings"), "path", "subroot", "seat", F.col("index").alias("block"))
        below = own.union(above).groupBy("tree", "block").applyInArrow(_walk_down(layer, fanout), f"{_NODE}, {_TAIL}")
        if layer:
            below = materialize(below, f"{name}-paths")
    return below


def _verified(root: bytes, seats: int, fanout: int):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id, digest, claim, path, index, size, seat, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                proof = hashlib.sha256("".join(p.hex() for p in path).encode()).hexdigest()
                folded = fold(digest if claim is None else claim, path, index, size, fanout)
                folded = fold(folded, path, seat, seats, fanout)
                out.append((id, digest.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names=names)

    return run


class Manifest:
    """The trees of a data set; ``root`` is None for an empty one."""

    def __init__(self, docs: DataFrame, claims: dict[str, Column] | None = None, fanout: int = FANOUT):
        self.fanout = fanout
        self.nodes = links(numbered(leaves(docs, claims), ["id", "digest"], "leaves"), "trees", fanout)
        roots = self.nodes.where(F.col("state") == ROOT)
        self.subroots = materialize(roots.select("tree", "size", "digest"), "subroots")
        self.seats, self.top = self.subroots.agg(F.count("*"), F.max("size")).first()
        # the upper tree has the lower ones as leaves; their names come back by their places
        named = materialize(numbered(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), ["lang"], "languages"), "seats")
        upper = links(named.select("tree", "size", "index", "digest", F.col("index").alias("id"), F.lit(None).cast("binary").alias("claim")), "upper", fanout)
        self.upper, self.named = upper, named
        found = upper.where(F.col("state") == ROOT).select("digest").first()
        self.root: bytes | None = bytes(found[0]) if found else None

    def proofs(self) -> DataFrame:
        """Leaves (tree, size, index, digest, id, claim) with path, subroot and seat, the place of the tree among the trees."""
        spark = self.nodes.sparkSession
        if self.root is None:
            return spark.createDataFrame([], f"{_NODE}, {_TAIL}")
        nothing = self.named.limit(1).select("tree", "size", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("long").alias("seat"))
        over = paths(self.upper, nothing, self.seats, "upper", self.fanout)
        over = over.select(F.col("index").alias("seat"), "path", F.col("digest").alias("subroot"))
        seats = self.named.select(F.col("index").alias("seat"), "lang").join(over, "seat")
        sizes = self.subroots.select(F.col("tree").alias("lang_"), F.col("size"))
        tails = seats.join(sizes, F.col("lang").eqNullSafe(F.col("lang_"))).select(F.col("lang").alias("tree"), "size", "path", "subroot", "seat")
        return paths(self.nodes, tails, self.top, "trees", self.fanout)

    def verified(self) -> DataFrame:
        """Each leaf's claim, or the leaf itself where there is none, folded with its proof and held against the root."""
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        rows = self.proofs().select("id", "digest", "claim", "path", "index", "size", "seat", "subroot")
        return rows.mapInArrow(_verified(self.root or b"", self.seats, self.fanout), schema)


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    return Manifest(docs, claims, fanout)
