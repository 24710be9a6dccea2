"""Mixing sources to target weights by Sainte-Lague apportionment.

The words a mix shall take are cut into equal blocks of ``block_words`` words.  Blocks are
seats: sources get them by highest quotients target / (2 k + 1), then the shards of each
source get the source's seats in the same way by their sizes.  Within a shard documents lie
in a seeded order on a ring of words, which is cut into blocks too.  A seeded permutation
ranks the blocks; the shard takes its quota in this order, going round as often as the quota
asks, and cuts the last block where its words are used up.  Every block has its place in the
permutation by a formula (rank = number * prime + shift, modulo the blocks), so no block needs
a row of its own.  For mixes of whole documents the blocks taken are consecutive ones
instead, from a seeded one on.

Only DataFrame functions are used.  A source has as many shards as its share of words or rows
(the greater one) of about sqrt(rows) shards in all, so neither sorting a shard nor ranking a
source's shards grows large, and small sources are one ring.  All tables that are joined are
aggregates per shard.  Seeds act through md5, which any engine can tell.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a
null weight cycle is not allowed; documents of size 0 take 0 words; an empty table gives an
empty mix; repeated rows are documents of their own and share the words of the ring in
hash order; other columns of the input are neither read nor returned, so names can't clash.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, row_hash

WORD = r"[^\x20\x09-\x0D]+"
# Primes above 2**31, and so above the number of blocks of any shard.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


def word_count(text: Column) -> Column:
    """Number of WORD matches; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, order: list[str], group: list[str]) -> DataFrame:
    """Sainte-Lague seats of each party as column ``quota``.

    parties: one row each; ``seats`` holds the seats of the row's group.  Ties go to the
    first party by ``order``.  The final divisor d fulfils |sum(votes) / d - seats| <=
    parties / 2, so all but about two quotients a party are decided without ranking them.
    """
    whole = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    votes_, seats_ = F.col(votes), F.col(seats)
    share = F.when(F.col("_all") > 0, votes_ / F.col("_all")).otherwise(0.0)
    sure = F.greatest(F.lit(0), F.floor(share * (seats_ - F.col("_n") / 2) + 0.5).cast("long") - 1)
    most = F.floor(share * (seats_ + F.col("_n") / 2) + 0.5).cast("long") + 1
    base = (
        parties.withColumn("_all", F.sum(votes_).over(whole))
        .withColumn("_n", F.sum(F.when(votes_ > 0, 1).otherwise(0)).over(whole))
        .withColumn("_sure", F.when(votes_ > 0, sure).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", seats_ - F.sum("_sure").over(whole))
    )
    tried = base.withColumn("_k", F.explode_outer(F.when(votes_ > 0, F.sequence(F.col("_sure"), most))))
    by_quotient = whole.orderBy(F.desc_nulls_last(votes_ / (2 * F.col("_k") + 1)), *[F.asc_nulls_last(c) for c in order])
    won = (F.row_number().over(by_quotient) <= F.col("_left")) & F.col("_k").isNotNull()
    return (
        tried.withColumn("_won", won.cast("long"))
        .groupBy(*parties.columns)
        .agg((F.first("_sure") + F.sum("_won")).alias("quota"))
    )


def targets(sources: DataFrame, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """Add weight and target: shares of all words by weight, at most cap times the source's size.

    What a capped source can't take is shared among the others by weight until none is above
    its cap.  In order of cap / weight the capped sources are a prefix; the level that
    capping a longer prefix leaves to the rest rises up to the right prefix and falls after
    it, so the highest one is final.  Rows: one per source.
    """
    named = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    rising = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.asc_nulls_last("source"))
    whole = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(named) - 1) % len(cycle) + 1
    weighed = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), place.cast("int")))
        .withColumn("_cap", cap * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        weighed.withColumn("_level", level)
        .withColumn("_final", F.max("_level").over(whole))
        .withColumn("target", F.when(F.col("_ratio") <= F.col("_final"), F.col("_cap")).otherwise(F.col("weight") * F.coalesce("_final", F.lit(0.0))))
        .select("source", "source_size", "weight", "target")
    )


def seeded(seed: int, *columns: Column) -> Column:
    """A number below 2**60 from a seed and columns; nulls count as empty strings."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _between(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def mix(
    docs: DataFrame,
    cycle: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 42,
    block_words: int = 16,
    shards: int | None = None,
    consecutive: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, shard, taken and the columns of docs named in keep.

    docs: doc_id, text, source.  taken counts the words of the document in the mix, repeats
    included; no document exceeds cap times its size.  shards: about how many in all.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(seed, F.col("doc_id"), F.col("text")).alias("_key"), *keep)
    sized = materialize(sized, "mix-sizes")
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = shards or max(1, ceil(sqrt(rows)))
    sized = sized.withColumn("_piece", F.pmod(F.col("_key"), F.lit(pieces)))
    # the pieces of a source are put together to shards of about the mean size
    counted = sized.groupBy("source", "_piece").agg(F.count("*").alias("_rows"), F.sum("size").alias("_words"))
    of_source = Window.partitionBy("source")
    by_rows, by_words = (F.ceil(F.sum(c).over(of_source) * pieces / F.lit(max(1, n))) for c, n in (("_rows", rows), ("_words", words)))
    own = F.least(F.lit(pieces), F.greatest(by_rows, by_words))
    placed = counted.select(F.col("source").alias("_of"), F.col("_piece").alias("_part"), F.floor(F.col("_piece") * own / pieces).cast("long").alias("shard"))
    sized = sized.join(placed, sized["source"].eqNullSafe(placed["_of"]) & (sized["_piece"] == placed["_part"])).drop("_of", "_part", "_piece")

    shard_sizes = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = targets(shard_sizes.groupBy("source").agg(F.sum("shard_size").alias("source_size")), cycle, cap)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    seated = apportion(sources.withColumn("_seats", blocks), "target", "_seats", ["source"], [])
    seated = seated.select(F.col("source").alias("_source"), "source_size", "weight", "target", F.col("quota").alias("source_quota"))
    by_shard = shard_sizes.join(seated, shard_sizes["source"].eqNullSafe(seated["_source"])).drop("_source")
    quotas = apportion(by_shard, "shard_size", "source_quota", ["shard"], ["source"])
    start = seeded(seed, F.col("source"), F.col("shard"))
    quotas = quotas.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "source_size",
        "weight",
        "target",
        "shard_size",
        F.least(F.col("quota") * block_words, F.col("shard_size") * cap).alias("_words"),
        F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).alias("_blocks"),
        start.alias("_seed"),
        F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(start, F.lit(len(PRIMES))) + 1).cast("int")).alias("_prime"),
    )

    ring = Window.partitionBy("source", "shard").orderBy("_key", F.asc_nulls_last("doc_id"), "size")
    laid = sized.withColumn("_at", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = laid.join(quotas, laid["source"].eqNullSafe(quotas["_source"]) & (laid["shard"] == quotas["_shard"]))
    at, end, total, n = F.col("_at"), F.col("_at") + F.col("size"), F.col("shard_size"), F.col("_blocks")
    full = F.floor(F.try_divide(F.col("_words"), total))
    rest = F.col("_words") - full * total
    if consecutive:
        first = F.pmod(F.col("_seed"), n) * block_words
        # [first, first + rest) on the ring, which may pass its end once
        partly = (_between(first + rest, at, end) - _between(first, at, end)) + (_between(first + rest - total, at, end) - at)
    else:
        rank = lambda j: F.pmod(j * F.col("_prime") + F.col("_seed") % n, n)
        missing = n * block_words - total  # of the last block, which may be short

        def taken_of(j: Column) -> Column:
            """Words of the document that block j, as far as it is taken, covers."""
            before = rank(j) * block_words - F.when(rank(j) > rank(n - 1), missing).otherwise(F.lit(0))
            length = F.least(F.lit(block_words).cast("long"), total - j * block_words)
            stop = j * block_words + _between(rest - before, F.lit(0), length)
            return _between(stop, at, end) - _between(j * block_words, at, end)

        covered = F.sequence(F.floor(at / block_words), F.floor((end - 1) / block_words))
        partly = F.aggregate(covered, F.lit(0).cast("long"), lambda found, j: found + taken_of(j))
    taken = F.when(F.col("size") > 0, F.col("size") * full + partly).otherwise(F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "weight", "target", "shard", taken.cast("long").alias("taken"), *keep)


def repeat_to_mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns.

    A shard takes consecutive blocks, so its quota cuts two documents at most.  Their parts are
    rounded to whole copies one after the other, and what rounding gives or takes is carried
    over to the source's next cut document, so the copies of a source add up to its words
    within half of its longest document.  Rows are told apart by two hashes of all columns;
    rows equal in all of them are one with more copies.
    """
    hashes = [row_hash(docs, seed + i) for i in range(2)]
    key = "_row_" + "_".join(sorted(docs.columns))[:64]  # no column of docs
    docs = docs.withColumn(key, F.struct(hashes[0].alias("a"), hashes[1].alias("b")))
    mixed = mix(docs, seed=seed, consecutive=True, keep=(key,), **options)
    taken = materialize(mixed.where("size > 0 and taken > 0").select("source", "shard", F.col(key).alias("row_key"), "size", "taken"), "mix-taken")
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    cuts = taken.withColumn("part", F.col("taken") % F.col("size")).where("part > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "row_key", "size", "part"))).alias("cuts"))
    up = lambda state, cut: 2 * (state["carry"] + cut["part"]) >= cut["size"]
    rounded = F.aggregate(
        "cuts",
        F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("more")),
        lambda state, cut: F.struct(
            (state["carry"] + cut["part"] - F.when(up(state, cut), cut["size"]).otherwise(F.lit(0))).alias("carry"),
            F.when(up(state, cut), F.array_append(state["more"], cut["row_key"])).otherwise(state["more"]).alias("more"),
        ),
    )
    more = cuts.select(F.explode(rounded["more"]).alias("row_key"), F.lit(1).cast("long").alias("n"))
    copies = taken.select("row_key", whole.alias("n")).union(more)
    wanted = copies.groupBy("row_key").agg(F.sum("n").cast("int").alias("_copies")).where("_copies > 0")
    # the join deals the rows by their hashes, so equal ones meet without a further shuffle
    parts = [f"{key}_{i}" for i in range(2)]
    named = docs.withColumns(dict(zip(parts, hashes, strict=True))).drop(key)
    joined = named.join(wanted.select(F.col("row_key.a").alias(parts[0]), F.col("row_key.b").alias(parts[1]), "_copies"), parts).dropDuplicates(parts)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[c for c in docs.columns if c != key])
