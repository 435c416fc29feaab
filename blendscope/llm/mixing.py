"""Mixing sources to target weights by Pfair scheduling. Only DataFrame functions.

A source's documents, in the order of a digest, form one stream of characters, cut into blocks of equal length. With the
share ``a`` of ``period`` slots, block ``i`` of a source may not be placed before slot floor(i * period / a), its release,
and must be placed before ceil((i + 1) * period / a), its deadline. The earliest deadline first, among the released, takes each
slot; so at any slot every source has had its target number of blocks, less or more than one block. The schedule repeats
after ``period`` slots and is worked out once for one period: its size is that of the shares, whatever the input.

Shares are the weights themselves where these are whole numbers with a sum of at most ``MOST_SLOTS``, the period. Other weights are
rounded to a period in which the smallest has ``FINE`` slots, at most ``MOST_SLOTS`` in all; a source below the 1 / MOST_SLOTS part
then has one slot, and the deviation against the unrounded weight grows by at most half a block a period. Sources of equal share are one
class, whose turns go round its sources in order, as their windows are the same; the step for a slot looks at each class once. Above
``MOST_CLASSES`` different shares, these are rounded to steps of about one percent.

A document belongs to the block it begins in; one longer than a block leaves the slots of the blocks it covers empty.
When a source runs out, its slots stay empty and the others keep their proportions. No document is dropped or repeated.

Within a source, places are prefix sums in two levels: by bucket of the digest, then inside a bucket; so a source that
holds most rows is spread over all buckets.

Defined cases: null or empty text has length 0; null source is a source of its own; sources without a given weight share
evenly the mean weight of the given ones; a null doc_id is like an empty one; equal rows have places in any order; an
empty table gives no rows; other columns come back inside ``doc`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

BLOCK = 65_536  # characters
MOST_SLOTS, LEAST_SLOTS = 100_000, 2_000  # of a period, where weights are rounded
FINE = 16  # slots of the smallest weight, where that gives no longer period
MOST_CLASSES = 256  # different shares
STEPS = 64  # steps a doubling is cut into beyond that
CHUNK = 512  # slots appended at once
EXPONENT = 0.5  # target weight of a source of n characters, where none is given: n ** EXPONENT
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 256, 65_536
BROADCAST_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shares(sizes: DataFrame, weights: DataFrame | None, exponent: float, most: int = MOST_SLOTS) -> DataFrame:
    """(key, share) from (key, total) and, if given, (source, weight). One row per source."""
    if weights is None:
        rated = sizes.select("key", F.pow(F.greatest(F.col("total"), F.lit(1)).cast("double"), F.lit(exponent)).alias("w"))
    else:
        given = weights.groupBy(source_key(F.col("source")).alias("key")).agg(F.max(F.col("weight").cast("double")).alias("w"))
        rated = sizes.select("key").join(given, "key", "left")
        rated = rated.withColumn("w", F.coalesce("w", F.avg("w").over(W.partitionBy()), F.lit(1.0)))
    w, every = F.col("w"), W.partitionBy()
    plain = F.min(((w == F.round(w)) & (w >= 1)).cast("int")).over(every) * (F.sum("w").over(every) <= most).cast("int")
    wanted = F.ceil(FINE * F.sum("w").over(every) / F.min("w").over(every))
    period = F.least(F.greatest(wanted, F.lit(LEAST_SLOTS)), F.lit(most))
    part = F.greatest(F.round(period * w / F.sum("w").over(every)), F.lit(1.0))
    rated = rated.select("key", F.when(plain == 1, w).otherwise(part).cast("bigint").alias("share"))
    classes = F.size(F.collect_set("share").over(every))
    coarse = F.round(F.pow(F.lit(2.0), F.round(F.log2("share") * STEPS) / STEPS)).cast("bigint")
    return rated.select("key", F.when(classes > MOST_CLASSES, coarse).otherwise(F.col("share")).alias("share"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def schedule(shared: DataFrame) -> DataFrame:
    """(key, share, period, slots): the slot of each of a source's blocks within a period."""
    classes = shared.groupBy("share").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ordered = classes.agg(F.array_sort(F.collect_list(F.struct("share", F.size("keys").cast("bigint").alias("m")))).alias("s"),
                          F.sum(F.col("share") * F.size("keys")).alias("period")).where("period is not null")
    period, none = F.col("period"), F.struct(F.lit(None).cast("bigint").alias("deadline"), F.lit(None).cast("int").alias("s"))

    def step(state: Column, slot: Column) -> Column:
        def offer(c: Column, s: Column) -> Column:
            # Turn k of a class is block k div m of its source k mod m.
            block = F.floor(F.get(state["done"], s) / c["m"])
            ready = (block < c["share"]) & (F.floor(block * period / c["share"]) <= slot)
            return F.when(ready, F.struct(F.ceil((block + 1) * period / c["share"]).alias("deadline"), s.alias("s"))).otherwise(none)

        chosen = F.array_min(F.filter(F.transform("s", offer), lambda o: o["s"].isNotNull()))["s"]
        return bound(chosen, lambda pick: F.struct(
            F.transform(state["done"], lambda n, s: n + F.when(s == pick, 1).otherwise(0)).alias("done"),
            F.concat(state["slots"], F.array(pick)).alias("slots")))

    def chunk(state: Column, first: Column) -> Column:
        start = F.struct(state["done"].alias("done"), F.array().cast("array<int>").alias("slots"))
        last = F.least(first + (CHUNK - 1), period - 1)
        after = F.aggregate(F.sequence(first, last), start, step)
        return bound(after, lambda x: F.struct(x["done"].alias("done"), F.concat(state["parts"], F.array(x["slots"])).alias("parts")))

    zero = F.lit(0).cast("bigint")
    first = F.struct(F.transform("s", lambda c: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<array<int>>").alias("parts"))
    parts = F.aggregate(F.sequence(zero, period - 1, F.lit(CHUNK).cast("bigint")), first, chunk, lambda state: state["parts"])
    # Written here: one task works the slots out, the others read them.
    slots = materialize(ordered.select("s", "period", F.flatten(parts).alias("slots")), "mix-slots")
    turns = slots.select("s", "period", F.posexplode("slots").alias("slot", "n"))
    turns = turns.select("period", "slot", F.get(F.col("s"), F.col("n"))["share"].alias("share"))
    turns = turns.withColumn("turn", F.row_number().over(W.partitionBy("share").orderBy("slot")) - 1).join(classes, "share")
    placed = turns.select("period", "share", "slot", F.get(F.col("keys"), (F.col("turn") % F.size("keys")).cast("int")).alias("key"))
    return placed.groupBy("key", "share", "period").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def mix(docs: DataFrame, size: Column, weights: DataFrame | None = None, exponent: float = EXPONENT, block: int = BLOCK,
        most: int = MOST_SLOTS) -> DataFrame:
    """Each row as ``doc`` with source, start (characters of its source before it), block, release, deadline, slot.

    Rows ordered by (slot, start) are the mixture.
    """
    sized = docs.select(F.struct("*").alias("doc"), F.col("source"), source_key(F.col("source")).alias("key"), "doc_id",
                        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    sized = sized.withColumn("digest", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                                                      F.col("size").cast("string")).cast("binary")))
    buckets = LEAST_BUCKETS
    rows = docs.count()
    while buckets * BUCKET_ROWS < rows and buckets < MOST_BUCKETS:
        buckets *= 2
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") / (65_536 // buckets)))

    totals = materialize(sized.groupBy("key", "bucket").agg(F.sum("size").alias("total")), "mix-totals")
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("key", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    plan = materialize(schedule(shares(totals.groupBy("key").agg(F.sum("total").alias("total")), weights, exponent, most)),
                       "mix-plan")

    inside = W.partitionBy("key", "bucket").orderBy("digest", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["key", "bucket"])
    out = out.withColumn("start", F.col("base") + F.col("inner"))
    out = out.withColumn("block", F.floor(F.col("start") / block))
    out = out.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "key")
    turn, j = F.floor(F.col("block") / F.col("share")) * F.col("period"), F.col("block") % F.col("share")
    out = out.withColumns({
        "release": turn + F.floor(j * F.col("period") / F.col("share")),
        "deadline": turn + F.ceil((j + 1) * F.col("period") / F.col("share")),
        "slot": turn + F.get(F.col("slots"), j.cast("int"))})
    return out.select("doc", "source", "start", "block", "release", "deadline", "slot")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents in the order of the mixture, unchanged otherwise; written files keep that order."""
    placed = mix(docs, F.length(F.coalesce(F.col("text"), F.lit(""))), **settings)
    return placed.orderBy("slot", "start", "doc.doc_id").select("doc.*")
