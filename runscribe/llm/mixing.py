"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash.  A source takes, in hash order, whole documents while its running
total stays within its budget, and of the first that doesn't fit as many words as are left.  The order is
never built: one histogram of sizes per (source, high bits of the hash) finds the bucket in which the budget
ends, and only that boundary bucket is split again by the next bits, until it is one hash value.  The mix is
then a filter ``hash <= threshold``, and ``hash = edge`` for the boundary document.  A source whose target
exceeds its size takes all of itself once and a second, nested budget for the rest.

The histograms are map-side combined sums, so a source with a third of all rows costs each task at most
one partial row per bucket, and no row is ever sorted or gathered by source.  The first histogram is summed
before it meets the budgets; later ones meet them by (source, bucket), which deals a large source over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import WORD_PATTERN
from .workspace import set_aside, stage

HASH_BITS = 60
LEVEL_BITS = 12


def document_hash(*keys: Column) -> Column:
    """The first 60 bits of the md5 of the keys' text; nulls count as empty."""
    text = F.concat_ws("\x1f", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, size) -> with a weight from ``cycle`` by the source's rank in code-point order, null last.

    The rank is a rank within a range partition plus the sizes of the ranges before it, so no task
    gets all sources.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        sources.repartitionByRange(parts, F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
        .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))),
        "mix-ranges",
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a range partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    cycle_of = F.array(*[F.lit(float(w)) for w in cycle])
    return ranged.join(before, "part").select(
        "source", "size", F.element_at(cycle_of, ((F.col("rank") - 1 + F.col("before")) % len(cycle) + 1).cast("int")).alias("weight")
    )


def capped_targets(weighted: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """(source, size, weight) -> with a target: shares by weight, none above ``max_epochs`` times its size.

    What a capped source can't take is shared again by weight until none is above.  Each round is one
    sum over the sources; rounds end when no further source is capped.
    """
    cap = F.col("size") * max_epochs
    level, capped = None, F.lit(False)
    while True:
        row = weighted.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["open"] == 0 or (level is not None and row["n"] == seen):
            break
        level, seen = (budget - row["full"]) / row["open"], row["n"]
        capped = F.col("weight") * F.lit(level) > cap
    share = cap if level is None or row["open"] == 0 else F.when(capped, cap).otherwise(F.col("weight") * F.lit(level))
    return weighted.withColumn("target", share.cast("double"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, h) and (source, budget) -> (source, threshold, edge, part).

    ``threshold`` ends the largest prefix in hash order within the budget, -1 where not even the first hash fits.
    ``edge`` is the next hash, of which each row takes ``part`` words; null where everything fits.
    """
    state = budgets.select("source", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    done = []
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket, size = F.shiftright("h", low).alias("bucket"), [F.sum("size").alias("size"), F.count("*").alias("n")]
        if low == HASH_BITS - LEVEL_BITS:
            histogram = rows.groupBy("source", bucket).agg(*size).join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        else:
            inside = rows.withColumn("above", F.shiftright("h", low + LEVEL_BITS)).join(
                state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("above") == F.col("prefix"))
            )
            histogram = inside.groupBy("source", bucket).agg(*size, F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("bucket")  # at most 2**LEVEL_BITS buckets a source
        running = histogram.withColumn("upto", F.sum("size").over(order))
        fits = F.col("upto") <= F.col("rest")
        level = stage(
            running.groupBy("source").agg(
                F.max(F.when(fits, F.col("bucket"))).alias("last"),
                F.max(F.when(fits, F.col("upto"))).alias("taken"),
                F.min(F.when(~fits, F.struct("bucket", "n"))).alias("over"),
                F.first("rest").alias("rest"),
            ),
            "mix-level",
        )
        left = F.col("rest") - F.coalesce("taken", F.lit(0))
        edge = F.when(F.lit(low == 0), F.col("over.bucket"))
        done.append(level.select("source", ((F.col("last") + 1) * (1 << low) - 1).alias("threshold"), edge.alias("edge"), F.when(edge.isNotNull(), F.floor(left / F.col("over.n"))).alias("part")))
        state = level.where("over IS NOT NULL").select("source", left.alias("rest"), F.col("over.bucket").alias("prefix"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy("source").agg(F.coalesce(F.max("threshold"), F.lit(-1)).alias("threshold"), F.max("edge").alias("edge"), F.coalesce(F.max("part"), F.lit(0)).alias("part"))


def sized(docs: DataFrame) -> dict[str, Column]:
    """size (words) and h (60 bits of hash of doc_id and text) of each document."""
    return {"size": word_count(F.col("text")), "h": document_hash(F.col("doc_id"), F.md5(F.col("text")))}


def source_plan(rows: DataFrame, budget_share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, size, h) -> s, source_size, target, whole, threshold, edge, part: one row a source."""
    sources = stage(rows.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    targets = stage(capped_targets(stage(cyclic_weights(sources, cycle), "mix-weights"), total * budget_share, float(max_epochs)), "mix-targets")
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs))).otherwise(0)
    budgets = targets.select("source", "size", "target", whole.cast("int").alias("whole"), (F.col("target") - whole * F.col("size")).alias("budget"))
    thresholds = hash_thresholds(rows, budgets).withColumnRenamed("source", "s")
    named = F.coalesce("threshold", F.lit(-1)).alias("threshold"), "edge", F.coalesce("part", F.lit(0)).alias("part")
    plan = budgets.join(thresholds, F.col("source").eqNullSafe(F.col("s")), "left")
    return stage(plan.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "whole", *named), "mix-plan")


def decisions(docs: DataFrame, budget_share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """doc_id, source, size (words), h, source_size, target and taken of each document; see :func:`mix`."""
    rows = stage(docs.select("doc_id", "source", *[c.alias(n) for n, c in sized(docs).items()]), "mix-sizes")
    plan = source_plan(rows, budget_share, max_epochs, cycle)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.least(F.col("whole") + (F.col("h") <= F.col("threshold")).cast("int"), F.lit(max_epochs))
    part = F.when(F.col("h") == F.col("edge"), F.col("part")).otherwise(0)
    return joined.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("size") * epochs + part).alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """How many words the mix takes of each document.

    ``docs``: doc_id, text, source.  Returns doc_id, size (words), source_size, target and taken.
    ``taken`` is size by whole epochs, and for the document at which a source's budget ends the words that are
    left, so no document exceeds ``max_epochs`` times its size, and a source's taken words miss its target by
    less than one word for each row of the boundary hash.

    Null text has size 0; null sources are one source, last in order; rows with equal doc_id and equal text
    have one hash and are taken together; a table without words takes nothing; extra columns are ignored.
    """
    return decisions(docs, **settings).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, budget_share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The documents that the mix takes, with all their columns, each row as often as it is taken.

    Texts stay whole, so the document at which a source's budget ends is taken once more if at least half of it
    is left to take.  Sizes and hashes are computed in the scan and meet one row a source: texts are not
    shuffled by the decision.  A document without words takes nothing from a budget and stays once.
    """
    rows = stage(docs.select("doc_id", "source", *[c.alias(n) for n, c in sized(docs).items()]).select("source", "size", "h"), "mix-sizes")
    plan = source_plan(rows, budget_share, max_epochs, cycle)
    named, back = set_aside(docs, source="source", **sized(docs))
    taken = named.join(plan, F.col("source").eqNullSafe(F.col("s")))
    more = (F.col("h") <= F.col("threshold")) | ((F.col("h") == F.col("edge")) & (2 * F.col("part") >= F.col("size")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.least(F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(max_epochs)))
    again = taken.withColumn("times", times.cast("int")).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*back)
