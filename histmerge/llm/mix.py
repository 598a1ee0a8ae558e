"""Mixing sources to target weights by hash thresholds.

Every document gets a 48-bit hash of its id. For each source the words are
summed by hash bucket; the bucket in which the source's budget runs out is the
only one looked at again, in finer buckets, until one hash value is left. Then
a document is taken if its hash is below its source's threshold: a filter, no
sort, no rank. Budgets for first and second takings are nested: what is taken
twice is a subset of what is taken once.

Defined results: a null text has no words and is taken with 0 words; a null
source is a source of its own, last in order; repeated rows share one hash and
are taken alike; a source without words has target 0. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmerge.llm.batches import with_columns
from histmerge.workspace import Workspace

#: Bits of a document's hash, and bits looked at in one step.
HASH_BITS, STEP_BITS = 48, 12
WEIGHTS = (3, 1, 2)
SHARE, MOST_TAKINGS = 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """48 bits of the id's MD5; the same in any engine."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_TAKINGS,
) -> DataFrame:
    """Target words of each source ``s`` from its size.

    A target that would exceed ``most`` times its source stops there, and what
    is left over is shared again by weight. The sources that stop are the first
    ones by size per weight, so one ordered pass finds the end of the resharing.
    """
    by_source = sized.groupBy("s").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    filled = (
        by_source.select("s", "source_size", weight.cast("long").alias("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weight_sum", F.sum("weight").over(Window.partitionBy()))
    )
    fullest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("s").asc_nulls_last())
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.col("total") - F.lit(float(most)) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    left_weight = F.col("weight_sum") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = filled.select("*", (left / left_weight).alias("level")).select(
        "*", (F.col("weight") * F.col("level") >= most * F.col("source_size")).alias("stops")
    )
    # The level of the first source that does not stop holds for all after it.
    whole = fullest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(whole)
    return level.withColumn("final", final).select(
        "s", "source_size",
        F.when(F.col("stops"), F.col("source_size").cast("double") * most)
        .otherwise(F.col("weight") * F.col("final")).alias("target"),
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``s, taking, threshold``: documents with a smaller hash fit the budget.

    ``budgets`` has ``s, taking, budget, source_size``. The last hash value is
    included if that brings the sum nearer to the budget.
    """
    key = ["s", "taking", "budget"]
    state = budgets.where("budget < source_size").select(
        *key, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("words_below")
    )
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        fine = F.shiftright("h", shift)
        below = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        histogram = (
            sized.join(state, "s")
            .where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
            .groupBy(*key, "words_below", fine.alias("bucket"))
            .agg(F.sum("size").alias("words"))
            .withColumn("words_below", F.col("words_below") + F.coalesce(F.sum("words").over(below), F.lit(0)))
        )
        state = (
            histogram.where(F.col("words_below") + F.col("words") > F.col("budget"))
            .groupBy(*key)
            .agg(F.min(F.struct("bucket", "words_below", "words")).alias("m"))
            .select(*key, F.col("m.bucket").alias("prefix"), F.col("m.words_below").alias("words_below"),
                    F.col("m.words").alias("words"))
        )
        if shift:
            state = state.drop("words")
    nearer = (F.col("budget") - F.col("words_below")) * 2 >= F.col("words")
    return state.select(
        "s", "taking", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold")
    )


def source_key(source: Column) -> Column:
    """One key that is never null, in the order of the sources, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, s, size, h`` of every document."""
    plain = with_columns(docs, {"doc_id": "long", "source": "string", "text": "string"})
    return plain.select(
        "doc_id", source_key(F.col("source")).alias("s"),
        word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("h"),
    )


def mix_plan(
    sized: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_TAKINGS,
) -> DataFrame:
    """``s, source_size, target, limits``: a threshold for each taking."""
    targets = work.keep(source_targets(sized.select("s", "size"), weights, share, most), "targets")
    budget = lambda k: F.greatest(F.lit(0.0), F.col("target") - (k - 1) * F.col("source_size"))
    budgets = reduce(
        DataFrame.unionAll,
        [
            targets.select("s", F.lit(k).alias("taking"), "source_size", budget(k).alias("budget"))
            for k in range(1, most + 1)
        ],
    )
    everything = F.when(F.col("budget") >= F.col("source_size"), F.lit(1 << HASH_BITS))
    limits = (
        budgets.join(thresholds(sized, budgets), ["s", "taking"], "left")
        .withColumn("threshold", F.coalesce("threshold", everything, F.lit(0)))
        .groupBy("s")
        .agg(F.array_agg("threshold").alias("limits"))
    )
    return work.keep(targets.join(limits, "s"), "plan")


def mix_sources(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, takings`` of every document.

    ``takings`` is how often the mix takes the whole document, ``taken`` the
    words that makes. ``options`` are those of ``mix_plan``.
    """
    sized = work.keep(sizes(docs), "sized")
    takings = F.size(F.filter("limits", lambda t: F.col("h") < t)).cast("long")
    return sized.join(mix_plan(sized, work, **options), "s").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * takings).alias("taken"), takings.alias("takings"),
    )


def apply_mix(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, in the same columns."""
    plan = mix_plan(work.keep(sizes(docs), "sized"), work, **options)
    # The rows travel as one column, so that no name of theirs clashes.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        source_key(F.col("source")).alias("s"), document_hash(F.col("doc_id")).alias("h"),
    )
    times = F.size(F.filter("limits", lambda t: F.col("h") < t))
    return (
        rows.join(plan.select("s", "limits"), "s")
        .where(times > 0)
        .select("row", F.explode(F.sequence(F.lit(1), times)))
        .select("row.*")
    )
