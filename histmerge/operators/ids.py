"""New surrogate ids in source order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histmerge.workspace import Workspace

SLOT = "_slot"
HELD = "_held"
# Documented layout of monotonically_increasing_id: the partition number sits
# above 33 bits that count the rows of the partition.
ROW_BITS = 33


def first_per_key(
    df: DataFrame, keys: list[str], order: str = "id", unless: DataFrame | None = None
) -> DataFrame:
    """The first row of each key by ``order``; none for keys that ``unless`` holds.

    One aggregation reduces every task's rows before the one shuffle, so a key
    with a third of all rows is no heavier than another, on either side. The
    keys to leave out join the same aggregation as rows without a value, which
    spares sorting both sides for an anti join. Fixed-width rows are aggregated
    by hash; rows with text are carried whole through a sort-based aggregation.
    """
    rest = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.withColumn(HELD, F.lit(None).cast("boolean"))
    if unless is not None:
        nothing = [F.lit(None).cast(types[c]).alias(c) for c in rest]
        held = unless.select(*keys, *nothing, F.lit(True).alias(HELD))
        rows = rows.unionByName(held)
    if any(types[c].typeName() in ("string", "binary") for c in rest):
        firsts = [F.min_by(F.struct(*rest), order).alias("_first")]
        shown = {c: F.col(f"_first.{c}") for c in rest}
    else:
        firsts = [F.min(c).alias(c) if c == order else F.min_by(c, order).alias(c) for c in rest]
        shown = {c: F.col(c) for c in rest}
    grouped = rows.groupBy(*keys).agg(*firsts, F.bool_or(HELD).alias(HELD))
    kept = grouped.where(F.col(HELD).isNull())
    return kept.select(*[shown.get(c, F.col(c)).alias(c) for c in df.columns])


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition and sort by ``order``, and note each row's slot.

    Give it a written table: Spark reads the input once more to find the ranges.
    Write the result before using the slots: they are facts of one execution.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn(SLOT, F.monotonically_increasing_id())


def numbered(placed: DataFrame, start: int, to: str = "id") -> DataFrame:
    """Ids ``start + 1, start + 2, …`` over a written :func:`in_order` table.

    Only the row count of each partition is summed up in one place: as many
    rows as the table has partitions, which is also what is broadcast.
    """
    part = F.shiftright(F.col(SLOT), ROW_BITS)
    row = F.col(SLOT).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + start).alias("_offset")
    )
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(to, F.col("_offset") + row + 1).drop("_part", "_offset", SLOT)


def rows_and_largest_id(df: DataFrame, id_col: str = "id") -> tuple[int, int]:
    """Row count and largest id (0 when empty) of a table, in one pass over its ids."""
    return tuple(
        df.agg(F.count(F.lit(1)), F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).first()
    )


def assign_ids(
    df: DataFrame, start: int, work: Workspace, *order: str, to: str = "id", name: str = "rows"
) -> DataFrame:
    """Number the rows of a written table after ``start``, in the order of unique columns."""
    placed = work.keep(in_order(df, *order), f"{name}-in-order")
    return numbered(placed, start, to=to)
