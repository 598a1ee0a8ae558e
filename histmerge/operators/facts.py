"""Adding facts that are not there yet to a table of facts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.operators.ids import assign_ids, first_per_key
from histmerge.operators.lookup import is_batch, keys_among, remap
from histmerge.operators.measure import Asked, Measured, measure
from histmerge.workspace import Workspace


@dataclass
class FactMerge:
    """Result of :func:`merge_facts`; the new facts are numbered when asked for."""

    dst: DataFrame
    fresh: DataFrame  # written: the new facts under their source ids
    key_columns: list[str]
    stats: DataFrame  # one row: rows_read, rows_inserted, rows_skipped
    start: int
    work: Workspace
    id_col: str
    name: str

    @cached_property
    def inserted(self) -> DataFrame:
        """The new facts alone, with their ids."""
        numbered = assign_ids(
            self.fresh, self.start, self.work, self.id_col, *self.key_columns, to="_id", name=self.name
        )
        return numbered.withColumn(self.id_col, F.col("_id")).select(*self.dst.columns)

    @property
    def table(self) -> DataFrame:
        """Destination and new facts."""
        return self.dst.unionByName(self.inserted)


def merge_facts(
    src: DataFrame,
    dst: DataFrame,
    keys: list[str],
    work: Workspace,
    id_maps: Mapping[str, DataFrame] | None = None,
    id_col: str = "id",
    between: str | None = None,
    name: str = "facts",
    known: tuple[Measured, Measured] | None = None,
    maps_fit: bool | None = None,
    within: Callable[[object, object], DataFrame] | None = None,
) -> FactMerge:
    """Insert the source facts whose key is new, first row per key winning.

    ``id_maps`` translates foreign keys before keys are compared, so facts of
    two source rows that became one destination row meet. ``between`` names a
    key column (a date) by whose range in the source the destination is cut: an
    equal key has an equal date, so nothing outside can match. ``within`` reads
    the destination between two dates where its storage can do better than a
    filter. ``known`` and ``maps_fit`` are as for ``merge_dimension``.
    """
    moved = src
    for column, id_map in (id_maps or {}).items():
        moved = remap(moved, id_map, column, spread=[id_col], fits=maps_fit)
    if known is None:
        sides = measure({"src": Asked(src, keys, id_col, between), "dst": Asked(dst, (), id_col)})
        known = sides["src"], sides["dst"]
    here, there = known
    seen = dst
    if between is not None:
        inside = F.col(between).between(F.lit(here.low), F.lit(here.high))
        seen = within(here.low, here.high) if within else dst.where(inside)
    if is_batch(here.rows, there.rows, len(keys), here.key_bytes):
        moved = work.keep(moved, f"{name}-batch")
        seen = keys_among(seen.select(*keys), keys, moved, fits=True)
    fresh = work.keep(first_per_key(moved, keys, id_col, unless=seen), f"{name}-new")
    stats = fresh.agg(
        F.lit(here.rows).cast("bigint").alias("rows_read"),
        F.count(F.lit(1)).alias("rows_inserted"),
    ).withColumn("rows_skipped", F.col("rows_read") - F.col("rows_inserted"))
    return FactMerge(dst, fresh, keys, stats, there.largest_id, work, id_col, name)
