"""Joins of a large table to a table with one row per key.

Three ways, chosen by what is measured:

* the keyed table is provably small: broadcast, the large side does not move;
* otherwise both sides are shuffled on the key, and
* keys heavy enough to fill many tasks are spread over several: rows of a heavy
  key get a number from a hash, and the one keyed row is copied to each number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmerge.operators.measure import Asked, Measured, measure

# Bounds of a broadcast table, checked before every broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 * 1024 * 1024

# A source so many times smaller than the destination, and within the broadcast
# bounds, is a batch: the destination's keys are cut down to its keys in place.
BATCH_RATIO = 20

# A key is heavy from this many rows on, and from the MOST_HEAVY-th part of all
# rows, so that there are never more heavy keys than that. Rows of a heavy key are
# divided into parts of as many rows. The sketch keeps ten counters for each.
HEAVY_ROWS = 1_000_000
MOST_HEAVY = 5_000
SKETCH_ITEMS = 10 * MOST_HEAVY

HASH, SPLITS = "_hash", "_splits"
SALT = "_salt"


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a table is small, by its row count and its real bytes, in one pass.

    Meant for written tables; of fixed-width ones only file footers are read.
    """
    sizes = [F.count(F.lit(1)).alias("rows")]
    for field in table.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.sum(F.octet_length(field.name)).alias(f"bytes{len(sizes)}"))
    rows, *texts = table.agg(*sizes).first()
    return small(rows, len(table.columns), sum(size or 0 for size in texts))


def small(rows: int, columns: int, text_bytes: int = 0) -> bool:
    """Whether a table of known size is within the bounds of a broadcast."""
    return rows <= BROADCAST_ROWS and 8 * columns * rows + text_bytes <= BROADCAST_BYTES


@dataclass(frozen=True)
class Heavy:
    """Hash of each heavy key and into how many parts its rows go, and whether the
    rows without a key are as many."""

    splits: Mapping[int, int]
    unkeyed: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        """``_hash, _splits`` of at most ``MOST_HEAVY`` keys."""
        return spark.createDataFrame(list(self.splits.items()), f"{HASH} bigint, {SPLITS} bigint")


def _without(keys: list[str]) -> Column:
    """Whether a row has NULL in a key."""
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def heavy_keys(df: DataFrame, keys: list[str]) -> Heavy:
    """The heavy keys of a table.

    One pass with a fixed-size sketch; at most ``MOST_HEAVY`` numbers reach the
    driver. The result only places rows, so its estimates cannot change a join.
    """
    none = _without(keys)
    found = df.select(F.when(~none, F.xxhash64(*keys)).alias(HASH)).agg(
        F.count(HASH).alias("rows"),
        F.count_if(F.col(HASH).isNull()).alias("unkeyed"),
        F.expr(f"approx_top_k({HASH}, {MOST_HEAVY}, {SKETCH_ITEMS})").alias("top"),
    ).first()
    least = max(HEAVY_ROWS, (found["rows"] or 0) // MOST_HEAVY)
    top = [(t["item"], t["count"]) for t in found["top"] or [] if t["item"] is not None]
    return Heavy({h: n // least + 1 for h, n in top if n >= least}, found["unkeyed"] >= least)


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``df`` to ``table`` (one row per key), safe for heavy keys of ``df``.

    ``spread`` names columns of ``df`` that differ between rows of one key; by
    default all. Rows with a NULL key match nothing and are spread as well.
    ``fits`` says whether ``table`` is small where the caller knows its size.
    Without a heavy key both sides are shuffled by the keys alone, so a side that
    has just been grouped by them stays where it is.
    """
    if fits is None:
        fits = fits_broadcast(table)
    if fits:
        return df.join(F.broadcast(table), keys, how)
    heavy = heavy_keys(df, keys)
    if not heavy.splits and not heavy.unkeyed:
        return df.join(table, keys, how)
    known = F.broadcast(heavy.table(df.sparkSession))
    parts = F.coalesce(SPLITS, F.lit(1).cast("bigint"))
    number = F.xxhash64(*(spread or df.columns))
    salt = F.when(_without(keys), number).otherwise(F.pmod(number, parts))
    rows = df.withColumn(HASH, F.xxhash64(*keys)).join(known, HASH, "left")
    copies = table.withColumn(HASH, F.xxhash64(*keys)).join(known, HASH, "left")
    copies = copies.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    salted = rows.withColumn(SALT, salt).drop(HASH, SPLITS)
    return salted.join(copies.drop(HASH, SPLITS), [*keys, SALT], how).drop(SALT)


def match(
    src: DataFrame,
    dst: DataFrame,
    keys: list[str],
    dst_id: str = "id",
    held: Measured | None = None,
) -> DataFrame:
    """Every source row with the destination id of its key, NULL where unseen.

    Of several destination rows with one key the largest id counts. Grouping
    first leaves one row per key, so no destination key is heavy in the join. The
    grouping runs once: whether it is small is told by the rows that go into it
    (``held``, measured in one pass without a shuffle where it is not given).
    """
    held = held or measure({"dst": Asked(dst, keys, dst_id)})["dst"]
    fits = small(held.rows, len(keys) + 1, held.key_bytes)
    return lookup(src, newest_id(dst, keys, dst_id), keys, fits=fits)


def newest_id(dst: DataFrame, keys: list[str], dst_id: str = "id") -> DataFrame:
    """One row per destination key with the largest id as ``dst_id``."""
    return dst.groupBy(*keys).agg(F.max(dst_id).alias("dst_id"))


def translate(
    df: DataFrame, id_map: DataFrame, column: str, to: str, spread: list[str] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Add ``to``: ``column`` through an id map (``old_id``, ``new_id``), else NULL."""
    renamed = id_map.select(F.col("old_id").alias(column), F.col("new_id").alias(to))
    return lookup(df, renamed, [column], spread=spread, fits=fits)


def remap(
    df: DataFrame, id_map: DataFrame, column: str, spread: list[str] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Replace ``column`` through an id map; ids it does not hold stay as they are."""
    moved = translate(df, id_map, column, "_new_id", spread, fits)
    return moved.select(
        *[
            F.coalesce("_new_id", column).alias(column) if c == column else F.col(c)
            for c in df.columns
        ]
    )


def is_batch(src_rows: int, dst_rows: int, columns: int, text_bytes: int = 0) -> bool:
    """Whether broadcasting a source's keys spares shuffling those of a large destination."""
    return src_rows * BATCH_RATIO <= dst_rows and small(src_rows, columns, text_bytes)


def keys_among(
    df: DataFrame, keys: list[str], batch: DataFrame, fits: bool | None = None
) -> DataFrame:
    """Rows of ``df`` whose key a batch has; ``df`` stays in place where the batch is small.

    The size is checked here unless the caller knows that it ``fits``.
    """
    held = batch.select(*keys)
    if fits is None:
        fits = fits_broadcast(held)
    return df.join(F.broadcast(held) if fits else held.distinct(), keys, "left_semi")


def unseen(src: DataFrame, dst: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the destination does not hold (anti join)."""
    return src.join(dst.select(*keys).distinct(), keys, "left_anti")


def seen(src: DataFrame, dst: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the destination holds (semi join)."""
    return src.join(dst.select(*keys).distinct(), keys, "left_semi")
