"""Row counts, merge statistics and the run's metadata rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histmerge.sources.schema import META, struct_type
from histmerge.sources.tables import History

# The statistics record, in its stored order.
STATS_COLUMNS = [
    "origins_read",
    "origins_inserted",
    "origins_merged",
    "places_read",
    "places_inserted",
    "places_merged",
    "visits_read",
    "visits_inserted",
    "visits_skipped",
    "duration_ms",
]
# Keys of the metadata rows a run writes.
LAST_RUN_KEY = "last_migration"
RUN_STATS_KEY = "migration_stats"


def _one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """One-row tables (disjoint columns) side by side, without a join."""
    wide = [
        part.select(
            *[F.col(n) if n in part.columns else F.lit(None).cast("bigint").alias(n) for n in names]
        )
        for part in parts
    ]
    return reduce(DataFrame.unionByName, wide).agg(*[F.max(n).alias(n) for n in names])


def table_counts(history: History) -> DataFrame:
    """One row: rows per table, and in all."""
    names = list(history.tables())
    parts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in history.tables().items()]
    total: Column = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return _one_row(parts, names).withColumn("total_rows", total)


def side_counts(src: History, dst: History) -> DataFrame:
    """Rows per table of both sides, before a merge."""
    sides = {"source": src, "destination": dst}
    labelled = [table_counts(h).withColumn("side", F.lit(side)) for side, h in sides.items()]
    return labelled[0].unionByName(labelled[1]).select("side", "origins", "places", "visits")


def merge_stats(
    origins: DataFrame, places: DataFrame, visits: DataFrame, duration_ms: int = 0
) -> DataFrame:
    """The statistics record from the one-row statistics of the three merges."""
    parts = [
        origins.toDF("origins_read", "origins_inserted", "origins_merged"),
        places.toDF("places_read", "places_inserted", "places_merged"),
        visits.toDF("visits_read", "visits_inserted", "visits_skipped"),
    ]
    counted = _one_row(parts, STATS_COLUMNS[:-1])
    return counted.withColumn("duration_ms", F.lit(duration_ms).cast("bigint"))


def stats_report(stats: DataFrame) -> DataFrame:
    """The record as one line per table."""
    return stats.selectExpr(
        "stack(3,"
        " 'origins', origins_read, origins_inserted, origins_merged,"
        " 'places', places_read, places_inserted, places_merged,"
        " 'visits', visits_read, visits_inserted, visits_skipped"
        ") AS (table_name, rows_read, rows_inserted, rows_merged_or_skipped)"
    )


def stats_json(stats: DataFrame) -> DataFrame:
    """The record as JSON text, fields in stored order."""
    return stats.select(F.to_json(F.struct(*STATS_COLUMNS)).alias("stats_json"))


def anything_moved(stats: Mapping[str, int]) -> bool:
    """Whether a merge read anything that became or joined a destination row."""
    places = stats["places_inserted"] + stats["places_merged"]
    return places > 0 or stats["visits_inserted"] > 0


def meta_upsert(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key/value rows with ``new`` ones replacing those of the same key.

    Spark broadcasts the new rows if they are few, as the two of a run are.
    """
    return meta.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def run_metadata(spark: SparkSession, now_us: int, stats: Mapping[str, int]) -> DataFrame:
    """The metadata rows of one run. The stored duration is 0: it is not over."""
    record = {c: int(stats[c]) for c in STATS_COLUMNS} | {"duration_ms": 0}
    text = "{" + ",".join(f'"{k}":{v}' for k, v in record.items()) + "}"
    rows = [(LAST_RUN_KEY, str(now_us)), (RUN_STATS_KEY, text)]
    return spark.createDataFrame(rows, struct_type(META))
