"""Referential checks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmerge.operators.lookup import lookup


class ValidationError(ValueError):
    """The merged tables break a referential rule."""


# Columns in which empty text means that there is no value.
MAY_BE_EMPTY = ("guid",)


def dangling(df: DataFrame, column: str, parent: DataFrame, parent_id: str = "id") -> DataFrame:
    """Values of ``column`` no parent row has, with how many rows hold each.

    Rows are counted per value before the anti join, so a value held by a third
    of all rows is one row in it. NULL refers to nothing and is not dangling.
    """
    held = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")
    )
    ids = parent.select(F.col(parent_id).alias(column))
    return held.join(ids, column, "left_anti")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many values of a key occur more than once.

    Rows are counted per value in each task first. NULL is no value, and neither
    is an empty guid: several rows may be without one. Empty text in any other
    column is a value like others.
    """
    held = df
    for column in key:
        held = held.where(F.col(column).isNotNull())
        if column in MAY_BE_EMPTY:
            held = held.where(F.col(column) != "")
    counted = held.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    return counted.agg(F.count_if(F.col("rows") > 1).alias("repeated"))


def repeated_values(
    tables: Sequence[tuple[str, DataFrame, list[str]]],
) -> list[tuple[str, str, int]]:
    """``(table, key, how many values of it repeat)`` for each key that does, in one job.

    Like :func:`repeated` for several keys at once: number keys (one column) and
    text keys (up to two) are grouped side by side.
    """
    parts = []
    for name, df, key in tables:
        there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        for column in key:
            if column in MAY_BE_EMPTY:
                there = there & (F.col(column) != "")
        number = isinstance(df.schema[key[0]].dataType, T.IntegralType)
        texts = [F.col(c).cast("string") for c in key] if not number else []
        texts += [F.lit(None).cast("string")] * (2 - len(texts))
        parts.append(
            df.where(there).select(
                F.lit(name).alias("table_name"),
                F.lit("+".join(key)).alias("key"),
                (F.col(key[0]).cast("bigint") if number else F.lit(None).cast("bigint")).alias("n"),
                texts[0].alias("a"),
                texts[1].alias("b"),
            )
        )
    rows = reduce(DataFrame.unionAll, parts)
    twice = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found = twice.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("repeated"))
    return [tuple(r) for r in found.orderBy("table_name", "key").collect()]  # a row for each key


def orphan_visits(visits: DataFrame, places: DataFrame) -> DataFrame:
    """One row: how many visits belong to no place."""
    missing = dangling(visits, "place_id", places)
    return missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("orphans"))


def place_origins(places: DataFrame, origins: DataFrame) -> DataFrame:
    """Places with the prefix and host of their origin (inner join)."""
    parent = origins.select(F.col("id").alias("origin_id"), "prefix", "host")
    return lookup(places, parent, ["origin_id"], how="inner", spread=["id"])


def mismatched_origins(places: DataFrame, origins: DataFrame) -> DataFrame:
    """Places whose URL does not start with their origin's prefix and host."""
    start = F.concat("prefix", "host")
    return place_origins(places, origins).where(~F.col("url").startswith(start))


def validation_report(
    stats: DataFrame, places: DataFrame, old_visits: DataFrame, new_visits: DataFrame
) -> DataFrame:
    """One row per check: its name, what it counted, whether it passed.

    ``places`` are the merged ones. Orphans among the visits the merge brought
    are told apart from those that were there before, in one pass over both.
    """
    visits = old_visits.select("place_id", F.lit(0).alias("_new")).unionByName(
        new_visits.select("place_id", F.lit(1).alias("_new"))
    )
    held = visits.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_new").alias("_new")
    )
    ids = places.select(F.col("id").alias("place_id"))
    found = held.join(ids, "place_id", "left_anti").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("every"),
        F.coalesce(F.sum("_new"), F.lit(0)).cast("bigint").alias("new"),
    )
    orphans = found.selectExpr(
        "stack(2, 'orphan_visits', every, 'new_orphan_visits', new) AS (check_name, value)"
    )
    moved = stats.select(
        F.lit("rows_moved").alias("check_name"),
        F.expr("places_inserted + places_merged + visits_inserted").alias("value"),
    )
    return moved.withColumn("passed", F.col("value") > 0).unionByName(
        orphans.withColumn("passed", F.col("value") == 0)
    )
