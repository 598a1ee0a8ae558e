"""Declared schemas of the history tables, and the contract their rows meet."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmerge.functions.text import repair_text, repair_text_required


class ContractError(ValueError):
    """Rows or columns that the declared schema does not allow."""


@dataclass(frozen=True)
class Field:
    """A declared column: its type, whether NULL is allowed, and the defaults.

    ``default`` fills a column the input lacks. ``when_null`` replaces NULL in a
    column that is present (required text reads as the empty string).
    """

    name: str
    type: T.DataType
    nullable: bool = True
    default: object = None
    when_null: object = None


def _id(name: str) -> Field:
    return Field(name, T.LongType(), nullable=False)


def _number(name: str, default: int | None = None) -> Field:
    return Field(name, T.LongType(), nullable=False, default=default)


def _optional(name: str) -> Field:
    return Field(name, T.LongType())


def _text(name: str) -> Field:
    return Field(name, T.StringType())


def _required_text(name: str) -> Field:
    return Field(name, T.StringType(), nullable=False, when_null="")


ORIGINS = [
    _id("id"),
    _required_text("prefix"),
    _required_text("host"),
    _number("frecency"),
    _number("recalc_frecency", 0),
    _optional("alt_frecency"),
    _number("recalc_alt_frecency", 0),
    _optional("block_until_ms"),
    _optional("block_pages_until_ms"),
]

PLACES = [
    _id("id"),
    _required_text("url"),
    _text("title"),
    _required_text("rev_host"),
    _number("visit_count", 0),
    Field("hidden", T.BooleanType(), nullable=False, default=False),
    _number("typed", 0),
    _number("frecency", -1),
    _optional("last_visit_date"),
    _required_text("guid"),
    _number("foreign_count", 0),
    _number("url_hash", 0),
    _text("description"),
    _text("preview_image_url"),
    _text("site_name"),
    _optional("origin_id"),
    _number("recalc_frecency", 0),
    _optional("alt_frecency"),
    _number("recalc_alt_frecency", 0),
]

VISITS = [
    _id("id"),
    _optional("from_visit"),
    _number("place_id"),
    _number("visit_date"),
    Field("visit_type", T.IntegerType(), nullable=False),
    _number("session"),
    Field("source", T.IntegerType(), nullable=False, default=0),
    _optional("triggering_place_id"),
]

META = [
    Field("key", T.StringType(), nullable=False),
    Field("value", T.StringType(), nullable=False),
]

# What no two rows of a published table may share.
UNIQUE = [
    ("origins", ["id"]),
    ("origins", ["prefix", "host"]),
    ("places", ["id"]),
    ("places", ["guid"]),
    ("visits", ["id"]),
    ("meta", ["key"]),
]

# Other names under which stored tables hold a declared column.
STORED_AS = {"triggering_place_id": "triggeringPlaceId"}

TABLES = {"origins": ORIGINS, "places": PLACES, "visits": VISITS, "meta": META}


def struct_type(fields: list[Field]) -> T.StructType:
    """The declared schema as a Spark type."""
    return T.StructType([T.StructField(f.name, f.type, f.nullable) for f in fields])


def empty_table(spark: SparkSession, fields: list[Field]) -> DataFrame:
    """A table of the declared schema with no rows: a destination not yet created."""
    return spark.createDataFrame([], struct_type(fields))


def _conformed(field: Field, have: T.DataType | None) -> Column:
    if have is None:
        if field.default is None and not field.nullable and field.when_null is None:
            raise ContractError(f"column {field.name} is missing and has no default")
        fill = field.default if field.default is not None else field.when_null
        return F.lit(fill).cast(field.type).alias(field.name)
    column = F.col(field.name)
    if isinstance(field.type, T.StringType):
        if not isinstance(have, (T.StringType, T.BinaryType, T.NullType)):
            raise ContractError(f"column {field.name} must hold text, not {have.simpleString()}")
        repair = repair_text if field.when_null is None else repair_text_required
        return repair(column).alias(field.name)
    if isinstance(field.type, T.BooleanType) and isinstance(have, T.NumericType):
        return (column != 0).alias(field.name)
    return column.cast(field.type).alias(field.name)


def conform(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Select the declared columns by name, cast, repaired and with defaults.

    Columns the schema does not declare are dropped, so the scan below never
    reads them.
    """
    for name, stored in STORED_AS.items():
        if name in {f.name for f in fields} and name not in df.columns and stored in df.columns:
            df = df.withColumnRenamed(stored, name)
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select([_conformed(f, have.get(f.name)) for f in fields])


def contract_violations(df: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per declared not-null column: how many rows break it.

    One aggregate over the whole table, whatever the number of columns.
    """
    required = [f.name for f in fields if not f.nullable and f.name in df.columns]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = ", ".join(f"'{c}', `{c}`" for c in required)
    return counted.selectExpr(f"stack({len(required)}, {pairs}) AS (column_name, violations)")


def refuse_nulls(nulls: Mapping[str, int], table: str) -> None:
    """Raise when NULLs were counted in required columns."""
    if broken := {c: n for c, n in nulls.items() if n}:
        detail = ", ".join(f"{c}: {n}" for c, n in broken.items())
        raise ContractError(f"{table} holds NULL in required columns ({detail})")


def check_contract(df: DataFrame, fields: list[Field], table: str) -> None:
    """Raise when a required column holds NULL anywhere in the table."""
    found = contract_violations(df, fields).collect()  # one row per column
    refuse_nulls({r["column_name"]: r["violations"] for r in found}, table)
