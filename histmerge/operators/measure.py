"""What a merge has to know of its tables, all of it from one pass.

Counts, largest ids, ranges and missing values of any number of tables come out
of one aggregation: each table is read once, in the columns that are asked for,
and reduced to a row in every task before anything moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Asked:
    """A table, and what is asked of it."""

    table: DataFrame
    keys: Sequence[str] = ()
    id_col: str = "id"
    between: str | None = None
    required: Sequence[str] = ()


@dataclass(frozen=True)
class Measured:
    """Row count, ids, the range of a column, text in keys, and NULLs of a table."""

    rows: int = 0
    least_id: int = 0
    largest_id: int = 0
    low: object = None
    high: object = None
    key_bytes: int = 0
    nulls: Mapping[str, int] = field(default_factory=dict)


def _seen(name: str, a: Asked) -> DataFrame:
    """A table's rows as what is aggregated of them."""
    types = {f.name: f.dataType for f in a.table.schema.fields}
    texts = [k for k in a.keys if isinstance(types[k], (T.StringType, T.BinaryType))]
    columns = [
        f"'{name}' AS name",
        f"CAST(`{a.id_col}` AS BIGINT) AS id",
        " + ".join(["0L", *[f"coalesce(octet_length(`{k}`), 0)" for k in texts]]) + " AS bytes",
    ]
    if a.between is not None:
        columns.append(f"`{a.between}` AS between_{types[a.between].simpleString()}")
    columns += [f"if(`{c}` IS NULL, 1L, NULL) AS `null_{c}`" for c in a.required if c in types]
    return a.table.selectExpr(*columns)


def measure(asked: Mapping[str, Asked]) -> dict[str, Measured]:
    """Measure tables by name. Reads only the columns that are asked for."""
    # Statements rather than columns: built in a few calls, however many tables.
    parts = {name: _seen(name, a) for name, a in asked.items()}
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts.values())
    ranged = [c for c in rows.columns if c.startswith("between_")]
    nulls = [c for c in rows.columns if c.startswith("null_")]
    aggregates = [
        "count(1) AS rows",
        "coalesce(min(id), 0L) AS least_id",
        "coalesce(max(id), 0L) AS largest_id",
        "sum(bytes) AS key_bytes",
        *[f"{f}(`{c}`) AS `{f}_{c}`" for c in ranged for f in ("min", "max")],
        *[f"coalesce(sum(`{c}`), 0L) AS `{c}`" for c in nulls],
    ]
    counted = rows.groupBy("name").agg(*map(F.expr, aggregates))
    out = {}
    for r in counted.collect():  # one row per table
        own = parts[r["name"]].columns
        between = next((c for c in own if c in ranged), None)
        out[r["name"]] = Measured(
            r["rows"], r["least_id"], r["largest_id"],
            r[f"min_{between}"] if between else None, r[f"max_{between}"] if between else None,
            r["key_bytes"], {c.removeprefix("null_"): r[c] for c in own if c in nulls},
        )
    return {name: out.get(name, Measured()) for name in asked}
