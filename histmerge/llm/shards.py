"""Shards from a weighted hash tree of regions, racks and shards.

A document descends the tree. At each node every child draws a number from a
hash of the document's id and the child's name, ``-ln(u) / weight``, and the
smallest draw wins, so a child is chosen in proportion to its weight (the sum of
its shards' weights). A child's draw depends on nothing but its own name and
weight: if weights change, rows leave or enter only children whose weight
changed, at every level, and everything below other children stays in place.
A step looks at the children of one node, so a row costs the sum of three
fan-outs, not the number of shards.

A subtree that grew may deal its rows anew among its own children. So that one
more shard takes rows into itself alone, ``with_one_more`` opens a region for it
(law ``key``: the id and the number of shards decide); a tree laid out anew by
``layout`` moves more rows and is a decision of its own.

Defined results: a null text has no bytes (size 1, CRC 0); a null id hashes as
the empty text, so all rows without an id share a shard; repeated rows share a
shard and take neighbouring slots; an empty table gives an empty result. A
shard of weight 0 gets nothing. Columns beyond those named are ignored by
``assign_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmerge.llm.batches import with_columns
from histmerge.operators.ids import ROW_BITS, SLOT, in_order
from histmerge.workspace import Workspace

#: The law that holds: id and shard count decide.
LAW = "key"
#: Hexadecimal digits of a draw's hash: 52 bits, exact in a double.
DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    """``shards`` equal shards, ``per_rack`` in a rack and ``per_region`` in a region."""
    return [Leaf(s // per_region, s % per_region // per_rack, s) for s in range(shards)]


def with_one_more(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with a shard more, in a new region: rows move to it and nowhere else."""
    region = 1 + max((leaf.region for leaf in tree), default=-1)
    return [*tree, Leaf(region, 0, 1 + max((leaf.shard for leaf in tree), default=-1), weight)]


def _levels(tree: Sequence[Leaf]) -> list[list[list[tuple[str, float, int]]]]:
    """Per level and parent the children: name, weight, and which node of the next
    level (of the last one: which shard) each is."""
    if any(leaf.weight < 0 for leaf in tree) or not sum(leaf.weight for leaf in tree) > 0:
        raise ValueError("weights are not negative, and one at least is positive")
    if len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("two leaves are the same shard")
    leaves = sorted((x for x in tree if x.weight > 0), key=lambda x: (x.region, x.rack, x.shard))
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    racks = [(region, rack) for region, held in regions.items() for rack in held]
    top = [
        (f"{region}", sum(x.weight for held in racks_of.values() for x in held), k)
        for k, (region, racks_of) in enumerate(regions.items())
    ]
    middle = [
        [(f"{region}/{rack}", sum(x.weight for x in held), racks.index((region, rack)))
         for rack, held in racks_of.items()]
        for region, racks_of in regions.items()
    ]
    last = [
        [(f"{x.region}/{x.rack}/{x.shard}", x.weight, x.shard) for x in regions[region][rack]]
        for region, rack in racks
    ]
    return [[top], middle, last]


def _drawn(key: Column, children: Column) -> Column:
    """Which child wins; ties, which equal weights make impossible but for equal
    hashes, go to the smaller number."""

    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(child["name"], F.lit(":"), key).cast("binary"))
        bits = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
        return F.struct(
            (-F.log((bits + 0.5) / float(16**DIGITS)) / child["weight"]).alias("draw"), child["at"]
        )

    return F.array_min(F.transform(children, draw))["at"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key, as an expression: no row moves to find it."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    at = F.lit(0)
    for level in _levels(tree):
        nodes = F.array(
            *[
                F.array(
                    *[
                        F.struct(
                            F.lit(name).alias("name"),
                            F.lit(float(weight)).alias("weight"),
                            F.lit(to).alias("at"),
                        )
                        for name, weight, to in children
                    ]
                )
                for children in level
            ]
        )
        at = _drawn(text, nodes[at])
    return at


def assign_shards(docs: DataFrame, work: Workspace, tree: Sequence[Leaf]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    Slots count the rows of a shard from 0, by id. Narrow rows are sorted in
    ranges over all tasks, and only the row count of each shard in each range is
    summed up, so a shard may be of any size.
    """
    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    rows = work.keep(
        plain.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            shard_of(F.col("doc_id"), tree).alias("shard"),
            shard_of(F.col("doc_id"), with_one_more(tree)).alias("grown_shard"),
            # Lets rows that are alike be cut into several ranges.
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharded",
    )
    order = ["shard", "doc_id", "text_crc32", "size", "row"]
    placed = work.keep(in_order(rows, *order), "sharded-in-order")
    part = F.shiftright(SLOT, ROW_BITS)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(part.alias("part"), "shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min(SLOT).alias("first")
    )
    starts = runs.select(
        "part", "shard", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start")
    )
    # At most a row for each range and one more for each shard.
    return placed.withColumn("part", part).join(F.broadcast(starts), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("start") + F.col(SLOT)).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, folder: str, tree: Sequence[Leaf], key: str = "doc_id") -> DataFrame:
    """Whole rows in one folder for each shard, below its region and rack.

    Spark's rebalancing cuts a large shard into several files and joins small
    parts, so neither a heavy shard nor many tasks make odd files.
    """
    places = {leaf.shard: leaf for leaf in tree}
    names = ["region", "rack", "shard"]
    if clash := {*names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of the documents are named like a level: {sorted(clash)}")
    where = F.create_map(
        *[
            x
            for shard, leaf in places.items()
            for x in (F.lit(shard), F.struct(F.lit(leaf.region).alias("region"), F.lit(leaf.rack).alias("rack")))
        ]
    )
    placed = docs.withColumn("shard", shard_of(F.col(key), tree)).withColumns(
        {level: where[F.col("shard")][level] for level in names[:2]}
    )
    placed.hint("rebalance", *names).write.mode("error").partitionBy(*names).parquet(folder)
    return docs.sparkSession.read.parquet(folder)
