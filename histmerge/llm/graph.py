"""Connected components of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.workspace import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for each node of ``links`` (``a, b``) but the roots.

    Each round joins every node's neighbours to the smallest one (larger
    neighbours first, then smaller ones), which halves the depth of a chain; no
    node's neighbours are ever gathered, only their minimum. Rounds are written
    tables, so a lost executor costs a round's part and not the whole lineage.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = work.keep(links.where("a <> b").select(hi, lo).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        ).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = (
            joined.select("hi", F.col("m").alias("lo"))
            .unionAll(joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        edges = work.keep(small, "links")
        # The rounds have ended when the links stay the same and each node has one.
        now = edges.agg(
            F.count("*"), F.count_distinct("hi"), F.bit_xor(F.xxhash64("hi", "lo"))
        ).first()
        if now == before and now[0] == now[1] or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
