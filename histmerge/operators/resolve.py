"""Finding catalog rows by name or path, and the default row of a group.

What a catalog offers is aggregated before it meets a query: names and tails of
paths to a count and their least name. Parts of names are found by an index of
q-grams: a query asks for the rarest of its grams, and the names that hold it are
searched for the whole query. So no step makes a row for each query and catalog
row, whatever the number of either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmerge.operators.lookup import keys_among, lookup

TIERS = ["name", "path", "part"]
#: Characters of an indexed part of a name; a shorter query is a gram itself.
GRAM = 3


def components(path: Column) -> Column:
    """A path as an array of its steps; the root is a step of its own.

    Doubled and trailing slashes and every ``.`` but a leading one say nothing.
    """
    steps = F.split(path, "/", -1)
    named = F.filter(steps, lambda c, i: (c != "") & ((c != ".") | (i == 0)))
    root = F.when(path.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(root, named)


def _tails(steps: Column) -> Column:
    """Every tail of a path as text, the empty one included. The root's own slash
    tells ``/a`` from ``a``."""
    size = F.size(steps)
    return F.transform(
        F.sequence(F.lit(0), size),
        lambda n: F.array_join(F.slice(steps, size - n + 1, n), "/"),
    )


def _grams(text: Column, size: Column) -> Column:
    """The distinct parts of a text that are ``size`` characters long."""
    last = F.length(text) - size + 1
    parts = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(text, at, size))
    return F.when(last >= 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def _names(catalog: DataFrame) -> DataFrame:
    """Each name and how many rows have it."""
    return catalog.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _path_offers(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """``offer, name`` for each tail of a path that some query asks for, in place
    where the queries are few."""
    steps = components(F.col("path"))
    tails = catalog.where("path IS NOT NULL").select(F.explode(_tails(steps)).alias("offer"), "name")
    return keys_among(tails, ["offer"], asked.select("offer").distinct())


def _with_tail(asked: DataFrame) -> DataFrame:
    return asked.withColumn("offer", F.array_join(components(F.col("q")), "/"))


def _holding(names: DataFrame, asked: DataFrame) -> DataFrame:
    """``q, name, n`` for each name with each non-empty query in it.

    Of a query's grams the one that the fewest names hold is joined, and the
    names found are searched. Only grams that some query has are counted, and
    only names with a gram that some query chose are joined.
    """
    asked = asked.where("q <> ''").withColumn("size", F.least(F.length("q"), F.lit(GRAM)))
    grams = asked.select("q", F.explode(_grams(F.col("q"), F.col("size"))).alias("gram"))
    # Names offer grams of every size up to GRAM, as short queries are grams.
    every = F.flatten(F.array(*[_grams(F.col("name"), F.lit(n)) for n in range(1, GRAM + 1)]))
    held = names.select("name", "n", F.explode(every).alias("gram"))
    held = keys_among(held, ["gram"], grams.select("gram").distinct())
    frequent = held.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    weighed = grams.join(frequent, "gram", "left")
    chosen = weighed.groupBy("q").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("least")
    )
    chosen = chosen.where("least.names > 0").select("q", F.col("least.gram").alias("gram"))
    return held.join(chosen, "gram").where(F.instr(F.col("name"), F.col("q")) > 0).select("q", "name", "n")


def lookup_hits(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q, tier, hits, name)``: how many catalog rows answer a query in a tier,
    and the least of their names; no row where none does.

    Tier "name": the name is the query. Tier "path": the path is the query or
    ends with it by whole components. Tier "part": the name contains the query.
    """
    asked = queries.select("q").distinct()
    names = _names(catalog)
    by_name = lookup(names.withColumnRenamed("name", "q"), asked, ["q"], how="inner").select(
        "q", F.lit("name").alias("tier"), F.col("n").alias("hits"), F.col("q").alias("name")
    )
    tailed = _with_tail(asked)
    offers = _path_offers(catalog, tailed).groupBy("offer").agg(
        F.count(F.lit(1)).alias("hits"), F.min("name").alias("name")
    )
    by_path = tailed.join(offers, "offer").select("q", F.lit("path").alias("tier"), "hits", "name")
    counted = [F.sum("n").alias("hits"), F.min("name").alias("name")]
    by_part = _holding(names, asked).groupBy("q").agg(*counted)
    # The empty query is in every name: one row, joined to one.
    whole = names.agg(*counted).where("hits > 0").withColumn("q", F.lit(""))
    by_part = by_part.unionByName(asked.where("q = ''").join(F.broadcast(whole), "q"))
    by_part = by_part.select("q", F.lit("part").alias("tier"), "hits", "name")
    return reduce(DataFrame.unionByName, [by_name, by_path, by_part])


def tiered_lookup(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q, status, tier, name_hits, path_hits, part_hits, name)`` per query.

    ``hits`` is the result of :func:`lookup_hits` for these queries.

    The first tier with exactly one hit answers ("found", its tier and name).
    Without one the query is "ambiguous" where any tier had hits, else "not
    found". The names of an ambiguous query are rows of :func:`ambiguous_names`:
    their number has no bound, so they are never gathered into one value.
    """
    counted = hits.groupBy("q").agg(
        *[F.sum(F.when(F.col("tier") == t, F.col("hits"))).alias(f"{t}_hits") for t in TIERS],
        *[F.min(F.when(F.col("tier") == t, F.col("name"))).alias(f"_{t}") for t in TIERS],
    )
    every = queries.select("q").distinct().join(counted, "q", "left")
    none = [F.coalesce(F.col(f"{t}_hits"), F.lit(0)).alias(f"{t}_hits") for t in TIERS]
    every = every.select("q", *none, *[f"_{t}" for t in TIERS])
    tier = F.coalesce(*[F.when(F.col(f"{t}_hits") == 1, F.lit(t)) for t in TIERS])
    name = F.coalesce(*[F.when(F.col("tier") == t, F.col(f"_{t}")) for t in TIERS])
    any_hit = F.greatest(*[F.col(f"{t}_hits") for t in TIERS]) > 0
    status = (
        F.when(F.col("tier").isNotNull(), "found")
        .when(any_hit, "ambiguous")
        .otherwise("not found")
    )
    return every.withColumn("tier", tier).select(
        "q",
        status.alias("status"),
        "tier",
        *[f"{t}_hits" for t in TIERS],
        name.alias("name"),
    )


def ambiguous_names(catalog: DataFrame, answers: DataFrame) -> DataFrame:
    """``(q, name)``: the names any tier found for each ambiguous query.

    ``answers`` is the written result of :func:`tiered_lookup`. The names of other
    queries are not gathered.
    """
    unclear = answers.where("status = 'ambiguous'")
    asked, names = unclear.select("q"), _names(catalog)
    tailed = _with_tail(asked)
    offers = _path_offers(catalog, tailed).distinct()
    found = [
        unclear.where("name_hits > 0").select("q", F.col("q").alias("name")),
        offers.join(tailed, "offer").select("q", "name"),
        _holding(names, asked).select("q", "name"),
        # At most the one empty query.
        names.select(F.lit("").alias("q"), "name").join(F.broadcast(asked.where("q = ''")), "q"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def default_per_group(
    df: DataFrame, group: str, position: str, is_default: str, value: str
) -> DataFrame:
    """``(group, value, status)``: the first row marked default in each group.

    A group without one keeps its row, with no value and status "no default".
    """
    first = F.min_by(value, F.when(F.col(is_default), F.col(position)))
    marked = F.count_if(F.col(is_default)) > 0
    return df.groupBy(group).agg(
        first.alias(value), F.when(marked, "default").otherwise("no default").alias("status")
    )
