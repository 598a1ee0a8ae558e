"""The registered queries: every operator on sides derived from the raw tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histmerge.functions import keys as K
from histmerge.functions.score import later_of
from histmerge.functions.text import repair_text, repair_text_required
from histmerge.operators import checks, resolve, stats
from histmerge.operators.dimension import (
    DimensionMerge,
    MergeRules,
    collapse,
    merge_dimension,
)
from histmerge.operators.facts import FactMerge, merge_facts
from histmerge.operators.ids import assign_ids, first_per_key, rows_and_largest_id
from histmerge.operators.lookup import match, remap, seen, translate, unseen
from histmerge.operators.score import rescore
from histmerge.plans import history as H
from histmerge.plans.oracles import NOW_US, RUN_ID
from histmerge.sources import tables
from histmerge.sources.derived import derived_history, derived_view
from histmerge.sources.publish import Publication
from histmerge.sources.schema import TABLES, VISITS, conform, contract_violations
from histmerge.sources.tables import History
from histmerge.streaming.incremental import merge_arriving_visits
from histmerge.workspace import Workspace

# Sides and upstream merges of this session, written or built once per input.
_built: dict[tuple[str, str], Inputs] = {}


class Inputs:
    """The two sides of one input folder, and what later steps build on.

    The sides are written once per session, as a user's tables would be; a
    query then reads only the columns it needs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.work = Workspace(spark, RUN_ID)
        self._steps: dict[str, object] = {}

    def _once(self, name: str, build: Callable[[], object]) -> object:
        if name not in self._steps:
            self._steps[name] = build()
        return self._steps[name]

    def _side(self, side: str) -> History:
        read = derived_history(self.spark, self.sf_dir, side)
        return read.mapped(lambda name, df: self.work.keep(df, f"{side}-{name}"))

    @property
    def src(self) -> History:
        return self._once("src", lambda: self._side("src"))

    @property
    def dst(self) -> History:
        return self._once("dst", lambda: self._side("dst"))

    @property
    def origins(self) -> DimensionMerge:
        return self._once(
            "origins", lambda: H.merge_origins(self.src.origins, self.dst.origins, self.work)
        )

    @property
    def places(self) -> DimensionMerge:
        return self._once(
            "places",
            lambda: H.merge_places(
                self.src.places, self.dst.places, self.origins.id_map, self.work
            ),
        )

    @property
    def visits(self) -> FactMerge:
        return self._once(
            "visits",
            lambda: H.merge_visits(
                self.src.visits, self.dst.visits, self.places.id_map, self.work
            ),
        )

    @property
    def stats(self) -> DataFrame:
        return stats.merge_stats(self.origins.stats, self.places.stats, self.visits.stats)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Inputs(spark, sf_dir)
    return _built[key]


def _seed_keys(i: Inputs) -> DataFrame:
    seeds = tables.seed_keys(i.dst)
    shown = {"origins": K.origin_key(), "places": K.place_key(), "visits": K.visit_key()}
    none = F.lit(None).cast("bigint").alias("id")
    rows = [
        df.select(
            F.lit(name).alias("table_name"),
            shown[name].alias("key"),
            F.col("id") if "id" in df.columns else none,
        )
        for name, df in seeds.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _contract(i: Inputs) -> DataFrame:
    """NULLs in every declared column of three tables, whether allowed there or not."""
    counted = []
    for name, df in i.src.tables().items():
        declared = TABLES[name]
        strict = [replace(field, nullable=False) for field in declared]
        allowed = F.col("column_name").isin([f.name for f in declared if f.nullable])
        counted.append(
            contract_violations(df, strict).select(
                F.lit(name).alias("table_name"),
                "column_name",
                allowed.alias("may_be_null"),
                F.col("violations").alias("nulls"),
            )
        )
    return reduce(DataFrame.unionByName, counted)


def _collapse_places(i: Inputs) -> DataFrame:
    moved = translate(i.src.places, i.origins.id_map, "origin_id", "_moved", spread=["id"])
    groups = collapse(
        moved, K.PLACE_KEY, MergeRules(H.PLACE_RULES), last_from={"origin_id": "_moved"}
    )
    return groups.select(
        *K.PLACE_KEY, *[F.col(f"_{c}").alias(c) for c in H.PLACE_RULES], "first_id", "source_rows"
    )


def _assign_ids(i: Inputs) -> DataFrame:
    _, start = rows_and_largest_id(i.dst.visits)
    ids = i.src.visits.select(F.col("id").alias("old_id"))
    return assign_ids(ids, start, i.work, "old_id", to="new_id")


def _merge_places(i: Inputs) -> DimensionMerge:
    return H.merge_places(i.src.places, i.dst.places, i.origins.id_map, i.work)


def _moved_visits(i: Inputs) -> DataFrame:
    return remap(i.src.visits, i.places.id_map, "place_id")


def _nullsafe_max(i: Inputs) -> DataFrame:
    there = i.dst.places.select(*K.PLACE_KEY, F.col("last_visit_date").alias("_there"))
    here = i.src.places.select("id", *K.PLACE_KEY, "last_visit_date")
    return here.join(there, K.PLACE_KEY).select(
        "id", later_of("last_visit_date", "_there").alias("last_visit_date")
    )


def _meta_upsert(i: Inputs) -> DataFrame:
    counted = stats.table_counts(i.dst).selectExpr(
        "stack(4, 'origins', string(origins), 'places', string(places), 'visits', string(visits),"
        " 'last_migration', '0') AS (key, value)"
    )
    record = i.stats.first().asDict()
    return stats.meta_upsert(counted, stats.run_metadata(i.spark, NOW_US, record))


def _merged_counts(i: Inputs) -> DataFrame:
    merged = H.merge_history(i.src, i.dst, NOW_US, i.work).history
    sides = {"rows_before": stats.table_counts(i.dst), "rows_after": stats.table_counts(merged)}
    lines = "stack(3, 'origins', origins, 'places', places, 'visits', visits) AS (table_name, {})"
    before, after = (df.selectExpr(lines.format(name)) for name, df in sides.items())
    return before.join(F.broadcast(after), "table_name")  # three rows each


# The derived sides hold references into nowhere, which a run refuses by default.
WHOLE = H.MergeOptions(accept=("missing origins", "missing places"))


def _published(i: Inputs) -> tuple[Publication, Workspace]:
    """A whole published run."""
    work = Workspace(i.spark, RUN_ID)
    target = Publication(i.spark, i.work.keep_path("published"))
    H.run_merge(i.src, i.dst, target, NOW_US, work, WHOLE)
    return target, work


def _publish(i: Inputs) -> DataFrame:
    """The places of a published run, read back."""
    return _published(i)[0].read("places")


def _second_run(i: Inputs) -> DataFrame:
    """Published visits with their places' URLs after a second run.

    The second source is the side that the first run started from, so all its
    visits are published already, and every visit must stay with its place.
    """
    target, work = _published(i)
    H.run_merge(i.dst, None, target, NOW_US, work, WHOLE)
    places = target.read("places").select(F.col("id").alias("place_id"), "url")
    return target.read("visits").join(places, "place_id").select("id", *K.VISIT_KEY, "url")


#: Files that the events arrive in, one for each batch of the stream.
ARRIVALS = 4


def _incremental(i: Inputs) -> DataFrame:
    """All events as a file stream, merged batch by batch in the order of their ids."""
    target = Publication(i.spark, i.work.keep_path("stream-target"))
    target.publish({"visits": i.dst.visits})
    events, folder = i.table("events"), i.work.keep_path("arriving")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // ARRIVALS + 1
    for n in range(ARRIVALS):
        inside = F.col("event_id").between(low + n * step, low + (n + 1) * step - 1)
        events.where(inside).coalesce(1).write.mode("append").parquet(folder)
    reader = i.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    visits = conform(derived_view("src_visits", events=reader.parquet(folder)), VISITS)
    query = merge_arriving_visits(
        visits, target, i.places.id_map, i.work.keep_path("stream-state"), "arriving"
    )
    query.awaitTermination()
    return target.read("visits")


def _repeated(i: Inputs) -> DataFrame:
    """Repeated keys of the merged tables, and of the source before its merge."""
    checked = {
        "merged origins": (i.origins.table, K.ORIGIN_KEY),
        "merged places": (i.places.table, ["guid"]),
        "source places": (i.src.places, K.PLACE_KEY),
        "source visits": (i.src.visits, K.VISIT_KEY),
    }
    counted = [
        checks.repeated(df, key).withColumn("table_name", F.lit(name))
        for name, (df, key) in checked.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def _site(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Pages as a catalog of names and paths, and what is looked up in it.

    Every third path has steps that say nothing in it, and so has every query
    for the path of a page with an odd number.
    """
    page, host, rest = F.col("page_id"), F.col("host"), F.col("rest")
    bare = F.regexp_replace("page_url", "^[a-z]+://[^/]+/", "")
    site = derived_view("site_pages", pages=i.table("pages")).withColumn("rest", bare)
    catalog = site.select(
        host.alias("name"),
        F.concat(F.lit("/site/"), host, F.when(page % 3 == 0, "/./").otherwise("//"), rest).alias("path"),
    )
    asked = [
        host,
        F.concat(F.when(page % 2 == 1, F.concat(host, F.lit("/./"))).otherwise(""), rest),
        F.regexp_extract(host, "^([^.]+)", 1),
        F.concat(host, F.lit("/none")),
    ]
    return catalog, site.select(F.explode(F.array(*asked)).alias("q")).distinct()


def _answers(i: Inputs) -> tuple[DataFrame, DataFrame]:
    catalog, asked = _site(i)
    return catalog, resolve.tiered_lookup(resolve.lookup_hits(catalog, asked), asked)


def _ambiguous(i: Inputs) -> DataFrame:
    catalog, answers = _answers(i)
    return resolve.ambiguous_names(catalog, i.work.keep(answers, "answers"))


def _customers(i: Inputs) -> DataFrame:
    marked = i.table("customer").withColumn("is_default", F.col("c_acctbal") > 0)
    return resolve.default_per_group(
        marked, "c_nationkey", "c_custkey", "is_default", "c_custkey"
    )


#: Malformed ends of a text, by turns: a cut-off character of two bytes and of
#: three, and two bytes that never occur.
MALFORMED = (b"\xc3", b"\xe2\x82", b"\xff\xfe")


def _broken_text(i: Inputs, repair: Callable[[str], Column]) -> DataFrame:
    """Every whole document with malformed bytes put in, and its language, which may be NULL."""
    turn = F.pmod("doc_id", F.lit(len(MALFORMED)))
    bad = F.coalesce(*[F.when(turn == k, F.lit(b)) for k, b in enumerate(MALFORMED)], F.lit(b""))
    lang = F.encode(F.coalesce("lang", F.lit("")), "UTF-8")
    broken = F.concat(F.encode("text", "UTF-8"), bad, lang)
    documents = i.table("documents").withColumn("b", broken)
    return documents.select("doc_id", repair("b").alias("text"), repair("lang").alias("lang"))


def order_sides(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders per customer and month; the destination's months start on the 16th."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    src = orders.select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.trunc("o_orderdate", "month").alias("month"),
        cents.alias("cents"),
        F.to_date("o_orderdate").alias("last_order"),
    )
    shifted = F.trunc(F.date_sub("o_orderdate", 15), "month")
    dst = orders.groupBy("o_custkey", shifted.alias("month")).agg(
        F.min("o_orderkey").alias("id"),
        F.sum(cents).alias("cents"),
        F.to_date(F.max("o_orderdate")).alias("last_order"),
    )
    return src, dst.select(*src.columns)


def merge_order_months(orders: DataFrame, work: Workspace) -> DimensionMerge:
    src, dst = order_sides(orders)
    rules = MergeRules({"cents": "sum", "last_order": "max"})
    return merge_dimension(src, dst, ["o_custkey", "month"], work, rules, name="orders")


def line_sides(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines per supplier and month; the destination's months start on the 16th."""

    def side(shipped: Column) -> DataFrame:
        return lineitem.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            "l_suppkey",
            "l_linenumber",
            F.trunc(shipped, "month").alias("ship_month"),
        )

    return side(F.col("l_shipdate")), side(F.date_sub("l_shipdate", 15))


LINE_KEY = ["l_suppkey", "ship_month", "l_linenumber"]


def merge_lines(lineitem: DataFrame, work: Workspace) -> FactMerge:
    src, dst = line_sides(lineitem)
    return merge_facts(src, dst, LINE_KEY, work, between="ship_month", name="lines")


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "scan_origins": lambda i: tables.scan_origins(i.src.origins),
    "scan_places": lambda i: tables.scan_places(i.src.places),
    "scan_visits": lambda i: tables.scan_visits(i.src.visits),
    "conform_schema": lambda i: tables.scan_places(
        derived_view("dst_places", pages=i.table("pages"))
    ),
    "seed_keys": _seed_keys,
    "contract_violations": _contract,
    "table_counts": lambda i: stats.table_counts(i.src),
    "side_counts": lambda i: stats.side_counts(i.src, i.dst),
    "origin_key": lambda i: i.src.origins.select("id", K.origin_key().alias("origin_key")),
    "place_key": lambda i: i.src.places.select("id", K.place_key().alias("place_key")),
    "visit_key": lambda i: i.src.visits.select("id", K.visit_key().alias("visit_key")),
    "visit_type_label": lambda i: i.src.visits.select(
        "id", "visit_type", K.visit_type_label().alias("label")
    ),
    "origin_match": lambda i: match(
        i.src.origins.select("id", *K.ORIGIN_KEY), i.dst.origins, K.ORIGIN_KEY
    ),
    "merge_origins": lambda i: H.merge_origins(i.src.origins, i.dst.origins, i.work).table,
    "origin_id_map": lambda i: H.merge_origins(i.src.origins, i.dst.origins, i.work).id_map,
    "remap_origin_fk": lambda i: remap(
        i.src.places.select("id", "origin_id"), i.origins.id_map, "origin_id"
    ),
    "place_match": lambda i: match(
        i.src.places.select("id", *K.PLACE_KEY), i.dst.places, K.PLACE_KEY
    ),
    "collapse_places": _collapse_places,
    "first_per_key": lambda i: first_per_key(i.src.places, K.PLACE_KEY),
    "assign_ids": _assign_ids,
    "merge_places": lambda i: _merge_places(i).table,
    "place_id_map": lambda i: _merge_places(i).id_map,
    "guid_derived": lambda i: i.src.places.select(
        "id", K.derived_guid(RUN_ID, *K.PLACE_KEY).alias("guid")
    ),
    "remap_place_fk": _moved_visits,
    "visits_new": lambda i: unseen(_moved_visits(i), i.dst.visits, K.VISIT_KEY),
    "visits_existing": lambda i: seen(_moved_visits(i), i.dst.visits, K.VISIT_KEY),
    "merge_visits": lambda i: H.merge_visits(
        i.src.visits, i.dst.visits, i.places.id_map, i.work
    ).inserted,
    "union_tables": lambda i: i.visits.table,
    "orphan_visits": lambda i: checks.orphan_visits(i.visits.table, i.places.table),
    "dangling_origins": lambda i: checks.dangling(i.places.table, "origin_id", i.origins.table),
    "place_origin_inner": lambda i: checks.place_origins(
        i.places.table.select("id", "url", "origin_id"), i.work.keep(i.origins.table, "origins")
    ).select("id", "url", "prefix", "host"),
    "mismatched_origins": lambda i: checks.mismatched_origins(
        i.places.table.select("id", "url", "origin_id"), i.work.keep(i.origins.table, "origins")
    ).select("id", "url", "prefix", "host"),
    "unmapped_visits": lambda i: H.unmapped_visits(i.src.visits, i.src.places),
    "rescore": lambda i: rescore(i.places.table, NOW_US),
    "score_flagged": lambda i: rescore(
        i.places.table.where("recalc_frecency = 1"), NOW_US
    ).select("id", "frecency"),
    "nullsafe_max": _nullsafe_max,
    "merge_stats": lambda i: i.stats,
    "dry_run_stats": lambda i: H.dry_run(i.src, i.dst, NOW_US, i.work),
    "stats_report": lambda i: stats.stats_report(i.stats),
    "stats_json": lambda i: stats.stats_json(i.stats),
    "meta_upsert": _meta_upsert,
    "validation_report": lambda i: checks.validation_report(
        i.stats, i.places.table, i.dst.visits, i.visits.inserted
    ),
    "repeated_keys": _repeated,
    "merge_history_counts": _merged_counts,
    "publish_versioned": _publish,
    "publish_second_run": _second_run,
    "incremental_visits": _incremental,
    "tiered_lookup": lambda i: _answers(i)[1],
    "ambiguous_names": _ambiguous,
    "default_per_group": _customers,
    "text_repair": lambda i: _broken_text(i, repair_text),
    "text_repair_required": lambda i: _broken_text(i, repair_text_required),
    "url_hash": lambda i: i.table("pages").select("page_id", K.url_hash("url").alias("url_hash")),
    "merge_dimension_orders": lambda i: merge_order_months(i.table("orders"), i.work).table,
    "merge_facts_lineitem": lambda i: merge_lines(i.table("lineitem"), i.work).inserted,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as a function of a session and an input folder."""

    def registered(build: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(inputs(spark, sf_dir))

    return {name: registered(build) for name, build in QUERIES.items()}
