"""The whole merge of one side into another: origins, then places, then visits."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.functions.keys import (
    ORIGIN_KEY,
    PLACE_KEY,
    VISIT_KEY,
    derived_guid,
    random_guid,
    url_hash,
)
from histmerge.operators.checks import ValidationError, dangling, orphan_visits, repeated_values
from histmerge.operators.dimension import DimensionMerge, MergeRules, merge_dimension
from histmerge.operators.facts import FactMerge, merge_facts
from histmerge.operators.lookup import remap
from histmerge.operators.measure import Asked, Measured, measure
from histmerge.operators.score import rescore
from histmerge.operators.stats import anything_moved, merge_stats, meta_upsert, run_metadata
from histmerge.sources.publish import Publication, TableState
from histmerge.sources.schema import TABLES, UNIQUE, empty_table, refuse_nulls
from histmerge.sources.tables import History, SameSideError
from histmerge.workspace import Workspace

# How the columns of a place that is on both sides are put together.
PLACE_RULES = {
    "visit_count": "sum",
    "hidden": "or",
    "typed": "max",
    "foreign_count": "sum",
    "last_visit_date": "max",
    "origin_id": "last",
}


class NoDataError(ValueError):
    """The merge moved nothing."""


# What a run refuses unless it is told to accept it.
REFUSED = ("repeated keys", "missing origins", "missing places")


@dataclass(frozen=True)
class MergeOptions:
    """Choices of a merge; the defaults keep the usual behaviour.

    ``place_keys``: what makes two places the same. Inserted places get their
    URL hash computed anew, so with the hash in the key a second run of a source
    with other hashes inserts its places again; ``["url"]`` avoids that.
    ``guids``: "derived" (same when a lost task is computed again) or "random".
    ``remap_visit_places``: also translate the visits' triggering place, which
    is otherwise copied as it is.
    ``accept``: which of ``REFUSED`` a published run lets through.
    """

    place_keys: list[str] = field(default_factory=lambda: list(PLACE_KEY))
    guids: str = "derived"
    remap_visit_places: bool = False
    accept: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if unknown := set(self.accept) - set(REFUSED):
            raise ValueError(f"nothing to accept: {sorted(unknown)}")


@dataclass(frozen=True)
class HistoryMerge:
    """Result of :func:`merge_history`: lazy tables over written key tables."""

    now_us: int
    dst: History
    origins: DimensionMerge
    places: DimensionMerge
    visits: FactMerge
    stats: DataFrame

    @property
    def history(self) -> History:
        """The merged tables."""
        return History(
            origins=self.origins.table,
            places=rescore(self.places.table, self.now_us),
            visits=self.visits.table,
            meta=self.dst.meta,
        )


# What is known of a table on both sides, source first.
Known = tuple[Measured, Measured]


def asked_of(history: History, options: MergeOptions | None = None) -> dict[str, Asked]:
    """What a merge has to know of each table of a side."""
    keys = {
        "origins": ORIGIN_KEY,
        "places": (options or MergeOptions()).place_keys,
        "visits": VISIT_KEY,
    }
    return {
        name: Asked(
            df,
            keys[name],
            between="visit_date" if name == "visits" else None,
            required=[f.name for f in TABLES[name] if not f.nullable],
        )
        for name, df in history.tables().items()
    }


def measure_sides(
    src: History, dst: History, options: MergeOptions | None = None
) -> dict[str, Known]:
    """Both sides of every table, measured in one job."""
    sides = {"src": src, "dst": dst}
    asked = {(s, t): a for s, h in sides.items() for t, a in asked_of(h, options).items()}
    found = measure({f"{s} {t}": a for (s, t), a in asked.items()})
    return {t: (found[f"src {t}"], found[f"dst {t}"]) for t in src.tables()}


def merge_origins(
    src: DataFrame, dst: DataFrame, work: Workspace, known: Known | None = None
) -> DimensionMerge:
    """Keep what is there, insert what is not, map every source id."""
    return merge_dimension(src, dst, ORIGIN_KEY, work, name="origins", known=known)


def place_rules(columns: list[str], options: MergeOptions, run_id: str) -> MergeRules:
    guid = derived_guid(run_id, *PLACE_KEY) if options.guids == "derived" else random_guid()
    on_insert = {"guid": guid, "url_hash": url_hash("url")}
    return MergeRules(
        combine={c: r for c, r in PLACE_RULES.items() if c in columns},
        flag="recalc_frecency",
        on_insert={c: v for c, v in on_insert.items() if c in columns},
    )


def merge_places(
    src: DataFrame,
    dst: DataFrame,
    origin_ids: DataFrame,
    work: Workspace,
    options: MergeOptions | None = None,
    known: Known | None = None,
    maps_fit: bool | None = None,
) -> DimensionMerge:
    """Combine places on both sides, insert new ones, map every source id."""
    options = options or MergeOptions()
    return merge_dimension(
        src,
        dst,
        options.place_keys,
        work,
        place_rules(dst.columns, options, work.run_id),
        id_maps={"origin_id": origin_ids},
        name="places",
        known=known,
        maps_fit=maps_fit,
    )


def merge_visits(
    src: DataFrame,
    dst: DataFrame,
    place_ids: DataFrame,
    work: Workspace,
    options: MergeOptions | None = None,
    known: Known | None = None,
    maps_fit: bool | None = None,
    within: Callable[[object, object], DataFrame] | None = None,
) -> FactMerge:
    """Insert visits whose place (translated), date and type are not there yet."""
    if options is not None and options.remap_visit_places:
        src = remap(src, place_ids, "triggering_place_id", spread=["id"], fits=maps_fit)
    return merge_facts(
        src,
        dst,
        VISIT_KEY,
        work,
        id_maps={"place_id": place_ids},
        between="visit_date",
        name="visits",
        known=known,
        maps_fit=maps_fit,
        within=within,
    )


def merge_history(
    src: History,
    dst: History,
    now_us: int,
    work: Workspace,
    options: MergeOptions | None = None,
    known: Mapping[str, Known] | None = None,
    within: Callable[[object, object], DataFrame] | None = None,
    trial: bool = False,
) -> HistoryMerge:
    """Merge all tables; scores are as of ``now_us`` (UTC microseconds).

    Writes only the run's own key tables. The merged tables are lazy. A
    ``trial`` is for counting alone: new rows are told apart but not numbered.
    """
    options = options or MergeOptions()
    known = known or measure_sides(src, dst, options)

    def ids(merge: DimensionMerge) -> DataFrame:
        return merge.trial_map if trial else merge.id_map

    origins = merge_origins(src.origins, dst.origins, work, known["origins"])
    places = merge_places(
        src.places, dst.places, ids(origins), work, options, known["places"], origins.map_fits
    )
    visits = merge_visits(
        src.visits, dst.visits, ids(places), work, options, known["visits"], places.map_fits, within
    )
    stats = merge_stats(origins.stats, places.stats, visits.stats)
    return HistoryMerge(now_us, dst, origins, places, visits, stats)


def dry_run(
    src: History, dst: History, now_us: int, work: Workspace, options: MergeOptions | None = None
) -> DataFrame:
    """The statistics of a merge; nothing is numbered, the merged tables are never computed."""
    return merge_history(src, dst, now_us, work, options, trial=True).stats


def unmapped_visits(visits: DataFrame, places: DataFrame) -> DataFrame:
    """One row: source visits whose place id no source place has."""
    return orphan_visits(visits, places).select(F.col("orphans").alias("unmapped"))


def validate(history: History, stats: Mapping[str, int], accept: Sequence[str] = ()) -> None:
    """Raise unless something moved and every visit has its place."""
    if not anything_moved(stats):
        raise NoDataError("no data was merged")
    if "missing places" not in accept:
        orphans = orphan_visits(history.visits, history.places).first()["orphans"]
        if orphans:
            raise ValidationError(f"{orphans} visits belong to no place")


def check_side(
    side: History, measured: Mapping[str, Measured], which: str, accept: Sequence[str] = ()
) -> None:
    """Raise where a side breaks its contract, before anything is merged.

    NULL in required columns was counted while measuring. Ids, guids and natural
    keys that occur twice, and places whose origin is missing, take one job each
    over narrow columns.
    """
    for table, found in measured.items():
        refuse_nulls(found.nulls, f"{which} {table}")
    if "repeated keys" not in accept:
        tables = [(name, getattr(side, name), key) for name, key in UNIQUE]
        for name, key, twice in repeated_values(tables):
            raise ValidationError(f"{twice} values of {key} repeat in {name} of the {which}")
    if "missing origins" not in accept:
        lost = dangling(side.places, "origin_id", side.origins).agg(F.sum("rows")).first()[0]
        if lost:
            raise ValidationError(f"{lost} places of the {which} refer to a missing origin")


def published_history(target: Publication) -> History:
    """The published tables as a side of a merge."""
    return History(**{name: target.read(name) for name in TABLES})


def _lies_in(side: History, target: Publication) -> bool:
    """Whether any file of a side is one of the publication's."""
    root = urlsplit(target.root).path.rstrip("/") + "/"
    files = [f for df in side.tables().values() for f in df.inputFiles()]
    return any(urlsplit(f).path.startswith(root) for f in files)


def _refuse_one_side(src: History, dst: History | None, target: Publication, runs: int) -> None:
    """Raise when source and destination are the same tables, or both are destinations."""
    if _lies_in(src, target):
        raise SameSideError(f"the source lies in the publication {target.root}")
    if dst is None:
        return
    if runs and not _lies_in(dst, target):
        raise SameSideError(f"{target.root} is published already and is the destination")
    files = {f for df in src.tables().values() for f in df.inputFiles()}
    if files & {f for df in dst.tables().values() for f in df.inputFiles()}:
        raise SameSideError("the source's tables are the destination's")


def _staged(
    merged: HistoryMerge, target: Publication, first: bool, work: Workspace
) -> dict[str, DataFrame]:
    """What a run publishes, written aside: whole parts that it changes, and new visits.

    NULLs are counted in the same write, and refused.
    """
    origins, places, now_us = merged.origins, merged.places, merged.now_us
    if first:
        whole = merged.history
        tables = {"origins": whole.origins, "places": whole.places, "visits": whole.visits}
    else:
        changed = {
            "origins": _parts(target, "origins", origins.keys.where("is_new")),
            "places": _parts(
                target, "places",
                places.keys.select("id").unionAll(merged.dst.places.where("recalc_frecency = 1").select("id")),
            ),
        }
        tables = {
            name: merge.kept(target.read_parts(name, changed[name])).unionByName(merge.inserted)
            for name, merge in {"origins": origins, "places": places}.items()
        }
        tables = {
            "origins": tables["origins"],
            "places": rescore(tables["places"], now_us),
            "visits": merged.visits.inserted,
        }
    out = {}
    for name, df in tables.items():
        required = [f.name for f in TABLES[name] if not f.nullable]
        out[name], nulls = work.keep_observed(
            df, f"staged-{name}", **{c: F.count_if(F.col(c).isNull()) for c in required}
        )
        refuse_nulls(nulls, name)
    return out


def _parts(target: Publication, table: str, rows: DataFrame) -> list[int]:
    """The parts that hold rows; a table has one for every million ids."""
    found = rows.select(target.part_of(table).alias("part")).distinct().collect()
    return [r["part"] for r in found]


def run_merge(
    src: History,
    dst: History | None,
    target: Publication,
    now_us: int,
    work: Workspace,
    options: MergeOptions | None = None,
) -> dict[str, int]:
    """Check, merge, stage, check what is staged, then publish it in one write.

    A failed check leaves the published tables as they were. The publication is
    the destination. Into an empty one the first run writes ``dst`` as well, or
    nothing if that is None; later runs merge into what is published, and refuse
    a ``dst`` from elsewhere, which would not be what readers see. A source that
    lies in the publication, or shares a file with ``dst``, is refused too. Later
    runs write the parts of origins and places that they change and new visits,
    read published visits between the source's dates only, and check only what
    they bring.
    """
    started = time.monotonic()
    options = options or MergeOptions()
    with target.claimed(work.run_id):
        state = target.state()
        _refuse_one_side(src, dst, target, len(state))
        if state:
            dst = published_history(target)
        elif dst is None:
            dst = History(**{name: empty_table(work.spark, f) for name, f in TABLES.items()})
        known = known_sides(src, dst, state, options)
        check_side(src, {t: m[0] for t, m in known.items()}, "source", options.accept)
        if not state:
            check_side(dst, {t: m[1] for t, m in known.items()}, "destination", options.accept)
        within = partial(target.read_between, "visits") if state else None
        merged = merge_history(src, dst, now_us, work, options, known, within)
        stats = merged.stats.first().asDict()
        staged = _staged(merged, target, not state, work)
        places = staged["places"]
        if state:
            places = dst.places.select("id").unionAll(merged.places.inserted.select("id"))
        whole = History(staged["origins"], places, staged["visits"], dst.meta)
        validate(whole, stats, options.accept)
        staged["meta"] = meta_upsert(dst.meta, run_metadata(work.spark, now_us, stats))
        after = {
            t: TableState(m[1].rows + stats[f"{t}_inserted"], m[1].largest_id + stats[f"{t}_inserted"])
            for t, m in known.items()
        }
        target.publish(staged, after, work.run_id)
    stats["duration_ms"] = int((time.monotonic() - started) * 1000)
    return stats


def known_sides(
    src: History,
    dst: History,
    state: Mapping[str, TableState],
    options: MergeOptions | None = None,
) -> dict[str, Known]:
    """Both sides of every table; of a published one its state tells, unread."""
    if not state:
        return measure_sides(src, dst, options)
    found = measure(asked_of(src, options))
    held = {t: state.get(t, TableState()) for t in found}
    return {
        t: (m, Measured(rows=held[t].rows, largest_id=held[t].largest_id))
        for t, m in found.items()
    }
