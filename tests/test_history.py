import random

import pytest
from pyspark.sql import functions as F

from histmerge.operators import lookup as lookup_module
from histmerge.operators import stats as S
from histmerge.operators.checks import dangling, mismatched_origins, orphan_visits
from histmerge.plans.history import (
    MergeOptions,
    NoDataError,
    ValidationError,
    dry_run,
    measure_sides,
    merge_history,
    run_merge,
    unmapped_visits,
)
from histmerge.sources.publish import Publication
from histmerge.sources.schema import ContractError
from histmerge.operators.checks import repeated
from histmerge.sources.schema import VISITS, conform
from histmerge.sources.tables import SameSideError
from histmerge.workspace import Workspace
from tests.conftest import place, rows
from tests.model import DAY, NOW, replay

BASE = dict(
    origins=[(1, "https://", "example.com", 100), (2, "https://", "test.com", 200)],
    places=[
        place(1, "https://example.com/", 111, 5, origin=1),
        place(2, "https://test.com/page", 222, 3, origin=2),
    ],
    visits=[(1, 1, 1000000, 1, 1), (2, 1, 2000000, 2, 1), (3, 2, 1500000, 1, 2)],
)


def counts(history):
    return tuple(df.count() for df in history.tables().values())


def test_whole_merge_into_nothing(history, work):
    merged = merge_history(history(**BASE), history(), NOW, work)
    assert tuple(merged.stats.first()) == (2, 2, 0, 2, 2, 0, 3, 3, 0, 0)
    assert counts(merged.history) == (2, 2, 3)
    assert orphan_visits(merged.history.visits, merged.history.places).first()[0] == 0


def test_whole_merge_onto_the_same_place(history, work):
    origin = [(1, "https://", "example.com", 50)]
    url = "https://example.com/"
    dst = history(origin, [place(1, url, 111, 10, origin=1)], [(1, 1, 500000, 1, 1)])
    src = history(origin, [place(1, url, 111, 5, origin=1)], [(1, 1, 3000000, 2, 1)])
    merged = merge_history(src, dst, NOW, work)
    assert tuple(merged.stats.first()) == (1, 0, 1, 1, 0, 1, 1, 1, 0, 0)
    assert rows(merged.history.places, "visit_count", "last_visit_date", "frecency") == [
        (15, None, -1)
    ]


def test_sparse_source_ids_become_dense(history, work):
    src = history(
        [(50, "https://", "a.com", 1), (99, "https://", "b.com", 1)],
        [place(1, "https://a.com/x", 555, 1, origin=50), place(2, "https://b.com/y", 666, 1, origin=99)],
    )
    merged = merge_history(src, history(), NOW, work).history
    assert rows(merged.origins, "id", "host") == [(1, "a.com"), (2, "b.com")]
    assert dangling(merged.places, "origin_id", merged.origins).count() == 0
    assert mismatched_origins(merged.places, merged.origins).count() == 0


def test_dry_run_counts_and_publishes_nothing(spark, history, work, tmp_path):
    stats = dry_run(history(**BASE), history(), NOW, work).first()
    assert stats["visits_inserted"] == 3
    assert Publication(spark, str(tmp_path)).current() == 0


def test_empty_text_is_a_value_but_for_guids(spark):
    twice = spark.createDataFrame([("", "localhost", ""), ("", "localhost", "")], "prefix string, host string, guid string")
    assert repeated(twice, ["prefix", "host"]).first()["repeated"] == 1
    assert repeated(twice, ["guid"]).first()["repeated"] == 0


def test_stored_column_names_are_known(spark):
    stored = spark.range(1).selectExpr("id", "1 AS place_id", "2 AS visit_date", "1 AS visit_type", "0 AS session", "55 AS triggeringPlaceId")
    assert conform(stored, VISITS).first()["triggering_place_id"] == 55


def published(target):
    return {t: target.read(t) for t in ("origins", "places", "visits", "meta")}


def as_history(history, target):
    from histmerge.sources.tables import History

    return History(**published(target))


def test_run_publishes_all_tables_and_metadata(spark, history, tmp_path):
    target = Publication(spark, str(tmp_path / "out"))
    stats = run_merge(history(**BASE), history(), target, NOW, Workspace(spark))
    assert stats["duration_ms"] > 0 and stats["places_inserted"] == 2
    assert target.current() == 1
    meta = dict(rows(target.read("meta")))
    assert meta["last_migration"] == str(NOW)
    assert meta["migration_stats"] == (
        '{"origins_read":2,"origins_inserted":2,"origins_merged":0,"places_read":2,'
        '"places_inserted":2,"places_merged":0,"visits_read":3,"visits_inserted":3,'
        '"visits_skipped":0,"duration_ms":0}'
    )


def test_two_sources_into_one_publication(spark, history, tmp_path):
    """The second run merges into what the first published, not into its own seed."""
    target = Publication(spark, str(tmp_path / "out"))
    first = history(
        origins=[(1, "https://", "a.com", 0)],
        places=[place(1, "https://a.com/x", 555, 1, origin=1)],
        visits=[(1, 1, 10, 1, 0)],
    )
    second = history(
        origins=[(1, "https://", "b.com", 0)],
        places=[place(1, "https://b.com/y", 666, 1, origin=1)],
        visits=[(1, 1, 11, 1, 0)],
    )
    run_merge(first, None, target, NOW, Workspace(spark))
    run_merge(second, None, target, NOW, Workspace(spark))
    visits, places = target.read("visits"), target.read("places")
    joined = visits.join(places.selectExpr("id AS place_id", "url"), "place_id")
    assert rows(joined, "id", "url") == [(1, "https://a.com/x"), (2, "https://b.com/y")]
    with pytest.raises(SameSideError):
        run_merge(second, first, target, NOW, Workspace(spark))
    with pytest.raises(SameSideError):
        run_merge(as_history(history, target), None, target, NOW, Workspace(spark))


def test_second_run_of_a_source(spark, history, tmp_path):
    """Inserted places carry a new hash, so only hash-equal or url keys find them."""
    src, options = history(**BASE), MergeOptions(place_keys=["url"])
    again, by_url = Publication(spark, str(tmp_path / "a")), Publication(spark, str(tmp_path / "b"))
    for target, chosen in ((again, None), (by_url, options)):
        run_merge(src, history(), target, NOW, Workspace(spark), chosen)
        run_merge(src, as_history(history, target), target, NOW, Workspace(spark), chosen)
    assert rows(again.read("places"), "visit_count") == [(3,), (3,), (5,), (5,)]
    assert again.read("visits").count() == 6
    assert rows(by_url.read("places"), "visit_count") == [(10,), (6,)]
    assert by_url.read("visits").count() == 3
    assert by_url.read("places").select("guid").distinct().count() == 2
    assert again.read("places").select("guid").distinct().count() == 4


def test_failed_validation_leaves_the_published_tables(spark, history, tmp_path):
    target = Publication(spark, str(tmp_path / "out"))
    run_merge(history(**BASE), history(), target, NOW, Workspace(spark))
    bad = history(places=[place(1, "v", 3, 1)], visits=[(1, 77, 5, 1, 0)])
    with pytest.raises(ValidationError, match="1 visits belong to no place"):
        run_merge(bad, as_history(history, target), target, NOW, Workspace(spark))
    assert target.current() == 1
    assert (target.read("places").count(), target.read("visits").count()) == (2, 3)
    good = history(places=[place(1, "v", 3, 1)], visits=[(1, 1, 5, 1, 0)])
    run_merge(good, as_history(history, target), target, NOW, Workspace(spark))
    assert target.current() == 2
    assert (target.read("places").count(), target.read("visits").count()) == (3, 4)


def test_empty_source_is_an_error(spark, history, tmp_path):
    with pytest.raises(NoDataError):
        run_merge(history(), history(**BASE), Publication(spark, str(tmp_path)), NOW, Workspace(spark))


def refused(history, work, target, error, match, side, accept=()):
    """Either side with the fault is refused, before anything is merged or published."""
    options = MergeOptions(accept=accept)
    for src, dst, which in ((side, history(), "source"), (history(**BASE), side, "destination")):
        with pytest.raises(error, match=match.format(side=which)):
            run_merge(src, dst, target, NOW, work, options)
    assert (target.current(), target.claims()) == (0, [])


def without(side, table, column, value=None):
    """A side whose rows of one table have a value in a column."""
    put = lambda name, df: df.withColumn(column, F.lit(value).cast(df.schema[column].dataType)) if name == table else df
    return side.mapped(put)


def test_either_side_breaking_the_contract_is_refused(spark, history, tmp_path, work):
    target = Publication(spark, str(tmp_path / "out"))
    missing = history(places=[place(1, "u", 1, 1, origin=5)])
    cases = [
        (ContractError, r"{side} places .*visit_count: 2", without(history(**BASE), "places", "visit_count")),
        (ContractError, r"{side} visits .*visit_date: 3", without(history(**BASE), "visits", "visit_date")),
        (ValidationError, "1 values of id repeat in places of the {side}", without(history(**BASE), "places", "id", 1)),
        (ValidationError, "1 values of id repeat in visits of the {side}", without(history(**BASE), "visits", "id", 1)),
        (ValidationError, r"1 values of prefix\+host repeat in origins of the {side}", without(history(**BASE), "origins", "host", "h")),
        (ValidationError, "1 values of guid repeat in places of the {side}", without(history(**BASE), "places", "guid", "g")),
        (ValidationError, "1 places of the {side} refer to a missing origin", missing),
    ]
    for error, match, side in cases:
        refused(history, work, target, error, match, side)
    run_merge(missing, None, target, NOW, work, MergeOptions(accept=("missing origins",)))
    assert target.read("places").count() == 1
    with pytest.raises(ValueError, match="nothing to accept"):
        MergeOptions(accept=("anything",))


def test_source_and_destination_are_not_the_same_files(spark, history, tmp_path, work):
    kept = history(**BASE).mapped(lambda n, df: work.keep(df, n))
    target = Publication(spark, str(tmp_path / "out"))
    with pytest.raises(SameSideError, match="the destination's"):
        run_merge(kept, kept, target, NOW, work)


def jobs(spark, run):
    """How many Spark jobs a call starts."""
    group = f"counted-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_dry_run_measures_once_and_numbers_nothing(spark, history, work):
    src, dst = (history(**BASE).mapped(lambda n, df: work.keep(df, n)) for _ in range(2))
    assert jobs(spark, lambda: measure_sides(src, dst)) <= 2
    found = []
    assert jobs(spark, lambda: found.append(dry_run(src, dst, NOW, work).first())) <= 25
    assert found[0]["visits_inserted"] == 0 and found[0]["places_merged"] == 2
    merged = merge_history(src, dst, NOW, work, trial=True)
    assert not {"_new", "inserted", "id_map"} & set(vars(merged.places))


def test_undefined_score_is_refused(spark, history, tmp_path):
    src = history(places=[place(1, "u", 1, 1, last=NOW + int(DAY), flag=1)])
    with pytest.raises(ContractError, match="frecency: 1"):
        run_merge(src, history(), Publication(spark, str(tmp_path)), NOW, Workspace(spark))


def test_triggering_place_is_copied_or_moved(spark, history, work):
    src = history(**BASE)
    src = src.mapped(
        lambda n, df: df.withColumn("triggering_place_id", F.col("place_id")) if n == "visits" else df
    )
    dst = history(places=[place(8, "x", 1)])
    plain = merge_history(src, dst, NOW, work).history
    moved = merge_history(src, dst, NOW, work, MergeOptions(remap_visit_places=True)).history
    assert rows(plain.visits, "triggering_place_id") == [(1,), (1,), (2,)]
    assert rows(moved.visits, "triggering_place_id") == [(10,), (9,), (9,)]


def test_random_guids_are_written_once(spark, history, tmp_path):
    target = Publication(spark, str(tmp_path / "out"))
    run_merge(history(**BASE), history(), target, NOW, Workspace(spark), MergeOptions(guids="random"))
    first, second = (rows(target.read("places"), "guid") for _ in range(2))
    assert first == second and len(set(first)) == 2


def test_report_and_checks(spark, history, work):
    from histmerge.operators.checks import validation_report

    dst = history(visits=[(1, 99, 5, 1, 0)])
    src = history(**{**BASE, "visits": BASE["visits"] + [(9, 50, 7, 1, 0)]})
    assert unmapped_visits(src.visits, src.places).first()[0] == 1
    merged = merge_history(src, dst, NOW, work)
    report = validation_report(
        merged.stats, merged.history.places, dst.visits, merged.visits.inserted
    )
    assert rows(report) == [
        ("new_orphan_visits", 1, False),
        ("orphan_visits", 2, False),
        ("rows_moved", 6, True),
    ]
    assert rows(S.stats_report(merged.stats)) == [
        ("origins", 2, 2, 0),
        ("places", 2, 2, 0),
        ("visits", 4, 4, 0),
    ]
    assert rows(S.side_counts(src, dst)) == [("destination", 0, 0, 1), ("source", 2, 2, 4)]


def test_meta_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    assert rows(S.meta_upsert(old, new)) == [("a", "1"), ("b", "3"), ("c", "4")]


def random_side(r: random.Random, size: int, ids: int) -> dict:
    """A side with repeated keys, missing values and references into nowhere."""

    def some(n):
        return r.sample(range(1, ids), n)

    maybe = lambda value: r.choice([None, value, value])
    origins, pairs = [], [(p, f"h{n}") for p in ("http://", "https://") for n in range(6)]
    for i, (prefix, host) in zip(some(8), r.sample(pairs, 8)):
        origins.append(dict(id=i, prefix=prefix, host=host, frecency=r.randrange(9)))
    origin_ids = [o["id"] for o in origins] + [ids + 5]
    places = [
        dict(
            id=i, url=r.choice([None, "", *"abcdefghijkl"]), url_hash=r.randrange(3),
            visit_count=r.randrange(4), hidden=r.random() < 0.3, typed=r.randrange(3),
            foreign_count=r.randrange(3), last_visit_date=maybe(NOW - r.randrange(10**13)),
            origin_id=maybe(r.choice(origin_ids)), recalc_frecency=r.randrange(2),
            frecency=r.randrange(100), title=maybe(f"t{i}"), guid=f"g{i}",
        )
        for i in some(size)
    ]
    # One place holds a third of the visits.
    place_ids = [p["id"] for p in places] + [ids + 7, ids + 8]
    hot = r.choice(place_ids)
    visits = [
        dict(
            id=i, place_id=hot if r.random() < 0.34 else r.choice(place_ids),
            visit_date=r.randrange(6), visit_type=r.randrange(1, 4), session=r.randrange(9),
        )
        for i in some(size * 3)
    ]
    return dict(origins=origins, places=places, visits=visits)


def values(side: dict, table: str) -> list[tuple]:
    return [tuple(row.values()) for row in side[table]]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("way", ["small", "large"])
def test_merge_equals_a_row_by_row_replay(spark, history, work, monkeypatch, seed, way):
    if way == "large":  # no broadcasts, every key that repeats is spread
        monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(lookup_module, "HEAVY_ROWS", 2)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    else:
        monkeypatch.setattr(lookup_module, "BATCH_RATIO", seed % 2)
    r = random.Random(seed)
    src, dst = random_side(r, 40, 1000), random_side(r, 25, 100 if seed % 2 else 1000)
    seen = set()  # origins are unique in a destination; other tables need not be
    dst["origins"] = [
        o for o in dst["origins"]
        if (o["prefix"], o["host"]) not in seen and not seen.add((o["prefix"], o["host"]))
    ]
    want = replay(src, dst)
    sides = [
        history(values(s, "origins"), values(s, "places"), values(s, "visits")) for s in (src, dst)
    ]
    try:
        merged = merge_history(*sides, NOW, work)
        for table, shown in (
            ("origins", src["origins"][0].keys()),
            ("places", src["places"][0].keys() - {"guid"}),
            ("visits", src["visits"][0].keys()),
        ):
            columns = sorted(shown)
            got = rows(getattr(merged.history, table), *columns)
            expected = []
            for row in want[table].values():
                row = {**row, "url": row["url"] or ""} if table == "places" else row
                expected.append(tuple(row[c] for c in columns))
            assert got == sorted(expected, key=repr), table
        assert dict(rows(merged.origins.id_map)) == want["origin_ids"]
        assert dict(rows(merged.places.id_map)) == want["place_ids"]
        got = merged.stats.first().asDict()
        assert {k: v for k, v in got.items() if k != "duration_ms"} == want["stats"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
